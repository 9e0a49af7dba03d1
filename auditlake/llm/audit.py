"""Audit of how filters interact, from contingency tensors.

Each document passes or fails each of five filters. Per part of the corpus the outcomes are counted in a 2x2x2x2x2 tensor (one for all documents,
one each for labelled good and toxic ones). Whatever an order of the filters does is a contraction of that tensor: along each axis a
vector picks the documents that pass, those that fail, or all.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.stages import stage

FILTERS = "ABCDE"
_PASS, _FAIL, _ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
_KINDS = ("docs", "good", "toxic")


def words(text: Column) -> Column:
    """Maximal runs of ``[^\\x20\\x09-\\x0D]``."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), "")


def failures(text: Column) -> dict[str, Column]:
    """What each filter but the last one rejects, from a text that is not null."""
    found = words(text)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(found) < 50, "B": F.size(F.array_distinct(found)) * 100 < F.size(found) * 65, "C": capitals * 100 > F.length(text) * 5,
        "D": F.length(F.translate(text, "#$%&*|", "")) < F.length(text),
    }


def outcomes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, cell, docs, good, toxic)``: how many documents of a part have each combination of outcomes.

    ``cell`` has a bit per filter that the document fails, A the highest. A document fails E if a smaller id has its text. Only digests of
    texts are shuffled: the smallest id of each text is found with partial sums, and rows meet it by text and id, so
    copies, however many, are spread over the tasks.
    """
    flags = failures(F.col("text"))
    bits = sum((flags[x].cast("int") * (1 << (4 - i)) for i, x in enumerate(FILTERS[:4])), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stage(rows.select("id", "part", bits.alias("bits"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "outcomes")
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = rows.join(first, ["id", "digest"], "left").join(marks, "id", "left")
    again = (F.col("first").isNull() & F.col("id").isNotNull()).cast("int")
    return rows.groupBy("part", (F.col("bits") + again).alias("cell")).agg(
        F.count(F.lit(1)).alias("docs"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("good", "toxic")]
    )


def contract(tensors: np.ndarray, axes: list[np.ndarray]) -> np.ndarray:
    """Counts (per kind) of the documents that the vectors pick along the axes."""
    return np.einsum("kabcde,a,b,c,d,e->k", tensors, *axes)


def steps_of(tensors: np.ndarray) -> list[tuple]:
    """A row for each order and step: order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    rows, shares = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        axes = [_ALL] * 5
        for step, name in enumerate(order, 1):
            at = FILTERS.index(name)
            axes[at] = _FAIL
            removed, good, toxic = (int(x) for x in contract(tensors, axes))
            failing, alone = ([_FAIL if i == at else other for i in range(5)] for other in (_ALL, _PASS))
            redundant = int(contract(tensors, failing)[0]) - removed
            axes[at] = _PASS
            kept = int(contract(tensors, axes)[0])
            shares[name] += removed
            rows.append(("".join(order), step, kept, removed, redundant, int(contract(tensors, alone)[0]), good, toxic))
    return [(*row, shares[row[0][row[1] - 1]]) for row in rows]


_OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each step of each order, per part: 600 rows for each source of ``docs (doc_id, text, source)``.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (its filter fails them, but an earlier one has removed them), ``unique_fails`` (only
    its filter fails them), ``good_lost`` and ``toxic_lost`` (removed ones with ``quality`` or ``toxic`` 1 in ``labels``), ``shapley`` (removed by its filter,
    summed over all orders). Null texts are empty, a null source is part ``''``. Rows without id have no labels and are no copies. Repeated rows count
    each; rows that share both id and text are no copies of each other. An id labelled more than once is good or toxic if one label says so. Other
    columns are ignored; no documents: no rows.
    """

    def tell(part: pd.DataFrame) -> pd.DataFrame:  # at most 32 rows: a part's cells
        tensors = np.zeros((len(_KINDS), 32), np.int64)
        tensors[:, part["cell"].to_numpy()] = part[list(_KINDS)].to_numpy().T
        rows = steps_of(tensors.reshape(-1, 2, 2, 2, 2, 2))
        return pd.DataFrame([(part["part"].iloc[0], *row) for row in rows], columns=[x.split()[0] for x in _OUT.split(", ")])

    return outcomes(docs, labels).groupBy("part").applyInPandas(tell, _OUT)


def interactions_sql() -> str:
    """:func:`interactions` in DuckDB, by masks over the outcomes."""
    return """
with t as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
firsts as (select text, min(doc_id) as f from t group by text),
marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by doc_id),
cells as (
  select part, cast(len(w) < 50 as int) * 16 + cast(100 * len(list_distinct(w)) < 65 * len(w) as int) * 8
      + cast(100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 5 * length(t.text) as int) * 4
      + cast(regexp_matches(t.text, '[#$%&*|]') as int) * 2 + cast(coalesce(t.doc_id > f, false) as int) as cell,
    count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from t join firsts on t.text = firsts.text left join marks on marks.doc_id = t.doc_id group by 1, 2),
letters as (select * from (values ('A', 16), ('B', 8), ('C', 4), ('D', 2), ('E', 1)) as l(x, m)),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order, [a.m, b.m, c.m, d.m, e.m] as ms from letters a, letters b, letters c, letters d, letters e
  where a.m + b.m + c.m + d.m + e.m = 31 and len(list_distinct([a.m, b.m, c.m, d.m, e.m])) = 5),
steps as (
  select filter_order, cast(s.k as int) as step, ms[s.k] as own, cast(coalesce(list_sum(ms[1:s.k - 1]), 0) as int) as before from orders, (select unnest(range(1, 6)) as k) s),
told as (
  select part, filter_order, step, own,
    sum(case when cell & (before | own) = 0 then n else 0 end) as kept, sum(case when cell & before = 0 and cell & own > 0 then n else 0 end) as removed,
    sum(case when cell & before > 0 and cell & own > 0 then n else 0 end) as redundant, sum(case when cell = own then n else 0 end) as unique_fails,
    sum(case when cell & before = 0 and cell & own > 0 then good else 0 end) as good_lost, sum(case when cell & before = 0 and cell & own > 0 then toxic else 0 end) as toxic_lost
  from cells, steps group by 1, 2, 3, 4)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from told"""
