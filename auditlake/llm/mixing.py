"""Mixing sources to target weights by pivotal dependent rounding.

Each document gets ``copies = target / size of its source`` of itself on average. The whole part is taken as it is; the
fractions are rounded in pairs: words move from one document to the other, in a direction drawn so that
no expectation changes, until one of the two is whole. Documents of a source are rounded block by block; what a
block cannot settle, one document at most, goes up a tree of blocks to a single last one. As a move keeps the words of
the pair, a source misses its target by less than one document.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from auditlake.llm import texts
from auditlake.llm.stages import stage

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column | str) -> Column:
    """Words of a text; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes (source, source_size, ...)``, one row per source, with ``target``.

    Sources by code point (null last) take ``weights`` in turn and share ``share`` of all sizes; a target stops
    at ``most`` times its source, the excess is shared again by weight until none is above.
    """
    weight = F.array(*[F.lit(float(x)) for x in weights])
    table = stage(_places(sizes).withColumn("weight", F.element_at(weight, (F.col("place") % len(weights) + 1).cast("int"))), "sources")
    total = float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    cap = F.col("source_size") * float(most)
    level = 0.0  # words per unit of weight
    while True:
        stopped = cap <= F.col("weight") * level
        held, free = table.agg(
            F.coalesce(F.sum(F.when(stopped, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0))
        ).first()
        raised = (share * total - held) / free if free else math.inf
        if raised <= level * (1 + 1e-12):
            break
        level = raised
        if math.isinf(level):
            break
    return table.withColumn("target", F.least(cap, F.col("weight") * level)).drop("weight", "place")


def _places(sizes: DataFrame) -> DataFrame:
    """Adds ``place``: each source's place by code point from 0, null last, without one window over all sources."""
    lead = sizes.withColumn("lead", F.substring("source", 1, 3))
    heads = lead.groupBy("lead").agg(F.count(F.lit(1)).alias("n"))
    heads = heads.select(
        F.col("lead").alias("head"),
        F.coalesce(F.sum("n").over(W.orderBy(F.col("lead").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    inside = W.partitionBy("lead").orderBy("source")
    return (
        lead.join(heads, F.col("lead").eqNullSafe(F.col("head")))
        .withColumn("place", F.col("before") + F.row_number().over(inside) - 1).drop("lead", "head", "before")
    )


def pivot(size: np.ndarray, part: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Round ``part`` (0 to 1) of documents of ``size`` words: all but one at most become 0 or 1.

    Words are handed along the rows: the document in hand and the next one trade words until either is whole.
    """
    part = part.astype(float).copy()
    hand = -1
    for i in range(len(part)):
        if part[i] <= 0 or part[i] >= 1 or size[i] <= 0:
            continue
        if hand < 0:
            hand = i
            continue
        a, b = float(size[hand]), float(size[i])
        up = min((1 - part[hand]) * a, part[i] * b)  # words that can move to the one in hand
        down = min(part[hand] * a, (1 - part[i]) * b)
        if draw[i] * (up + down) < down:
            full, part[hand], part[i] = up == (1 - part[hand]) * a, part[hand] + up / a, part[i] - up / b
            whole = (hand, 1.0) if full else (i, 0.0)
        else:
            full, part[hand], part[i] = down == part[hand] * a, part[hand] - down / a, part[i] + down / b
            whole = (hand, 0.0) if full else (i, 1.0)
        part[whole[0]] = whole[1]
        for x in (hand, i):  # both can become whole at once
            if part[x] < 1e-12 or part[x] > 1 - 1e-12:
                part[x] = round(part[x])
        left = [x for x in (hand, i) if 0 < part[x] < 1]
        hand = left[0] if left else -1
    return part


_UNIT = "source string, block long, size long, part double, key long"


def _settled(level: int, last: bool, seed: int):
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        # large documents first: what is left over at the end is small
        rows = rows.sort_values(["size", "key", "block"], ascending=[False, True, True], kind="stable")
        keys = rows["key"].to_numpy(np.int64).view(np.uint64) + np.uint64(seed * 1_000_003 + level)
        draw = (texts.mix(texts.mix(keys)) >> np.uint64(11)) / float(1 << 53)
        part = pivot(rows["size"].to_numpy(), rows["part"].to_numpy(), draw)
        alone = (rows["size"].to_numpy() <= 0) | last  # no words to move, or nobody to move them to
        part = np.where(alone & (part > 0) & (part < 1), (draw < part).astype(float), part)
        return rows.assign(part=part)

    return settle


def decisions(docs: DataFrame, ids: Sequence[str] = ("doc_id",), weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, block: int = 1024, seed: int = 11) -> DataFrame:
    """``ids, key, size, source_size, target, copies, taken``, one row per row of ``docs (ids, source, text)``.

    Each row is one unit, repeated rows are several; ``copies`` is a whole number from 0 to ``most`` and ``taken`` is ``copies``
    times ``size``. Rows without words are drawn one by one. Null texts have size 0, null sources are one source, null
    ids are allowed. Draws come from hashes of the rows, so reruns agree. An empty table gives no rows. Other columns are ignored.
    """
    base = docs.select(
        *ids, "source", n_words("text").alias("size"), F.xxhash64(*ids, "source", "text").alias("key")
    )
    units = stage(base, "units")
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = stage(source_targets(sizes, weights, share, most), "targets")
    targets = targets.select(F.col("source").alias("of"), "source_size", "target", F.ceil(F.col("rows") / block).alias("blocks"))
    ratio = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size"), 15)).otherwise(F.lit(0.0))
    dealt = (
        units.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        .withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), "blocks"))
        .withColumn("whole", F.floor(ratio)).withColumn("part", ratio - F.floor(ratio))
    )
    most_blocks = targets.agg(F.coalesce(F.max("blocks"), F.lit(1))).first()[0]
    names = [*ids, "source", "size", "source_size", "target", "whole", "block", "part", "key"]
    dealt = dealt.select(*names)
    first = stage(dealt.groupBy("source", "block").applyInPandas(_settled(0, most_blocks <= 1, seed), dealt.schema), "blocks")
    done = first.where("part in (0, 1)")
    open_rows, left, settled, level = first.where("part not in (0, 1)").select("source", "block", "size", "part", "key"), most_blocks, [], 0
    while left > 1:
        level, left = level + 1, math.ceil(left / block)
        node = F.floor(F.col("block") / block**level)
        out = stage(open_rows.groupBy("source", node.alias("node")).applyInPandas(_dropped(_settled(level, left <= 1, seed)), _UNIT), "node")
        settled.append(out.where("part in (0, 1)"))
        open_rows = out.where("part not in (0, 1)")
    if settled:
        late = settled[0]
        for x in settled[1:]:
            late = late.union(x)
        late = late.select(F.col("source").alias("of"), F.col("block").alias("from"), F.col("part").alias("now"))
        # at most one row of a block is left open, so (source, block) names it
        waiting = first.where("part not in (0, 1)").join(late, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("from")))
        done = done.union(waiting.withColumn("part", F.col("now")).select(*first.columns))
    copies = (F.col("whole") + F.col("part")).cast("long")
    return done.select(*ids, "source", "key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _dropped(settle):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return settle(rows)[["source", "block", "size", "part", "key"]]

    return run


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` (at least ``doc_id, source, text``), each as often as the mix takes it, with all its columns."""
    chosen = decisions(docs, **settings).groupBy("key").agg(F.collect_list("copies").alias("copies"))  # equal rows only share a key
    # the row travels as one value, so no column of it can clash
    keyed = docs.select(F.xxhash64("doc_id", "source", "text").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    nth = F.row_number().over(W.partitionBy("key").orderBy("key"))
    taken = keyed.join(chosen, "key").withColumn("n", F.element_at("copies", nth.cast("int"))).where("n > 0")
    return taken.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")
