"""Approximate nearest neighbours by a hash-prefix forest.

The rows are dealt over blocks; each block keeps, for every tree, a sorted array of long hash strings (the sides of random hyperplanes).
A query descends in each tree to its longest prefix match and then ascends in all trees at once, one bit at a time, until
enough candidates share a prefix with it. Candidates are scored exactly on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from auditlake.llm import vectors
from auditlake.llm.stages import stage

_BITS = 64


@dataclass(frozen=True)
class Settings:
    trees: int = 40
    #: The ascent ends when the candidates of a block are this share of its rows (and ``least`` at any rate).
    share: float = 0.6
    least: int = 64
    #: Rows of an index block, and queries that one task answers on it.
    block: int = 8192
    queries: int = 16_384
    seed: int = 5


@lru_cache(maxsize=4)
def _planes(d: int, s: Settings) -> np.ndarray:
    return np.random.default_rng(s.seed).normal(size=(s.trees * _BITS, d)).astype(np.float32)


def _strings(rows: np.ndarray, centre: np.ndarray, s: Settings) -> np.ndarray:
    """Hash strings (trees x rows) as 64-bit numbers, first bit highest."""
    sides = (rows - centre).astype(np.float32) @ _planes(rows.shape[1], s).T > 0
    return np.packbits(sides.reshape(len(rows), s.trees, _BITS), axis=2).reshape(len(rows), s.trees, 8).view(">u8")[:, :, 0].astype(np.uint64).T


class Forest:
    """The sorted hash strings of one block."""

    def __init__(self, rows: np.ndarray, s: Settings):
        self.s, self.n, self.centre = s, len(rows), rows.mean(0)
        strings = _strings(rows, self.centre, s)
        self.order = np.argsort(strings, 1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def candidates(self, queries: np.ndarray):
        """For each query the places of its candidates."""
        wanted = min(self.n, max(self.s.least, int(self.s.share * self.n)))
        strings = _strings(queries, self.centre, self.s)
        deepest = int(np.ceil(np.log2(self.n + 1))) + 8  # longer common prefixes hold a handful of rows
        low, high = (np.zeros((deepest + 1, self.s.trees, len(queries)), np.int64) for _ in range(2))
        for depth in range(1, deepest + 1):
            rest = np.uint64((1 << (_BITS - depth)) - 1)
            for t in range(self.s.trees):
                low[depth, t] = np.searchsorted(self.sorted[t], strings[t] & ~rest)
                high[depth, t] = np.searchsorted(self.sorted[t], strings[t] | rest, "right")
        high[0] = self.n
        sums = (high - low).sum(1)
        for q in range(len(queries)):
            # the deepest level that can hold enough; from there all trees go up together
            depth = int(np.flatnonzero(sums[:, q] >= wanted).max())
            met = np.zeros(self.n, bool)
            while True:
                for t in range(self.s.trees):
                    met[self.order[t, low[depth, t, q] : high[depth, t, q]]] = True
                places = np.flatnonzero(met)
                if len(places) >= wanted:
                    break
                depth -= 1
            yield places


def _best(ids: np.ndarray, rows: np.ndarray, asked: np.ndarray, queries: np.ndarray, k: int, s: Settings) -> pd.DataFrame:
    rows, queries = vectors.unit(rows), vectors.unit(queries)
    forest, out = Forest(rows, s), []
    for lo in range(0, len(queries), 1024):
        for q, places in zip(range(lo, len(queries)), forest.candidates(queries[lo : lo + 1024]), strict=False):
            places = places[ids[places] != asked[q]]
            score = rows[places] @ queries[q]
            if len(score) > k:
                cut = np.partition(score, len(score) - k)[len(score) - k]
                places, score = places[score >= cut], score[score >= cut]
            order = np.lexsort((ids[places], -score))[:k]
            out.append((np.full(len(order), asked[q]), ids[places][order], score[order]))
    a, b, c = (np.concatenate(x) if out else np.zeros(0) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return pd.DataFrame({"query_id": a.astype(np.int64), "vec_id": b.astype(np.int64), "score": c.astype(float)})


def search(rows: DataFrame, is_query: Column, k: int = 5, s: Settings = Settings()) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each row of ``rows (vec_id, embedding)`` that is a query.

    Nearness is the largest cosine in double precision, ties go to the smaller id; a query's own id is no candidate. Null and zero vectors,
    vectors with null or non-finite components and rows without id take no part; vectors of different lengths do not meet. A query id
    that is repeated is asked once. Fewer candidates than ``k``: all of them. Other columns are ignored; an empty table gives no rows.
    """
    used = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asks")).where(F.col("vec_id").isNotNull() & vectors.usable(F.col("embedding")))
    used = stage(used.withColumn("d", F.size("embedding")), "vectors")
    n, asked = used.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    blocks, lots = max(1, -(-n // s.block)), max(1, -(-asked // s.queries))

    def spread(of: int, over: int, name: str, other: str) -> list[Column]:
        mine = F.pmod(F.xxhash64("vec_id", F.lit(s.seed)), F.lit(of)).cast("int")
        return [mine.alias(name), F.explode(F.sequence(F.lit(0), F.lit(over - 1))).alias(other)]

    index = used.select("d", "vec_id", "embedding", *spread(blocks, lots, "block", "lot")).withColumn("asks", F.lit(False))
    queries = used.where("asks").dropDuplicates(["d", "vec_id"]).select("d", "vec_id", "embedding", *spread(lots, blocks, "lot", "block")).withColumn("asks", F.lit(True))

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        own, other = part[~part["asks"]], part[part["asks"]]
        if not len(own) or not len(other):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return _best(own["vec_id"].to_numpy(), vectors.matrix(own["embedding"]), other["vec_id"].to_numpy(), vectors.matrix(other["embedding"]), k, s)

    found = index.unionByName(queries).groupBy("d", "block", "lot").applyInPandas(answer, "query_id long, vec_id long, score double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.distinct().withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
