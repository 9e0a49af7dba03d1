"""Near-duplicate embeddings by binary codes of random rotations.

A vector's code are the signs of its coordinates after several random rotations, stored with a correction factor. Slices of the code put likely
partners in one bucket. There, code against rotated vector gives an unbiased estimate of the cosine with a confidence bound; only
pairs whose bound reaches the threshold are computed exactly, on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm import vectors
from auditlake.llm.stages import components, stage


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.98
    #: A pair at the threshold meets in no bucket with at most this probability.
    missed: float = 1e-8
    #: Bucket keys have this many bits more than the rows of a label need numbers.
    spare_bits: int = 2
    #: The confidence bound in standard deviations.
    deviations: float = 6.0
    block: int = 128
    seed: int = 9

    def slices(self, rows: int) -> tuple[int, int]:
        """(bits of a slice, slices) for so many rows that may meet: the bits grow with their logarithm, so that buckets do not."""
        bits = max(8, math.ceil(math.log2(rows + 1)) + self.spare_bits)
        agree = (1 - math.acos(self.threshold) / math.pi) ** bits
        return bits, math.ceil(math.log(self.missed) / math.log1p(-agree))


@lru_cache(maxsize=4)
def _rotations(d: int, bits: int, seed: int) -> np.ndarray:
    """Random rotations of d dimensions, one below the other, at least ``bits`` rows."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(-(-bits // d)):
        q, r = np.linalg.qr(rng.normal(size=(d, d)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out)[: max(bits, d)]


def _coded(unit: np.ndarray, bits: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, correction factors and the estimate's standard deviation for an unrelated direction."""
    d = unit.shape[1]
    turn = _rotations(d, bits, s.seed)
    sides = np.where(unit @ turn.T >= 0, 1.0, -1.0)
    direction = sides @ turn  # the code as a vector
    own = (direction * unit).sum(1)
    across = np.sqrt(np.maximum((direction * direction).sum(1) - own * own, 0))
    return np.packbits(sides > 0, axis=1), own, across / own / math.sqrt(max(d - 1, 1))


def _slices(codes: np.ndarray, bits: int, count: int) -> np.ndarray:
    """Bucket keys (rows x slices) of unpacked codes."""
    weight = (np.uint64(1) << np.arange(bits, dtype=np.uint64))[None, None, :]
    return (codes[:, : bits * count].reshape(len(codes), count, bits).astype(np.uint64) * weight).sum(2, dtype=np.uint64)


def _linked(rows: pd.DataFrame, bits: int, count: int, s: Settings) -> Iterator[tuple[int, int, int]]:
    """(rep, links, other): links of each row counted once over all buckets, and a forest that joins what is linked."""
    rows = rows.sort_values(["bucket", "i", "j", "rep"], kind="stable").drop_duplicates(["bucket", "i", "j", "rep", "low"])
    vec = vectors.matrix(rows["embedding"])
    size = np.sqrt((vec * vec).sum(1))
    turned = vectors.unit(vec) @ _rotations(vec.shape[1], bits * count, s.seed).T
    codes = np.unpackbits(np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1), axis=1)[:, : turned.shape[1]]
    signs, keys = codes.astype(np.float32) * 2 - 1, _slices(codes, bits, count)
    turned = turned.astype(np.float32)
    own, wide = rows["own"].to_numpy(), rows["wide"].to_numpy()
    rep, many, block, number = (rows[x].to_numpy() for x in ("rep", "many", "block", "slice"))
    cell = rows[["bucket", "i", "j"]].to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(cell, axis=0) != 0).any(1)) + 1), len(rows)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi - lo < 2:
            continue
        estimate = signs[lo:hi] @ turned[lo:hi].T / own[lo:hi, None]
        may = estimate + s.deviations * wide[lo:hi, None] >= s.threshold
        np.fill_diagonal(may, False)
        if cell[lo][1] != cell[lo][2]:  # rows of one block meet in that block's own cell
            may &= block[lo:hi, None] != block[None, lo:hi]
        a, b = np.nonzero(np.triu(may | may.T))
        if not len(a):
            continue
        a, b = a + lo, b + lo
        first = np.argmax(keys[a] == keys[b], axis=1) == number[lo]  # counted in the first slice that the two share
        a, b = a[first], b[first]
        with np.errstate(all="ignore"):
            cosine = np.einsum("ij,ij->i", vec[a], vec[b]) / (size[a] * size[b])
            odd = ~np.isfinite(cosine) | (size[a] * size[b] < 1e-280)
        if odd.any():
            cosine[odd] = (vectors.unit(vec[a[odd]]) * vectors.unit(vec[b[odd]])).sum(1)
        a, b = a[cosine >= s.threshold], b[cosine >= s.threshold]
        links = np.zeros(hi - lo, np.int64)
        np.add.at(links, a - lo, many[b])
        np.add.at(links, b - lo, many[a])
        root = list(range(hi - lo))

        def find(x: int, root: list[int] = root) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for x, y in zip((a - lo).tolist(), (b - lo).tolist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        for x in np.flatnonzero(links).tolist():
            yield rep[lo + x], links[x], rep[lo + find(x)]


def near_duplicates(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``rows (vec_id, embedding, label)``.

    Rows are linked if their labels are equal and not null and their cosine is at least the threshold; ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable. Null and zero vectors, vectors with null or non-finite components and rows without id or label
    have no links; vectors of different lengths do not meet. Equal vectors of a label are one node with a count. Rows
    without id have a null component and are kept. Rows that repeat an id share their component. Other columns are ignored.
    """
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vectors.usable(F.col("embedding"))
    base = base.withColumn("low", F.when(fine, F.xxhash64("label", "embedding"))).withColumn("high", F.when(fine, F.xxhash64(F.lit(s.seed), "embedding", "label")))
    base = stage(base.withColumn("d", F.size("embedding")), "vectors")
    used = base.where("low is not null")
    classes = stage(used.groupBy("low", "high").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many")), "classes")
    nodes = used.join(classes, ["low", "high"]).where("vec_id = rep").dropDuplicates(["low", "high"])
    most = used.groupBy("label", "d").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    bits, count = s.slices(most)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            out = pd.DataFrame({"code": None, "own": 0.0, "wide": 0.0, "slices": None}, index=frame.index, dtype=object)
            for _, same in frame.groupby("d"):
                packed, own, wide = _coded(vectors.unit(vectors.matrix(same["embedding"])), bits * count, s)
                keys = _slices(np.unpackbits(packed, axis=1), bits, count).view(np.int64)
                for k, i in enumerate(same.index):
                    out.at[i, "code"], out.at[i, "own"], out.at[i, "wide"], out.at[i, "slices"] = packed[k].tobytes(), own[k], wide[k], keys[k]
            yield pa.RecordBatch.from_arrays(
                [batch["rep"], batch["low"], batch["d"], batch["many"], batch["label"], batch["embedding"], pa.array(out["code"], pa.binary()),
                 pa.array(out["own"].astype(float)), pa.array(out["wide"].astype(float)), pa.array(list(out["slices"]), pa.list_(pa.int64()))],
                names=["rep", "low", "d", "many", "label", "embedding", "code", "own", "wide", "slices"],
            )

    kinds = dict(base.dtypes)
    nodes = nodes.select("rep", "low", "d", "many", "label", "embedding").mapInArrow(
        code, f"rep long, low long, d int, many long, label {kinds['label']}, embedding {kinds['embedding']}, code binary, own double, wide double, slices array<long>"
    )
    nodes = stage(nodes, "nodes")
    met = nodes.select("rep", "low", "d", "label", F.posexplode("slices").alias("slice", "key"))
    met = met.select("rep", "low", "slice", F.xxhash64("label", "d", "slice", "key").alias("bucket"))
    full = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / s.block).cast("int"))
    hits = met.join(full, "bucket").withColumn("block", F.pmod(F.xxhash64("rep", "low"), "blocks").cast("int"))
    hits = hits.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hits = hits.select("rep", "low", "slice", "bucket", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    hits = stage(hits, "hits")
    tasks = max(1, hits.count() // 8192)
    cells = hits.join(nodes.drop("slices", "label"), ["rep", "low"]).withColumn("deal", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(tasks)))

    def link(part: pd.DataFrame) -> pd.DataFrame:
        found = [x for _, same in part.groupby("d") for x in _linked(same, bits, count, s)]
        return pd.DataFrame(found, columns=["rep", "links", "other"]).astype({"rep": "int64", "links": "int64", "other": "int64"})

    found = stage(cells.groupBy("deal").applyInPandas(link, "rep long, links long, other long"), "links")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "of")
    named = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    out = base.select("vec_id", "low", "high").join(classes, ["low", "high"], "left")
    out = out.join(sums, out["rep"] == sums["of"], "left").join(named, out["rep"] == named["id"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "rep", "vec_id"))
    return out.select(
        "vec_id", (F.coalesce(F.col("many") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
