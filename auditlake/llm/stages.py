"""Stage tables in the shared folder, and connected components over verified links."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from auditlake.session import shared_dir


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    It cuts the lineage: an executor lost later repeats nothing before this point, and later readers get column
    pruning and pushed filters. The folder is named afresh each time, so a retried run never reads half a table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Links that a task contracts at once.
_LOT = 200_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``(u, v)`` as stars around the smallest id of each piece that a lot of them forms."""

    def stars(lot: list[pa.RecordBatch]) -> pa.RecordBatch:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root.setdefault(up, up)
            return x

        for batch in lot:
            for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
                a, b = find(u), find(v)
                root[max(a, b)] = min(a, b)
        out = [(x, r) for x in list(root) if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], names=["u", "v"])

    lot, size = [], 0
    for batch in batches:
        lot.append(batch)
        size += len(batch)
        if size >= _LOT:
            yield stars(lot)
            lot, size = [], 0
    if lot:
        yield stars(lot)


#: A key with more than this share of the links is joined by broadcast: there are at most twice as many such keys as the share's inverse.
_HOT = 1 / 256


def _least(edges: DataFrame, n: int) -> DataFrame:
    """``edges (u, v)`` with ``m``, the smallest of ``u`` and its neighbours.

    The minima are summed up in the tasks first. They reach the edges of frequent keys by broadcast (at most 512 rows, as ``edges`` holds at most ``2 n``),
    the others by a join, so no task gets all edges of a star's centre.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("d"))
    hot = least.where(F.col("d") > max(16, int(n * _HOT))).select("u", F.col("m").alias("hot_m"))
    told = edges.join(F.broadcast(hot), "u", "left")
    cold = told.where("hot_m is null").select("u", "v").join(least.select("u", "m"), "u")
    return cold.select("u", "v", "m").union(told.where("hot_m is not null").select("u", "v", "hot_m"))


def components(links: DataFrame, lot: int = _LOT) -> DataFrame:
    """``(id, component_id)`` of every id in ``links (a, b)``: the smallest id reachable.

    Tasks first contract the links they hold. If at most ``lot`` links are left, one task contracts these. Otherwise rounds of large-star and
    small-star follow: each id's neighbours are hung on its smallest one, which halves the depth of the trees, so the rounds grow with the
    logarithm of the longest chain. A star's centre is met once per neighbour, never with all its neighbours in one buffer or one task. Ends when a
    round changes nothing. Both ways give the same answer.
    """
    edges = links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v").mapInArrow(_contracted, "u long, v long")
    edges, before = _counted(edges)
    if 0 < before[0] <= lot:
        edges, before = stage(edges.coalesce(1).mapInArrow(_contracted, "u long, v long"), "links"), (0,)
    while before[0]:
        # large star: every larger neighbour hangs on the smallest of the neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the smaller neighbours and the id itself hang on the smallest
        hung = _least(large, before[0]).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges, state = _counted(hung.where("u <> v").distinct())
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a stage table, with their number and a sum of their hashes taken while it was written."""
    seen = Observation()
    table = stage(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "links")
    return table, (seen.get["n"], seen.get["h"])
