"""Approximate nearest neighbours with a bounded number of candidates per row, whatever the number of rows.

Several tables deal all rows into buckets.  A bucket that is too full is split along the line between two of its rows, at
quantiles of the projections, until it fits (rows that no line tells apart are split by hash), so every bucket is one small
task's work.  Each row keeps the nearest rows of its buckets.  Rounds of joins then look at the neighbours of neighbours.
With ``tables`` buckets of ``bucket_rows`` rows and ``rounds`` rounds of ``2 k`` rows around each of ``k`` neighbours, that is
all a row ever meets.  The split points and the graph stay in Spark; nothing passes through the driver but the size of the fullest bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from auditlake.session import materialize


@dataclass(frozen=True)
class GraphSettings:
    tables: int = 6
    bucket_rows: int = 1024
    #: children of a bucket that is split, at most
    fan_out: int = 8
    rounds: int = 8
    #: share of the graph that a round has to change for another one to follow
    settled: float = 0.01
    #: rows that ask one row's neighbours in one task; a row that more rows ask is met by several tasks
    lane_rows: int = 2048
    seed: int = 42


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, by differences in slices so close points keep their precision."""
    out = np.empty((len(a), len(b)))
    step = max(1, 500_000 // max(1, b.size))
    for i in range(0, len(a), step):
        gap = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    x = table["x"]
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy().reshape(len(table), -1)


def _nearest(a: np.ndarray, b: np.ndarray, same: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``a`` up to k nearest rows of ``b``, ties by place: (places, distances), infinite where there are none.

    Products give all distances at once but for rounding, whose bound keeps every row that may be among the k nearest;
    the distances of those rows are then taken by differences.  ``same`` lists pairs that do not count.
    """
    middle = b.mean(axis=0)
    p, q = a - middle, b - middle
    p_square, q_square = np.einsum("ij,ij->i", p, p), np.einsum("ij,ij->i", q, q)
    about = q_square[None, :] - 2.0 * (p @ q.T) + p_square[:, None]
    off = 1e-14 * (a.shape[1] + 8) * (p_square + q_square.max(initial=0.0))
    about[same] = np.inf
    limit = np.partition(about, k - 1, axis=1)[:, k - 1] if k < len(b) else np.full(len(a), np.inf)
    # numbers that are not finite have no bound: then every row is looked at
    row, at = np.nonzero(~(about > (limit + 2.0 * off)[:, None]))
    counted = np.ones(len(row), bool)
    if len(same[0]):
        counted = ~np.isin(row * len(b) + at, same[0] * len(b) + same[1])
    row, at = row[counted], at[counted]
    exact = np.empty(len(row))
    step = max(1, 250_000 // max(1, a.shape[1]))
    for i in range(0, len(row), step):
        gap = a[row[i:i + step]] - b[at[i:i + step]]
        exact[i:i + step] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    order = np.lexsort((at, exact, row))
    row, at, exact = row[order], at[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    near, found = np.full((len(a), k), np.inf), np.zeros((len(a), k), np.int64)
    first = place < k
    near[row[first], place[first]], found[row[first], place[first]] = exact[first], at[first]
    return found, near


#: pairs of rows that a task looks at together; each takes about 50 bytes
_PAIRS = 250_000


def closest(queries: pa.Table, points: pa.Table, k: int) -> pa.Table:
    """Up to k nearest ``points`` of every query (never itself), ties by id; memory is bounded by slices of the queries."""
    q_ids, p_ids = queries["provider_id"].combine_chunks(), points["provider_id"].combine_chunks()
    q_keys, p_keys = q_ids.to_numpy(zero_copy_only=False), p_ids.to_numpy(zero_copy_only=False)
    by_id = np.argsort(p_keys, kind="stable")
    sorted_keys, asking, told = p_keys[by_id], matrix(queries), matrix(points)[by_id]
    # equal ids follow each other in the order of the points
    low, high = np.searchsorted(sorted_keys, q_keys, "left"), np.searchsorted(sorted_keys, q_keys, "right")
    asked, places, distance = [], [], []
    step = max(1, _PAIRS // max(1, len(p_keys)))
    for i in range(0, len(q_keys), step):
        n = (high - low)[i:i + step]
        own = np.repeat(np.arange(len(n)), n)
        shift = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        found, near = _nearest(asking[i:i + step], told, (own, low[i:i + step][own] + shift), k)
        row, at = np.nonzero(np.isfinite(near))
        asked.append(row + i)
        places.append(by_id[found[row, at]])
        distance.append(near[row, at])
    return pa.table({
        "provider_id": q_ids.take(pa.array(np.concatenate(asked or [np.empty(0, np.int64)]))),
        "neighbour_id": p_ids.take(pa.array(np.concatenate(places or [np.empty(0, np.int64)]))),
        "distance": pa.array(np.concatenate(distance or [np.empty(0)]), pa.float64()),
    })


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def buckets(vectors: DataFrame, s: GraphSettings) -> DataFrame:
    """``(provider_id, x, table, bucket)``: every row once per table, at most ``bucket_rows`` rows to a bucket."""
    keyed = vectors.select("provider_id", "x").withColumn("table", F.explode(F.sequence(F.lit(1), F.lit(s.tables))))
    open_rows = keyed.withColumn("bucket", F.lit(0).cast("long"))
    node = ["table", "bucket"]
    done, level = [], 0
    while True:
        level += 1
        drawn = F.xxhash64("provider_id", "table", F.lit(s.seed + level))
        # two rows of the bucket, drawn by hash, span the line that it is split along
        spans = open_rows.groupBy(*node).agg(
            F.count(F.lit(1)).alias("n"), F.min_by("x", drawn).alias("a"), F.max_by("x", drawn).alias("b")
        )
        spans = materialize(spans.select(*node, "n", F.zip_with("a", "b", lambda p, q: q - p).alias("line")))
        fullest = spans.agg(F.max("n")).first()[0] or 0
        small = spans.where(F.col("n") <= s.bucket_rows).select(*node)
        done.append(open_rows.join(small, node).select("provider_id", "x", *node))
        if fullest <= s.bucket_rows:
            break
        told = open_rows.join(spans.where(F.col("n") > s.bucket_rows), node)
        told = materialize(told.withColumn("at", _dot(F.col("x"), F.col("line"))).drop("line"))
        steps = F.array(*[F.lit(i / s.fan_out) for i in range(1, s.fan_out)])
        parts = F.ceil(F.max("n") * 1.2 / F.lit(s.bucket_rows))
        each = F.floor(F.lit(s.fan_out) / F.least(parts, F.lit(s.fan_out))).cast("int")
        cuts = told.groupBy(*node).agg(
            F.percentile_approx("at", steps, 1000).alias("cuts"), each.alias("each"), F.min("at").alias("low"), F.max("at").alias("high")
        )
        # no more children than the rows need: every second or fourth cut of a bucket that is little too full
        cuts = cuts.withColumn("cuts", F.array_distinct(F.filter("cuts", lambda c, i: (i + 1) % F.col("each") == 0)))
        told = told.join(cuts, node)
        parts = F.ceil(F.col("n") / F.lit(s.bucket_rows))
        by_hash = F.pmod(drawn, F.least(parts, F.lit(s.fan_out)))
        # rows that all lie on one point of the line go by hash; a cut at the upper end parts off the rows there
        passed = F.filter("cuts", lambda c: (c < F.col("at")) | ((c == F.col("high")) & (F.col("at") == F.col("high"))))
        child = F.when(F.col("low") == F.col("high"), by_hash).otherwise(F.size(passed))
        path = F.xxhash64("bucket", child, F.lit(level))
        open_rows = materialize(told.select("provider_id", "x", "table", path.alias("bucket")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return materialize(out)


def _best(found: DataFrame, k: int, *smallest: str) -> DataFrame:
    """The k nearest of the pairs found, each once, with their place and the smallest value of other columns."""
    pairs = found.groupBy("provider_id", "neighbour_id").agg(*[F.min(c).alias(c) for c in ("distance", *smallest)])
    order = Window.partitionBy("provider_id").orderBy("distance", "neighbour_id")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _round(vectors: DataFrame, graph: DataFrame, k: int, s: GraphSettings, schema: str) -> DataFrame:
    """Pairs of each row with the rows around its neighbours: their neighbours, and up to k rows that they are neighbours of.

    What lies around a row and the rows that ask for it meet by that row; where many ask, in several lanes.
    """
    asked = graph.join(vectors, "provider_id").select("provider_id", "x", F.col("neighbour_id").alias("via"))
    lanes = asked.groupBy("via").agg(F.ceil(F.count(F.lit(1)) / F.lit(s.lane_rows)).cast("int").alias("lanes"))
    lane = F.pmod(F.xxhash64("provider_id", F.lit(s.seed)), F.col("lanes")).cast("int")
    asked = asked.join(lanes, "via").withColumn("lane", lane).drop("lanes")
    around = graph.select(F.col("provider_id").alias("via"), F.col("neighbour_id").alias("provider_id"))
    nearest = Window.partitionBy("neighbour_id").orderBy("distance", "provider_id")
    back = graph.withColumn("back", F.row_number().over(nearest)).where(F.col("back") <= k)
    around = around.union(back.select(F.col("neighbour_id").alias("via"), "provider_id")).distinct()
    told = around.join(vectors, "provider_id")
    told = told.join(lanes, "via").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    # both sides come from the same vectors: new columns keep them apart
    told = told.select(*[F.col(c).alias(c) for c in ("provider_id", "x", "via", "lane")])
    kind = to_arrow_type(vectors.schema["provider_id"].dataType)
    nothing = pa.table({
        "provider_id": pa.array([], kind), "neighbour_id": pa.array([], kind), "distance": pa.array([], pa.float64()),
    })

    def meet(asking: pa.Table, points: pa.Table) -> pa.Table:
        return closest(asking, points, k) if len(asking) and len(points) else nothing

    return asked.groupBy("via", "lane").cogroup(told.groupBy("via", "lane")).applyInArrow(meet, schema)


def neighbour_graph(vectors: DataFrame, k: int, s: GraphSettings = GraphSettings()) -> DataFrame:
    """``(provider_id, neighbour_id, distance, place)``: about the k nearest neighbours of every row; the distances are exact.

    ``vectors (provider_id, x)`` has one row per id and arrays of one length.  With at most ``bucket_rows`` rows the answer
    is the exact one.  Draws are by hash of the id, so reruns agree.  Fewer than k other rows: all of them.
    """
    vectors = vectors.select("provider_id", "x")
    schema = f"provider_id {dict(vectors.dtypes)['provider_id']}, neighbour_id {dict(vectors.dtypes)['provider_id']}, distance double"
    dealt = buckets(vectors, s)

    def inside(bucket: pa.Table) -> pa.Table:
        return closest(bucket, bucket, k)

    found = dealt.select("table", "bucket", "provider_id", "x").groupBy("table", "bucket").applyInArrow(inside, schema)
    graph = materialize(_best(found, k))
    one_bucket = dealt.select("table", "bucket").distinct().count() <= s.tables
    for _ in range(0 if one_bucket else s.rounds):
        known = graph.select("provider_id", "neighbour_id", "distance").withColumn("fresh", F.lit(0))
        more = _round(vectors, graph, k, s, schema).withColumn("fresh", F.lit(1))
        graph = materialize(_best(known.unionByName(more), k, "fresh"))
        changed, whole = graph.agg(F.coalesce(F.sum("fresh"), F.lit(0)), F.count(F.lit(1))).first()
        graph = graph.drop("fresh")
        if changed <= s.settled * whole:
            break
    return graph
