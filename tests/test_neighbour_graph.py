import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditlake.operators import lof
from auditlake.operators.neighbour_graph import GraphSettings, buckets, closest, neighbour_graph
from auditlake.session import materialize
from verification import model_queries


def exact(ids, x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return {i: sorted(zip(d[n], ids, strict=True))[:k] for n, i in enumerate(ids)}


def recall(got, want, k):
    """Share of the true places filled by rows that are as near."""
    hits = 0
    for i, near in want.items():
        mine = sorted(r.distance for r in got if r.provider_id == i)
        hits += sum(a <= b + 1e-9 for a, (b, _) in zip(mine, near, strict=False))
    return hits / (k * len(want))


def clustered(rng, n):
    centres = [[rng.gauss(0, 4) for _ in range(12)] for _ in range(9)]
    return np.array([[rng.gauss(c, 1) for c in centres[int(rng.random() ** 2 * 9)]] for _ in range(n)])


def test_recall_and_bounds_with_many_buckets(spark):
    rng = random.Random(1)
    x = np.r_[clustered(rng, 1500), np.tile([[9.0] * 12], (500, 1))]  # a quarter is one point
    ids = list(range(len(x)))
    frame = materialize(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "provider_id long, x array<double>").repartition(6))
    s = GraphSettings(bucket_rows=64, tables=5)  # 12 dimensions without structure inside a cluster
    sizes = buckets(frame, s).groupBy("table", "bucket").count()
    assert sizes.agg(F.max("count"), F.sum("count")).first()[:] == (sizes.agg(F.max("count")).first()[0], 5 * len(x))
    assert sizes.agg(F.max("count")).first()[0] <= 64
    got = neighbour_graph(frame, 8, s).collect()
    assert len(got) == 8 * len(x)
    by_id = {i: [] for i in ids}
    for r in got:
        by_id[r.provider_id].append(r)
        assert math.isclose(r.distance, math.dist(x[r.provider_id], x[r.neighbour_id]), abs_tol=1e-9)
    want = exact(ids, x, 8)
    share = sum(recall(by_id[i], {i: want[i]}, 8) for i in ids) / len(ids)
    assert share >= 0.9
    # no refinement: fewer are found, so the round does its work
    bare = neighbour_graph(frame, 8, GraphSettings(bucket_rows=64, tables=1, rounds=0)).collect()
    assert sum(a.distance for a in got) < sum(b.distance for b in bare)


def test_hubs_are_met_in_lanes(spark):
    """One row is everyone's neighbour: the rows that ask it are dealt over lanes, with the same graph."""
    rng = np.random.default_rng(4)
    x = np.r_[np.zeros((1, 40)), (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(300, 40)))]
    frame = materialize(spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(x)], "provider_id string, x array<double>"))
    one = neighbour_graph(frame, 3, GraphSettings(bucket_rows=40)).select("provider_id", "neighbour_id", "place").collect()
    lanes = neighbour_graph(frame, 3, GraphSettings(bucket_rows=40, lane_rows=5)).select("provider_id", "neighbour_id", "place").collect()
    assert sorted(one) == sorted(lanes)


def test_few_rows_are_exact_and_edges_are_defined(spark):
    rng = random.Random(2)
    x = np.round(clustered(rng, 60), 1)
    ids = [f"P{i:02d}" for i in range(60)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "provider_id string, x array<double>")
    got = neighbour_graph(frame, 5).collect()
    want = exact(ids, x, 5)
    assert {i: [r.neighbour_id for r in sorted(got, key=lambda r: r.place) if r.provider_id == i] for i in ids} == {i: [n for _, n in near] for i, near in want.items()}
    assert neighbour_graph(frame.limit(1), 5).count() == 0
    assert neighbour_graph(frame.limit(3), 5).count() == 6
    assert neighbour_graph(frame.limit(0), 5).count() == 0


def test_recall_on_the_model_matrix(spark):
    """The providers of the largest test tables, in buckets of a sixteenth of them."""
    sf = "/root/testdata/sf0.1"
    vectors = model_queries._vectors(spark, sf)
    n, k = vectors.count(), 20
    truth = lof.nearest_neighbours(vectors, n, k, 42)
    graph = neighbour_graph(vectors, k, GraphSettings(bucket_rows=64))
    reach = truth.groupBy("provider_id").agg(F.max("distance").alias("reach"))
    found = graph.join(reach, "provider_id").where(F.col("distance") <= F.col("reach") + 1e-9).count()
    assert found / (n * k) >= 0.9
    # and the factors built on it rank providers alike
    a = lof.local_outlier_factor(vectors, n, k, exact=True).withColumnRenamed("lof", "a")
    b = lof.local_outlier_factor(vectors, n, k, graph=GraphSettings(bucket_rows=64)).withColumnRenamed("lof", "b")
    assert a.join(b, "provider_id").agg(F.corr("a", "b")).first()[0] == pytest.approx(1, abs=0.02)


def test_rows_that_meet_in_a_task_take_little_memory():
    """Also where all points are one: then every pair may be among the nearest."""
    n, k = 4096, 5
    for x in (np.random.default_rng(3).normal(size=(n, 6)), np.ones((n, 6))):
        rows = pa.table({"provider_id": pa.array(range(n), pa.int64()), "x": pa.array(list(x), pa.list_(pa.float64()))})
        tracemalloc.start()
        got = closest(rows.slice(0, 500), rows, k)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got.num_rows == 500 * k and peak < 32e6
    ids = got["neighbour_id"].to_numpy().reshape(-1, k)
    assert ids[0].tolist() == [1, 2, 3, 4, 5] and ids[9].tolist() == [0, 1, 2, 3, 4]
