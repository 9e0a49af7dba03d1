import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.functions import hashing, quantiles, ranking
from auditlake.sources import sinks


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; many ties; a few far outliers."""
    rng = random.Random(3)
    rows = [("hot", round(rng.expovariate(0.2), 1)) for _ in range(3000)]
    rows += [("hot", 0.5)] * 1500 + [("hot", 1e9)] * 3
    rows += [(f"g{i % 40}", rng.gauss(0, 5)) for i in range(500)] + [("one", 4.0), ("two", 1.0), ("two", 2.0)]
    return spark.createDataFrame(rows, "g string, x double").repartition(6)


def test_group_quantiles_equal_numpy(skewed):
    probs = {"p05": 0.05, "q1": 0.25, "med": 0.5, "q3": 0.75, "p95": 0.95}
    got = {r.g: r for r in quantiles.group_quantiles(skewed, ["g"], "x", probs).collect()}
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.g, []).append(r.x)
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g].group_size == len(xs)
        for name, p in probs.items():
            assert math.isclose(got[g][name], float(np.percentile(xs, 100 * p)), rel_tol=1e-12, abs_tol=1e-12)


@pytest.mark.parametrize("stored,full", [(5, 8), (3, 8), (4, 8), (8, 8), (1, 1), (2, 3)])
def test_unstored_zeros_count(spark, stored, full):
    xs = [float(i + 1) for i in range(stored)]
    df = spark.createDataFrame([("a", x, full) for x in xs], "g string, x double, n int")
    row = quantiles.group_quantiles(df, ["g"], "x", {"m": 0.5}, size="n").first()
    assert row.m == float(np.median(xs + [0.0] * (full - stored)))


def test_robust_stats(skewed):
    got = {r.g: r for r in quantiles.robust_stats(skewed, ["g"], "x").collect()}
    xs = np.array([r.x for r in skewed.where("g = 'hot'").collect()])
    assert got["hot"].median == np.median(xs)
    assert math.isclose(got["hot"].mad, np.median(abs(xs - np.median(xs))), rel_tol=1e-12)
    assert math.isclose(got["hot"].deviation, xs.std(ddof=1), rel_tol=1e-9)
    assert got["one"].mad == 0 and got["one"].deviation is None


def test_digits_order_all_kinds_of_numbers(spark):
    """Signs, zeros, tiny and huge numbers, and numbers that differ in the last bit."""
    rng = random.Random(6)
    xs = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, math.inf, -math.inf, 1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0), -1.0]
    xs += [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-300, 300) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    rows = df.select("v", *quantiles._digits(F.col("v"))).collect()
    assert [r.v for r in sorted(rows, key=lambda r: (r._d1, r._d2, r._d3))] == sorted(xs)
    assert all(0 <= d < 1 << 21 for r in rows for d in (r._d2, r._d3)) and all(abs(r._d1) <= 1 << 22 for r in rows)


def test_close_values_are_told_apart(spark):
    up = math.nextafter(1.0, 2)
    close = spark.createDataFrame([("a", up if i % 3 else 1.0) for i in range(99)], "g string, v double")
    row = quantiles.group_quantiles(close, ["g"], "v", {"q": 0.3, "m": 0.5}).first()
    assert (row.q, row.m, row.group_size) == (1.0, up, 99)


def test_counted_quantiles(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", 9.0, 2), ("b", 4.0, 1)], "g string, v double, n int")
    got = {r.g: r.m for r in quantiles.counted_quantiles(df, ["g"], "v", "n", {"m": 0.5}).collect()}
    assert got == {"a": 1.5, "b": 4.0}


def test_global_rank_equals_row_number(spark):
    rng = random.Random(5)
    rows = [(f"P{i:04d}", rng.choice([0.0, 1.5, rng.random() * 100])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, s double").repartition(7)
    got = {r.id: r["rank"] for r in ranking.global_rank(df, "s", "id").collect()}
    want = {pid: i + 1 for i, (pid, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want


def test_equal_scores_are_spread(spark):
    """Nine tenths of the scores are equal: they are split by the tie, and no bin holds more than three times its share."""
    rng = random.Random(8)
    rows = [(f"P{i:05d}", 4.0 if rng.random() < 0.9 else rng.random() * 10) for i in range(20_000)] + [("none", None)]
    df = spark.createDataFrame(rows, "id string, s double").repartition(7)
    bins = ranking.ranged(df, F.col("s").desc_nulls_last(), F.col("id"), bins=16).groupBy("_bin").count().collect()
    assert len(bins) >= 12 and max(r["count"] for r in bins) <= 3 * len(rows) / 16
    got = {r.id: r["rank"] for r in ranking.global_rank(df, "s", "id").collect()}
    assert got == {pid: i + 1 for i, (pid, _) in enumerate(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])))}


def test_ordered_tables_hold_the_order_in_their_files(spark, tmp_path):
    rows = [(i, "x" if i % 2 else "y", float(i % 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "provider_id long, scheme string, estimated_extra_revenue double").repartition(6)
    sinks.write_ordered(df, "findings", str(tmp_path / "out"), ("scheme",))
    names = sorted((tmp_path / "out").glob("part-*.parquet"))
    found = [r for n in names for r in spark.read.parquet(str(n)).collect()]
    assert [r.place for r in found] == list(range(1, 501))
    assert [(r.provider_id, r.estimated_extra_revenue) for r in found] == [(i, x) for i, _, x in sorted(rows, key=lambda r: (-r[2], r[0]))]


def test_global_rank_of_nothing(spark):
    assert ranking.global_rank(spark.createDataFrame([], "id string, s double"), "s", "id").count() == 0


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    a = hashing.table_fingerprint(df).first()[0]
    assert a == hashing.table_fingerprint(df.repartition(5).orderBy(F.desc("id"))).first()[0]
    assert a != hashing.table_fingerprint(df.withColumn("x", F.when(F.col("id") == 7, 0).otherwise(F.col("x")))).first()[0]
    assert a != hashing.table_fingerprint(df.unionByName(df.limit(1)).unionByName(df.limit(1))).first()[0]
