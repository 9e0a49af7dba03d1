import itertools
import math
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditlake.operators import attribution, ensemble, feedback, isolation_forest, lof, neighbour_graph, ocsvm, privacy, registry
from auditlake.params import Params
from auditlake.session import materialize

P = Params(forest_trees=60, forest_sample=64, lof_neighbours=6)


@pytest.fixture(scope="module")
def points(spark):
    """Two clusters of very different size, duplicates, and five planted outliers."""
    rng = random.Random(11)
    rows = [(f"a{i:03d}", [rng.gauss(0, 1), rng.gauss(0, 1), 0.0]) for i in range(140)]
    rows += [(f"b{i:03d}", [rng.gauss(12, 0.5), rng.gauss(0, 0.5), 1.0]) for i in range(40)]
    rows += [(f"d{i}", [0.25, 0.25, 0.0]) for i in range(12)]
    rows += [(f"z{i}", [30.0 + 9 * i, -25.0 - 7 * i, 5.0]) for i in range(5)]
    return materialize(spark.createDataFrame(rows, "provider_id string, x array<double>").repartition(5))


def brute_lof(rows, k):
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = {}
    for i, pid in enumerate(ids):
        near[pid] = sorted((d[i, j], ids[j]) for j in range(len(ids)) if j != i)[:k]
    reach = {p: n[-1][0] for p, n in near.items()}
    dens = {p: 1 / (np.mean([max(dd, reach[o]) for dd, o in n]) + 1e-10) for p, n in near.items()}
    return near, {p: np.mean([dens[o] for _, o in n]) / dens[p] for p, n in near.items()}


@pytest.mark.parametrize("block_rows", [7, 32, 4096])
def test_pruned_neighbours_equal_all_pairs(points, block_rows):
    rows = {r.provider_id: r.x for r in points.collect()}
    near, factors = brute_lof(rows, 6)
    got = {}
    for r in lof.nearest_neighbours(points, len(rows), 6, 1, block_rows).collect():
        got.setdefault(r.provider_id, []).append((r.distance, r.neighbour_id))
    assert {p: [o for _, o in sorted(n)] for p, n in got.items()} == {p: [o for _, o in n] for p, n in near.items()}
    for r in lof.local_outlier_factor(points, len(rows), 6, 1, block_rows, exact=True).collect():
        assert math.isclose(r.lof, factors[r.provider_id], rel_tol=1e-9)


@pytest.mark.parametrize("tile_rows", [9, 40, 1000])
def test_tiles_do_not_change_the_neighbours(points, tile_rows):
    """Blocks far smaller than a tile, and cells larger than one."""
    rows = {r.provider_id: r.x for r in points.collect()}
    near, _ = brute_lof(rows, 6)
    got = {}
    for r in lof.nearest_neighbours(points, len(rows), 6, 1, 5, tile_rows).collect():
        got.setdefault(r.provider_id, []).append((r.place, r.neighbour_id))
    assert {p: [o for _, o in sorted(n)] for p, n in got.items()} == {p: [o for _, o in n] for p, n in near.items()}


def test_cells_share_and_fill_tiles():
    centres = np.arange(6.0)[:, None]
    tiles = lof._tiles(centres, np.array([3, 4, 25, 2, 2, 9]), 10)
    assert tiles == [(0, 1), (0, 1), (1, 3), (4, 1), (4, 1), (5, 1)]


def test_the_nearest_rows_are_found_in_slices():
    """Memory follows the slice, not queries times rows; far and equal rows keep their exact distances and ties."""
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=(2000, 8)), 1e7 + rng.normal(size=(1500, 8)) * 1e-3, np.full((500, 8), 3.0)]
    ids = rng.permutation(len(x))
    table = pa.table({"provider_id": pa.array(ids), "x": pa.array(list(x), pa.list_(pa.float64()))})
    tracemalloc.start()
    got = neighbour_graph.closest(table, table, 5).to_pandas()
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
    assert len(got) == 5 * len(x)
    place = np.argsort(ids)
    by_id = x[place]
    for one in (ids[0], ids[1999], ids[2000], ids[3499], ids[3500], ids[-1]):
        d = np.sqrt(((by_id - by_id[one]) ** 2).sum(axis=1))
        want = sorted((v, i) for i, v in enumerate(d) if i != one)[:5]
        mine = got[got.provider_id == one]
        assert mine.neighbour_id.tolist() == [i for _, i in want]
        assert np.allclose(mine.distance, [v for v, _ in want], rtol=1e-12)


def top(df, column, n):
    return {r.provider_id for r in df.orderBy(column).limit(n).collect()}


def test_forest_finds_planted_outliers_and_repeats(points):
    n = points.count()
    trees = isolation_forest.fit_forest(points, n, P)
    assert len(trees) == P.forest_trees
    scores = isolation_forest.forest_scores(points, trees, n, P)
    assert {f"z{i}" for i in range(5)} <= top(scores, "score_samples", 10)
    again = isolation_forest.fit_forest(points.repartition(3), n, P)
    assert all(np.array_equal(a["threshold"], b["threshold"]) for a, b in zip(trees, again, strict=True))


def test_svm_flags_its_share(points):
    n = points.count()
    w = ocsvm.fit_svm(points, n, 3, 0.1, P)
    out = ocsvm.svm_scores(points, w, 3, 0.1, P)
    assert out.where("decision < 0").count() <= math.ceil(0.1 * n)
    assert {f"z{i}" for i in range(5)} & top(out, "decision", 20)


@pytest.mark.parametrize("nu", [0.1, 0.4])
def test_svm_reaches_the_optimum(points, nu):
    """Against the dual solved by brute force: pairs of rows exchange weight until none gains."""
    params = Params(svm_features=24, svm_tolerance=1e-3, svm_steps=200)
    x = np.array([r.x for r in points.collect()])
    z = ocsvm._projector(3, params)(x)
    n, most = len(z), 1 / (nu * len(z))
    alpha, gram = np.full(n, 1 / n), z @ z.T
    slope = gram @ alpha
    for _ in range(200_000):
        to = int(np.argmin(np.where(alpha < most, slope, np.inf)))
        off = int(np.argmax(np.where(alpha > 0, slope, -np.inf)))
        if slope[off] - slope[to] < 1e-10:
            break
        curve = max(gram[to, to] + gram[off, off] - 2 * gram[to, off], 1e-12)
        move = min(alpha[off], most - alpha[to], (slope[off] - slope[to]) / curve)
        alpha[to], alpha[off] = alpha[to] + move, alpha[off] - move
        slope = slope + move * (gram[to] - gram[off])
    best = alpha @ slope

    def objective(w):
        m = z @ w
        rho = np.sort(m)[int(np.ceil(nu * n)) - 1]
        return w @ w / 2 - rho + np.maximum(0, rho - m).sum() / (nu * n)

    w = ocsvm.fit_svm(points, n, 3, nu, params)
    assert w @ w == pytest.approx(best, rel=5e-3)
    assert objective(w) <= -best / 2 + 5e-3 * best  # strong duality


def test_attributions_add_up(points):
    n = points.count()
    trees = isolation_forest.fit_forest(points, n, P)
    rows = points.where(F.col("provider_id").isin("z0", "a001", "d3"))
    got = attribution.attributions(rows, trees, ["f0", "f1", "f2"]).groupBy("provider_id").agg(F.sum("contribution").alias("s")).collect()
    x = {r.provider_id: np.array([r.x]) for r in rows.collect()}

    def length(tree, leaf):
        return tree["depth"][leaf] + isolation_forest.expected_path(tree["rows"][leaf])

    mean = np.mean([
        sum(value * np.prod([s for *_, s in path]) for value, path in attribution.leaf_rules(t)) for t in trees
    ])
    for r in got:
        own = np.mean([length(t, isolation_forest.leaf_of(t, x[r.provider_id]))[0] for t in trees])
        assert math.isclose(r.s, mean - own, rel_tol=1e-9, abs_tol=1e-9)


def test_shapley_equals_enumeration():
    tree = {
        "feature": np.array([0, 1, -1, -1, 0, -1, -1]), "threshold": np.array([0.5, 0.3, 0, 0, 0.8, 0, 0]),
        "low": np.array([1, 2, -1, -1, 5, -1, -1]), "high": np.array([4, 3, -1, -1, 6, -1, -1]),
        "rows": np.array([10, 6, 2, 4, 4, 1, 3]), "depth": np.array([0, 1, 2, 2, 1, 2, 2]),
    }

    def value(known, x, node=0):
        f = tree["feature"][node]
        if f < 0:
            return tree["depth"][node] + float(isolation_forest.expected_path(np.array([tree["rows"][node]]))[0])
        lo, hi = tree["low"][node], tree["high"][node]
        if f in known:
            return value(known, x, lo if x[f] <= tree["threshold"][node] else hi)
        n = tree["rows"][node]
        return (tree["rows"][lo] * value(known, x, lo) + tree["rows"][hi] * value(known, x, hi)) / n

    for x in ([0.2, 0.1], [0.2, 0.9], [0.6, 0.1], [0.9, 0.9]):
        got = attribution.shapley(tree, np.array([x]))[0]
        both, f0, f1, none = value({0, 1}, x), value({0}, x), value({1}, x), value(set(), x)
        assert got == pytest.approx([((f0 - none) + (both - f1)) / 2, ((f1 - none) + (both - f0)) / 2])


def subsets_shapley(tree, row):
    """Each leaf as a product game, by enumeration of all subsets."""
    out = np.zeros(len(row))
    for value, path in attribution.leaf_rules(tree):
        parts = [(float(lo < row[f] <= hi), share) for f, lo, hi, share in path]
        n = len(parts)
        for i in range(n):
            others = [j for j in range(n) if j != i]
            for size in range(n):
                weight = math.factorial(size) * math.factorial(n - 1 - size) / math.factorial(n)
                for known in itertools.combinations(others, size):
                    product = math.prod(parts[j][0] if j in known else parts[j][1] for j in others)
                    out[path[i][0]] += weight * value * (parts[i][0] - parts[i][1]) * product
    return out


@pytest.mark.parametrize("rows", [3, 1500])
def test_shapley_of_grown_trees(rows):
    """Looked-up patterns, rows taken one by one where patterns outnumber them, and several lots of rows."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 9))
    tree = {k: np.asarray(v) for k, v in isolation_forest._grow(x[:200], rng, 9).items()}
    assert max(len(path) for _, path in attribution.leaf_rules(tree)) >= 7
    got = attribution.shapley(tree, x[:rows])
    for i in (0, rows // 2, rows - 1):
        assert got[i] == pytest.approx(subsets_shapley(tree, x[i]), rel=1e-9, abs=1e-12)


def test_shapley_costs_a_row_few_steps():
    """Work on rows is a look-up per leaf and feature, not a polynomial per pair of features."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4096, 37))
    tree = {k: np.asarray(v) for k, v in isolation_forest._grow(x[:256], rng, 8).items()}
    polynomials = sum(len(path) ** 2 for _, path in attribution.leaf_rules(tree))
    begun = time.process_time()
    attribution.shapley(tree, x)
    assert time.process_time() - begun < polynomials * len(x) * 3e-8


def test_consensus_votes(spark):
    rows = [(f"P{i}", -float(i == 9) * 5 - i / 100, -float(i == 9) * 3 - i / 100, 1.0 if i else -1.0) for i in range(10)]
    raw = materialize(spark.createDataFrame(rows, "provider_id string, if_raw double, lof_raw double, ocsvm_raw double"))
    got = {r.provider_id: r for r in ensemble.consensus(raw, 0.1, P).collect()}
    assert got["P9"].ml_is_anomaly == 1 and got["P9"].vote_count == 2 and got["P9"].if_score == 100.0
    assert got["P0"].ml_is_anomaly == 0 and got["P0"].vote_count == 1


def labelled(spark, n=40):
    rows = [(f"P{i}", "confirmed" if i % 2 else "cleared", i % 2, *[float(i % 2) * 3 + (i * 7 % 5) / 5 for _ in feedback.FEATURES]) for i in range(n)]
    cols = ", ".join(f"{c} double" for c in feedback.FEATURES)
    return spark.createDataFrame(rows, f"provider_id string, outcome string, label int, {cols}").coalesce(1)


def test_feedback_needs_labels_and_two_classes(spark):
    assert feedback.fit_feedback(labelled(spark, 5), P) is None
    assert feedback.fit_feedback(labelled(spark).where("label = 1"), P) is None


def test_feedback_scores_only_above_half(spark):
    data = labelled(spark)
    model = feedback.fit_feedback(data, P, "logistic")
    got = {r.provider_id: r for r in feedback.feedback_scores(model, data, P).collect()}
    assert got["P1"].feedback_label == 1 and 0 < got["P1"].feedback_score <= 10
    assert got["P0"].feedback_label == 0 and got["P0"].feedback_score == 0.0
    held = feedback.holdout_split(data, P).where("held_out").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in held} == {0: 4, 1: 4}


def mixed_labels(spark, n=300):
    """Labels that follow two features with noise; a third is constant, a fourth repeats the first."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in feedback.FEATURES]
        x[2], x[3] = 7.0, x[0]
        label = int(x[0] + 0.5 * x[1] ** 2 + rng.gauss(0, 0.7) > 0.4)
        rows.append((f"P{i}", "confirmed" if label else "cleared", label, *x))
    cols = ", ".join(f"{c} double" for c in feedback.FEATURES)
    return rows, spark.createDataFrame(rows, f"provider_id string, outcome string, label int, {cols}").repartition(4)


def test_logistic_model_is_the_ridge_optimum(spark):
    rows, data = mixed_labels(spark)
    model = feedback.fit_feedback(data, P, "logistic")
    x, y = np.array([r[3:] for r in rows]), np.array([r[2] for r in rows])
    scale = np.where(x.std(0) > 0, x.std(0), 1)
    z = np.c_[(x - x.mean(0)) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.array([1.0] * (z.shape[1] - 1) + [0.0])
    for _ in range(4000):  # plain gradient descent
        w -= 0.02 * (z.T @ (1 / (1 + np.exp(-z @ w)) - y) + ridge * w)
    p = 1 / (1 + np.exp(-z @ w))
    got = {r.provider_id: r.p for r in data.select("provider_id", model.probability().alias("p")).collect()}
    assert np.allclose([got[r[0]] for r in rows], p, atol=1e-6)


def test_boosted_model_is_plain_gradient_boosting(spark):
    params = Params(feedback_trees=8)
    rows, data = mixed_labels(spark)
    x, y = np.array([r[3:] for r in rows]), np.array([r[2] for r in rows], float)

    def grown(inside, g, h, depth):
        """Every feature and cut tried by brute force."""
        best = (0.0, None, None)
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        for j in range(x.shape[1]) if depth < 3 else ():
            values = np.unique(x[inside, j])
            for cut in (values[1:] + values[:-1]) / 2:
                low, high = inside & (x[:, j] < cut), inside & (x[:, j] >= cut)
                gain = score(low) + score(high) - score(inside)
                if min(h[low].sum(), h[high].sum()) >= 1 and gain > best[0] + 1e-9:
                    best = (gain, low, high)
        if best[1] is None:
            return [(inside, -0.1 * g[inside].sum() / (h[inside].sum() + 1))]
        return grown(best[1], g, h, depth + 1) + grown(best[2], g, h, depth + 1)

    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for _ in range(8):
        p = 1 / (1 + np.exp(-margin))
        for inside, value in grown(np.ones(len(y), bool), p - y, p * (1 - p), 0):
            margin[inside] += value
    model = feedback.fit_feedback(data, params, "boosted")
    got = {r.provider_id: r.m for r in data.select("provider_id", model.margin().alias("m")).collect()}
    assert np.allclose([got[r[0]] for r in rows], margin, atol=1e-9)
    again = feedback.FeedbackModel.read(model.table(spark).repartition(3))
    assert again == model


def test_holdout_takes_the_smallest_hashes_of_each_class(spark, monkeypatch):
    data = mixed_labels(spark)[1]
    ranked = data.select("provider_id", "label", F.xxhash64("provider_id", F.lit(P.seed)).alias("h")).collect()
    want = set()
    for label in (0, 1):
        some = sorted((r for r in ranked if r.label == label), key=lambda r: r.h)
        want |= {r.provider_id for r in some[: round(len(some) * 0.2)]}
    got = feedback.holdout_split(data, P)
    assert {r.provider_id for r in got.where("held_out").collect()} == want
    assert got.count() == 300 and got.columns == [*data.columns, "held_out"]


def test_latest_disposition_and_vocabulary(spark):
    rows = spark.createDataFrame([(1, "A", "confirmed"), (3, "A", "cleared"), (2, "B", "confirmed")], "seq long, provider_id string, outcome string")
    assert {r.provider_id: r.label for r in feedback.latest_dispositions(rows).collect()} == {"A": 0, "B": 1}
    with pytest.raises(Exception, match="unknown outcome"):
        feedback.checked_dispositions(rows.withColumn("outcome", F.lit("maybe"))).collect()


def test_registry_versions(spark, tmp_path):
    data, base = labelled(spark), str(tmp_path / "registry")
    model = feedback.fit_feedback(data, P, "logistic")
    assert registry.current_version(spark, base).count() == 0
    assert [registry.register(model, data, P, base, "logistic") for _ in range(2)] == ["v001", "v002"]
    row = registry.current_version(spark, base).first()
    assert row.version_id == "v002" and row.n_confirmed == 20 and row.method == "stratified_80_20_split_proxy"
    again = feedback.feedback_scores(registry.load_version(spark, base, "v001"), data, P).collect()
    assert sorted(again) == sorted(feedback.feedback_scores(model, data, P).collect())
    assert registry.list_versions(spark, base).select("training_data_hash").distinct().count() == 1


def test_noise_is_reproducible_and_scaled(spark):
    values = materialize(spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("v")))
    a = privacy.with_noise(values, "v", ["k"], P)
    b = privacy.with_noise(values.repartition(7), "v", ["k"], P)
    assert a.join(b.select("k", F.col("noisy").alias("n2")), "k").where("noisy <> n2").count() == 0
    row = a.agg(F.avg(F.abs(F.col("noisy") - F.col("v"))).alias("m"), F.max("sensitivity").alias("s")).first()
    assert row.s == 9.0 and row.m == pytest.approx(9.0, rel=0.1)
    none = privacy.sensitivity(values.where("v < 0"), "v", P).first().sensitivity
    tiny = privacy.sensitivity(values.select((F.col("v") * 0).alias("v")), "v", P).first().sensitivity
    assert (none, tiny) == (1.0, 1e-3)
