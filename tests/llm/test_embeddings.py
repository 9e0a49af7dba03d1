import math

import numpy as np

from pyspark.sql import functions as F

from auditlake.llm import forest, rotation


SCHEMA = "vec_id long, embedding array<float>, label int, d int, block int, low long, rep long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, 1, 1, 1, 1) for i, v, y in rows], SCHEMA)


def odd(rng):
    nan, inf = float("nan"), float("inf")
    v = rng.normal(size=16)
    return [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [nan] * 16, 1), (904, [inf] + [1.0] * 15, 1), (905, [None] + [1.0] * 15, 1), (None, v, 1), (906, v, None), (907, v[:8], 1)]


def test_rotation_links_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16), i % 3) for i in range(150)]
    for group in range(6):  # near copies, copies that are only scaled, and equal vectors
        base = rng.normal(size=16)
        rows += [(200 + 40 * group + k, base + rng.normal(size=16) * 0.02 * (k % 12), group % 2) for k in range(20)]
        rows += [(220 + 40 * group + k, base * (k + 1), group % 2) for k in range(5)] + [(230 + 40 * group + k, base, group % 2) for k in range(4)]
    rows += odd(rng)
    got = rotation.near_duplicates(frame(spark, rows), rotation.Settings(block=8)).collect()
    assert len(got) == len(rows)
    fine = [(i, np.float32(v).astype(float), y) for i, v, y in rows if i is not None and i < 900]
    x = np.stack([v for _, v, _ in fine])
    cosine = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    label = np.array([y for *_, y in fine])
    linked = (cosine >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    ids = np.array([i for i, *_ in fine])
    component = ids.copy()
    for _ in range(len(ids)):
        component = np.minimum(component, np.where(linked, component, 10**9).min(1))
    by_id = {r.vec_id: r for r in got}
    assert {i: (by_id[i].n_links, by_id[i].component_id) for i in ids.tolist()} == {i: (int(n), int(c)) for i, n, c in zip(ids, linked.sum(1), component, strict=True)}
    assert all(by_id[i].n_links == 0 and by_id[i].kept and by_id[i].component_id == i for i in range(900, 908))
    assert by_id[None].n_links == 0 and by_id[None].component_id is None and by_id[None].kept
    assert rotation.near_duplicates(frame(spark, [])).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    rng, s = np.random.default_rng(2), rotation.Settings()
    x = rng.normal(size=(400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.normal(size=x.shape) * 0.1
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    packed, own, wide = rotation._coded(x, 256, s)
    signs = np.unpackbits(packed, axis=1)[:, :256] * 2.0 - 1
    estimate = (signs * (y @ rotation._rotations(32, 256, s.seed).T)).sum(1) / own
    error = estimate - (x * y).sum(1)
    assert abs(error.mean()) < 0.01 and (np.abs(error) <= s.deviations * wide).all()


def test_forest_recall_and_exact_scores(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16), 0) for i in range(1500)]
    x = np.stack([np.float32(v).astype(float) for _, v, _ in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = forest.search(frame(spark, rows), F.col("vec_id") % 50 == 0, 5, forest.Settings(block=400)).collect()
    found = hits = 0
    for q in range(0, 1500, 50):
        cosine = unit @ unit[q]
        cosine[q] = -9
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, *_ in mine] == [1, 2, 3, 4, 5]
        assert all(math.isclose(cosine[i], c, abs_tol=1e-12) for _, i, c in mine) and [c for *_, c in mine] == sorted((c for *_, c in mine), reverse=True)
        hits += len({i for _, i, _ in mine} & set(np.argsort(-cosine)[:5].tolist()))
        found += 5
    assert hits / found >= 0.9


def test_forest_odd_rows_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = odd(rng) + [(0, [1.0] * 16, 1), (0, [1.0] * 16, 1), (7, [2.0] * 16, 1), (3, [3.0] * 16, 1), (50, [1.0] * 15 + [0.0], 2)]
    got = forest.search(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert {r.query_id for r in got} == {0, 50}  # 900 has no vector
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)] == [3, 7, 50, 906]
    assert forest.search(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
