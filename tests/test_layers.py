import math

import numpy as np
import pytest

from auditlake.operators import codemix, peers, rollups, temporal
from auditlake.params import PEER_METRICS, Params
from auditlake.session import materialize

P = Params()


def metric_frame(spark, values, specialty="Cardiology", setting="full_time", metric="avg_billed"):
    rows = []
    for i, v in enumerate(values):
        x = {m: 1.0 for m in PEER_METRICS}
        x[metric] = float(v)
        rows.append((f"P{i}", f"Dr {i}", specialty, setting, f"{specialty} | {setting}", 100.0, *[x[m] for m in PEER_METRICS]))
    cols = ", ".join(f"{m} double" for m in PEER_METRICS)
    return spark.createDataFrame(
        rows, f"provider_id string, provider_name string, specialty string, practice_setting string, cohort_key string, total_billed double, {cols}"
    )


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10])
def test_equal_values_give_zero_never_nan(spark, n):
    out = peers.cohort_z_scores(metric_frame(spark, [7.0] * n), P).collect()
    assert all(r.z_avg_billed == 0.0 for r in out)
    assert all(r.cohort_fallback == (n < 5) for r in out)


def test_mad_z_score(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 100.0]
    out = {r.provider_id: r.z_avg_billed for r in peers.cohort_z_scores(metric_frame(spark, xs), P).collect()}
    med = np.median(xs)
    mad = np.median(abs(np.array(xs) - med))
    assert math.isclose(out["P4"], 0.6745 * (100 - med) / mad)


def test_zero_mad_falls_back_to_plain_z(spark):
    xs = [1.0] * 8 + [9.0]
    out = {r.provider_id: r.z_avg_billed for r in peers.cohort_z_scores(metric_frame(spark, xs), P).collect()}
    assert math.isclose(out["P8"], (9 - np.mean(xs)) / np.std(xs, ddof=1), rel_tol=1e-9)


def test_small_cohort_uses_the_specialty(spark):
    big, small = metric_frame(spark, range(10)), metric_frame(spark, [50.0, 60.0], setting="part_time")
    small = small.withColumn("provider_id", small.provider_id.substr(1, 1)).withColumn("provider_id", peers.F.concat("provider_id", peers.F.monotonically_increasing_id() + 100))
    out = peers.cohort_z_scores(big.unionByName(small), P)
    row = out.where("avg_billed = 60").first()
    both = np.array([*range(10), 50, 60], dtype=float)
    med = np.median(both)
    assert row.cohort_fallback and row.cohort_size == 2
    assert math.isclose(row.z_avg_billed, 0.6745 * (60 - med) / np.median(abs(both - med)))


def scored(spark, z, specialty="Cardiology", metric="avg_billed"):
    df = metric_frame(spark, [5.0], specialty)
    extra = {f"z_{m}": peers.F.lit(z if m == metric else 0.0) for m in PEER_METRICS}
    extra |= {f"{lv}_median_{m}": peers.F.lit(1.0) for lv in ("cohort", "specialty") for m in PEER_METRICS}
    return df.withColumns({**extra, "cohort_size": peers.F.lit(9), "cohort_fallback": peers.F.lit(False)})


@pytest.mark.parametrize("z,hit", [(3.4, 0), (3.5, 0), (3.6, 1), (-9.0, 0)])
def test_flag_threshold_is_strict_and_one_sided(spark, z, hit):
    assert peers.peer_flags(scored(spark, z), P).count() == hit


@pytest.mark.parametrize("z,hit", [(64.0, 0), (65.0, 0), (66.0, 1)])
def test_radiology_volume_override(spark, z, hit):
    assert peers.peer_flags(scored(spark, z, "Radiology", "claims_per_day"), P).count() == hit


def people(spark):
    return spark.createDataFrame([("P1", "Dr", "S", "C")], "provider_id string, provider_name string, specialty string, clinic_id string")


def series(make_claims, counts):
    rows = []
    for m, n in enumerate(counts):
        rows += [{"service_date": f"2024-{m + 1:02d}-05", "patient_id": f"{m}-{i}"} for i in range(n)]
    return rollups.provider_month(rollups.provider_day(make_claims(rows)))


@pytest.mark.parametrize("counts,rows,cusum,spike", [
    ([10, 12], 0, None, None),
    ([10, 12, 11], 1, False, False),
    ([10] * 6, 1, False, False),
    ([10, 11, 12, 13, 14, 15], 1, False, False),
    ([10] * 5 + [100], 1, True, True),
    ([10] * 4 + [35], 1, False, True),
    ([10] * 3 + [40], 1, True, True),
])
def test_temporal_boundaries(spark, make_claims, counts, rows, cusum, spike):
    out = temporal.temporal_scores(series(make_claims, counts), people(spark), P).collect()
    assert len(out) == rows
    if rows:
        assert (out[0].cusum_flag, out[0].spike_flag) == (cusum, spike)


def test_cusum_equals_the_walk(spark, make_claims):
    counts = [5, 9, 3, 4, 8, 8, 2, 7]
    best = s = 0.0
    for a, b in zip(counts, counts[1:], strict=False):
        s = max(0.0, s + (b - a) / a)
        best = max(best, s)
    out = temporal.temporal_scores(series(make_claims, counts), people(spark), P).first()
    assert math.isclose(out.cusum_score, round(best, 4))


def drift(spark, make_claims, mixes):
    rows = []
    for pid, mix in mixes.items():
        for code, n in mix.items():
            rows += [{"provider_id": pid, "fee_code": code, "patient_id": f"{i}"} for i in range(n)]
    claims = make_claims(rows)
    codes = materialize(rollups.provider_code(claims))
    metrics = materialize(peers.provider_metrics(claims, rollups.provider_day(claims), codes, rollups.provider_dim(claims), P))
    return {r.provider_id: r for r in codemix.drift_scores(codes, metrics, P).collect()}


def dense_reference(mixes, eps=1e-9):
    codes = sorted({c for m in mixes.values() for c in m})
    freq = {p: np.array([m.get(c, 0) for c in codes], float) / sum(m.values()) for p, m in mixes.items()}
    ref = np.median(np.stack(list(freq.values())), axis=0)
    out = {}
    for p, f in freq.items():
        a, b = (f + eps) / (f + eps).sum(), (ref + eps) / (ref + eps).sum()
        cos = 1.0 if ref.sum() == 0 else 1 - f @ ref / math.sqrt((f @ f) * (ref @ ref))
        out[p] = ((a * np.log(a / b)).sum(), cos)
    return out


@pytest.mark.parametrize("mixes", [
    {"P1": {"a": 10}},
    {"P1": {"a": 6, "b": 4}, "P2": {"a": 6, "b": 4}, "P3": {"a": 3, "b": 2}},
    {"P1": {"a": 10}, "P2": {"a": 9, "b": 1}, "P3": {"c": 5, "d": 5}, "P4": {"a": 8, "b": 1, "e": 1}},
    {"P1": {"a": 10}, "P2": {"b": 10}, "P3": {"c": 10}},
])
def test_sparse_drift_equals_dense_formula(spark, make_claims, mixes):
    got = drift(spark, make_claims, mixes)
    for pid, (kl, cos) in dense_reference(mixes).items():
        assert math.isclose(got[pid].kl_divergence, round(kl, 6), abs_tol=2e-6)
        assert math.isclose(got[pid].cosine_distance, round(cos, 6), abs_tol=2e-6)
    if "P3" in mixes and "c" in mixes["P3"]:
        assert got["P3"].drift_flag
