import pytest
from pyspark.sql import functions as F

from auditlake.operators import dashboard, scoring
from auditlake.params import Params
from auditlake.session import materialize

P = Params()
FLAG = "provider_id string, provider_name string, specialty string, rule string, evidence string, estimated_exposure double"


def spine(spark, ids=("A",), billed=1000.0):
    return spark.createDataFrame([(i, f"Dr {i}", "S", billed) for i in ids], "provider_id string, provider_name string, specialty string, total_billed double")


def peers(spark, rows):
    return spark.createDataFrame(rows, "provider_id string, metric string, z_score double, estimated_exposure double")


def flags(spark, rules):
    return spark.createDataFrame([("A", "Dr", "S", r, "e", 100.0) for r in rules], FLAG)


@pytest.mark.parametrize("rules,points", [([], 0), (["unbundling"], 30), (["impossible_day"], 40), (["impossible_day", "duplicate_billing"], 50), (["new_rule"], 25)])
def test_rule_points_are_capped(spark, rules, points):
    row = scoring.risk_scores(spine(spark), flags(spark, rules), peers(spark, []), P).first()
    assert row.rules_score == points and row.risk_score == points


@pytest.mark.parametrize("z,points", [(3.6, 5.2), (6.0, 10.0), (50.0, 10.0)])
def test_peer_points(spark, z, points):
    row = scoring.risk_scores(spine(spark), flags(spark, []), peers(spark, [("A", "avg_billed", z, 9.0)]), P).first()
    assert row.peer_score == pytest.approx(points)
    assert row.estimated_exposure == 9.0


def test_peer_cap_and_exposure_per_metric(spark):
    rows = [("A", f"m{i}", 9.0, 100.0) for i in range(4)]
    row = scoring.peer_component(peers(spark, rows), P).first()
    assert (row.peer_score, row.peer_exposure, row.peer_exposure_max, row.peer_reasons) == (25.0, 400.0, 100.0, "m0; m1; m2; m3")


@pytest.mark.parametrize("rules,stats,ml,tier", [(30, 0, 0, "HIGH"), (0, 2, 0, "MEDIUM"), (0, 1, 1, "MEDIUM"), (0, 1, 0, "LOW"), (0, 0, 1, "LOW")])
def test_confidence_tiers(spark, rules, stats, ml, tier):
    df = spark.createDataFrame(
        [(float(rules), float(stats > 0), int(stats > 1), 0, ml, 1000.0)],
        "rules_score double, peer_score double, codemix_flag int, temporal_flag int, ml_is_anomaly int, estimated_exposure double",
    )
    row = scoring.with_tier_and_recovery(df, P).first()
    assert row.confidence == tier
    assert row.expected_recovery == {"HIGH": 700.0, "MEDIUM": 400.0, "LOW": 150.0}[tier]


def test_total_is_capped_and_fallback_exposure(spark):
    ml = spark.createDataFrame([("A", 100.0, 1)], "provider_id string, ml_score double, ml_is_anomaly int")
    drift = spark.createDataFrame([("A", 5.0, 0.5, True)], "provider_id string, kl_divergence double, cosine_distance double, drift_flag boolean")
    change = spark.createDataFrame([("A", 9.0, True, True)], "provider_id string, cusum_score double, spike_flag boolean, temporal_flag boolean")
    learnt = spark.createDataFrame([("A", 10.0, 1)], "provider_id string, feedback_score double, feedback_label int")
    many = peers(spark, [("A", f"m{i}", 9.0, 100.0) for i in range(4)])
    row = scoring.risk_scores(spine(spark), flags(spark, ["impossible_day", "unbundling"]), many, P, ml, drift, change, learnt).first()
    assert row.risk_score == 100.0
    assert row.top_reason.startswith("Rule: impossible_day; unbundling | Peer z>3: m0; m1; m2; m3 | ML anomaly score 100/100 | Code-mix drift KL=5.000")
    alone = scoring.risk_scores(spine(spark), flags(spark, []), peers(spark, []), P).first()
    assert (alone.estimated_exposure, alone.top_reason, alone.confidence) == (100.0, "no flags", "LOW")


def test_worklist_threshold_order_and_rank(spark):
    ids = [f"P{i}" for i in range(30)]
    rows = [(i, "Dr", "S", "impossible_day" if n % 2 else "x", "e", float(n % 5) * 1000) for n, i in enumerate(ids[:28])]
    scores = materialize(scoring.risk_scores(spine(spark, ids), spark.createDataFrame(rows, FLAG), peers(spark, []), P))
    listed = scoring.worklist(scores, P).collect()
    assert len(listed) == 28 and all(r.risk_score >= 10 for r in listed)
    ranked = {r.provider_id: r["rank"] for r in scoring.ranked_worklist(scores, P).collect()}
    assert [r.provider_id for r in listed] == sorted(ranked, key=ranked.get)
    kpi = dashboard.kpis(scores, P).first()
    assert kpi.n_flagged == 28 and kpi.n_proactive == 0
    assert {r.confidence: r.n_providers for r in dashboard.tier_counts(scores).collect()} == {"HIGH": 28, "MEDIUM": 0, "LOW": 2}


def test_flag_events_name_the_real_rules(spark):
    scores = scoring.risk_scores(spine(spark), flags(spark, ["unbundling", "impossible_day"]), peers(spark, [("A", "m", 4.0, 1.0)]), P)
    row = scoring.flag_events(scores, "v002").first()
    assert row.signals_shown == '["impossible_day; unbundling","peer_stats"]' and row.model_version == "v002"
    assert scores.select(F.col("risk_score")).first()[0] == 56.0
