from pyspark.sql import functions as F

from auditlake import session
from auditlake.operators import features, rollups
from verification import batch_queries, model_queries, score_queries, tables

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r[0] for r in df.select("provider_id").collect())


def test_funnel_scores_take_rules_and_peers(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(model_queries.ensemble, "anomaly_scores", lambda *a: seen.append(a[-1]))
    # no provider has a peer flag: only rules can put one forward
    monkeypatch.setattr(model_queries.scoring, "peer_component", lambda found, params: found.select("provider_id", F.lit(0.0).alias("peer_score")).limit(0))
    monkeypatch.setattr(
        model_queries.scoring, "rules_component",
        lambda flags, params: spark.createDataFrame([(1, params.funnel_points), (2, params.funnel_points - 1.0)], "provider_id long, rules_score double"),
    )
    model_queries.m8_funnel_scores(spark, SF)
    assert ids(seen[0]) == [1]


def test_attributions_cover_the_worklist(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [0.0]) for i in range(6)], "provider_id long, x array<double>")
    seen = []
    monkeypatch.setattr(model_queries, "_vectors", lambda *a: vectors)
    monkeypatch.setattr(model_queries.isolation_forest, "fit_forest", lambda *a: None)
    monkeypatch.setattr(model_queries.attribution, "attributions", lambda listed, *a: seen.append(listed) or listed)
    monkeypatch.setattr(model_queries.attribution, "feature_explanations", lambda shown, params: shown)
    monkeypatch.setattr(score_queries, "k10_worklist", lambda *a: vectors.where("provider_id in (1, 4)"))
    model_queries.x3_feature_attributions(spark, SF)
    assert ids(seen[0]) == [1, 4]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_claims_are_joined_once(spark):
    """What reads the claims several times reads one kept table, with the rows of the join."""
    shared, given = batch_queries._shared(spark, SF), batch_queries._inputs(spark, SF)
    for claims in (shared.claims, given.claims, score_queries._mart(spark, SF).claims):
        assert "Join" not in plan(claims)
        assert set(claims.inputFiles()) == set(shared.claims.inputFiles())
    joined = tables.claims(spark, SF)
    kept = batch_queries._claims(spark, SF)
    assert kept.schema.names == joined.schema.names
    assert kept.exceptAll(joined).count() == joined.exceptAll(kept).count() == 0


def test_kept_claims_hold_providers_together(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = tables.stored_claims(spark, SF)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    places = kept.select("provider_id", F.input_file_name().alias("file")).distinct()
    assert len(kept.inputFiles()) > 1
    assert places.count() == kept.select("provider_id").distinct().count()


def test_repeated_keys_are_looked_up_without_shuffling_claims(spark):
    """The few repeated keys are a kept table of known size."""
    rows = [(i, "p", i // 2 if i < 4 else i, 1.0 * i) for i in range(20)]
    claims = spark.createDataFrame(rows, "claim_id long, provider_id string, patient_id long, amount_billed double")
    found = rollups.duplicate_events(claims, ("provider_id", "patient_id"))
    assert sorted((r.patient_id, r.n, r.unit_billed) for r in found.collect()) == [(0, 2, 0.0), (1, 2, 2.0)]
    assert "having" not in plan(found).lower() and "parquet" in plan(found)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_claims_in_buckets_are_grouped_without_a_shuffle(spark):
    claims, days = tables.stored_claims(spark, SF), batch_queries._shared(spark, SF).days
    grouped = [
        rollups.provider_day(claims), rollups.provider_code(claims), rollups.provider_dim(claims), rollups.patients_per_provider(claims),
        features.duplicate_group_counts(claims), claims.groupBy(*tables.PARAMS.evidence_duplicate_keys).count(),
        rollups.provider_totals(days), rollups.provider_month(days), batch_queries._inputs(spark, SF).days.groupBy("provider_id").count(),
    ]
    for df in grouped:
        assert "Exchange" not in executed(df)


def test_buckets_grow_in_number(spark):
    assert session.bucket_count(spark, 0) == spark.sparkContext.defaultParallelism
    assert session.bucket_count(spark, 400 * session.BUCKET_ROWS + 1) == 401


def test_buckets_keep_all_rows(spark):
    rows = [(i % 3 or None, float(i % 5)) for i in range(40)]
    given = spark.createDataFrame(rows, "provider_id long, x double")
    kept = session.stored_by(given, "kept", "provider_id", 3)
    assert kept.schema.names == given.schema.names
    assert kept.exceptAll(given).count() == given.exceptAll(kept).count() == 0


def test_a_provider_with_very_many_claims_is_not_left_to_one_task(spark, monkeypatch):
    assert tables.claim_buckets(spark, SF) > 0
    monkeypatch.setattr(tables, "PROVIDER_ROWS", 10)
    assert tables.claim_buckets.__wrapped__(spark, SF) == 0
    monkeypatch.setattr(tables, "claim_buckets", lambda *a: 0)
    kept, joined = tables.stored_claims(spark, SF), tables.claims(spark, SF)
    assert kept.exceptAll(joined).count() == joined.exceptAll(kept).count() == 0
    assert "Exchange" in executed(rollups.provider_day(kept))
