"""Features, scaling, anomaly detectors, consensus, feedback."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.numbers import rounded
from auditlake.operators import (
    attribution, codemix, ensemble, features, feedback, isolation_forest, lof, ocsvm, peers, privacy, registry, rollups, scoring,
    temporal,
)
from auditlake.operators.neighbour_graph import GraphSettings, neighbour_graph
from auditlake.plans import risk
from auditlake.session import materialize, shared_dir
from verification import ctes as q
from verification import tables
from verification.batch_queries import _shared
from verification.catalog import once, register
from verification.ctes import rnd
from verification.tables import PARAMS

_CODES = PARAMS.fingerprint_codes
FEATURE_CTES = f"""{q.METRICS_ALL},
dup_groups AS (SELECT provider_id, count(*) AS g FROM (SELECT provider_id FROM claims
  GROUP BY provider_id, patient_id, fee_code, service_date HAVING count(*) > 1) GROUP BY provider_id),
fractions AS (SELECT provider_id, {', '.join(f'''CAST(count(*) FILTER (fee_code = '{c}') AS DOUBLE) / count(*) AS "pct_{c}"''' for c in _CODES)}
  FROM claims GROUP BY provider_id),
matrix AS (
  SELECT m.provider_id, CAST(total_claims AS DOUBLE) AS total_claims, total_billed, avg_billed, coalesce(std_billed, 0.0) AS std_billed, avg_minutes,
    CAST(unique_patients AS DOUBLE) AS unique_patients, CAST(unique_codes AS DOUBLE) AS unique_codes, max_billed,
    CAST(billed_days AS DOUBLE) AS billed_days, claims_per_day, services_per_patient,
    coalesce(std_billed, 0.0) / greatest(avg_billed, 0.01) AS billed_cv, max_daily_minutes,
    coalesce(g, 0) / CAST(total_claims AS DOUBLE) AS dup_rate, top_tier_share,
    -({' + '.join(f'''CASE WHEN "pct_{c}" > 0 THEN "pct_{c}" * log2("pct_{c}") ELSE 0.0 END''' for c in _CODES)}) AS code_entropy,
    {', '.join(f'"pct_{c}"' for c in _CODES)},
    {', '.join(f'''CASE WHEN specialty = '{r}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "spec_{r}"''' for r in tables.REGIONS)},
    CASE WHEN specialty IN ({', '.join(f"'{r}'" for r in tables.REGIONS)}) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS spec_other
  FROM metrics m JOIN fractions USING (provider_id) LEFT JOIN dup_groups USING (provider_id))"""
_NAMES = features.feature_names(PARAMS)
SCALE_CTES = f"""{FEATURE_CTES},
cells AS (UNPIVOT matrix ON {', '.join(f'"{n}"' for n in _NAMES)} INTO NAME feature VALUE x),
scales AS (SELECT feature, quantile_cont(x, 0.5) AS centre,
  CASE WHEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) < 1e-14 THEN 1.0 ELSE quantile_cont(x, 0.75) - quantile_cont(x, 0.25) END AS scale
  FROM cells GROUP BY feature)"""


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    shared = _shared(spark, sf)
    return features.feature_matrix(shared.claims, shared.days, shared.codes, shared.people, PARAMS)


@once
def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(features.scaled_vectors(materialize(_matrix(spark, sf)), _NAMES))


@register("a6_core_features", f"""WITH {FEATURE_CTES}
SELECT provider_id, total_claims, total_billed, avg_billed, {rnd('std_billed', 4)} AS std_billed, avg_minutes, unique_patients,
  unique_codes, max_billed, billed_days, claims_per_day, services_per_patient, {rnd('billed_cv', 6)} AS billed_cv,
  max_daily_minutes, dup_rate, top_tier_share FROM matrix""")
def a6_core_features(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(spark, sf).select(
        "provider_id", "total_claims", "total_billed", "avg_billed", rounded("std_billed", 4).alias("std_billed"),
        "avg_minutes", "unique_patients", "unique_codes", "max_billed", "billed_days", "claims_per_day",
        "services_per_patient", rounded("billed_cv", 6).alias("billed_cv"), "max_daily_minutes", "dup_rate", "top_tier_share",
    )


@register("a9_code_fractions", f"""WITH {FEATURE_CTES}
SELECT provider_id, {rnd('code_entropy', 6)} AS code_entropy, {', '.join(f'"pct_{c}"' for c in _CODES)} FROM matrix""")
def a9_code_fractions(spark: SparkSession, sf: str) -> DataFrame:
    wide = features.code_fractions(rollups.provider_code(tables.claims(spark, sf)), PARAMS)
    return wide.withColumn("code_entropy", rounded("code_entropy", 6))


@register("a11_specialty_one_hot", f"""WITH {FEATURE_CTES}
SELECT provider_id, {', '.join(f'"spec_{r}"' for r in tables.REGIONS)} FROM matrix""")
def a11_specialty_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(spark, sf).select("provider_id", *[F.col(f"`spec_{r}`") for r in tables.REGIONS])


@register("m2_robust_scaling", f"""WITH {SCALE_CTES}
SELECT feature, {rnd('centre', 6)} AS centre, {rnd('scale', 6)} AS scale FROM scales""")
def m2_robust_scaling(spark: SparkSession, sf: str) -> DataFrame:
    table = features.scaling(materialize(_matrix(spark, sf)), _NAMES)
    return table.select("feature", rounded("centre", 6).alias("centre"), rounded("scale", 6).alias("scale"))


_K = PARAMS.lof_neighbours
LOF_CTES = f"""{SCALE_CTES},
scaled AS (SELECT provider_id, feature, (x - centre) / scale AS v FROM cells JOIN scales USING (feature)),
pairs AS (SELECT a.provider_id, b.provider_id AS other, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d
  FROM scaled a JOIN scaled b USING (feature) WHERE a.provider_id <> b.provider_id GROUP BY a.provider_id, b.provider_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY d, other) AS place FROM pairs) WHERE place <= {_K}),
reach AS (SELECT provider_id AS other, max(d) AS kd FROM near GROUP BY provider_id),
lrd AS (SELECT provider_id, 1.0 / (avg(greatest(d, kd)) + 1e-10) AS density FROM near JOIN reach USING (other) GROUP BY provider_id),
factors AS (SELECT n.provider_id, avg(o.density) / max(s.density) AS lof FROM near n JOIN lrd o ON n.other = o.provider_id
  JOIN lrd s ON n.provider_id = s.provider_id GROUP BY n.provider_id)"""


@register("a11_specialty_dictionary", f"""WITH {q.METRICS_ALL}, dim AS (SELECT provider_id, min(specialty) AS specialty FROM claims GROUP BY provider_id),
often AS (SELECT specialty FROM dim GROUP BY specialty ORDER BY count(*) DESC, specialty LIMIT 3)
SELECT provider_id, CASE WHEN specialty IN (SELECT specialty FROM often) THEN 'spec_' || specialty ELSE 'spec_other' END AS feature FROM dim""")
def a11_specialty_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """The one-hot column of each provider when the dictionary comes from the data and holds fewer specialties than there are."""
    shared = _shared(spark, sf)
    params = features.with_specialties(shared.people, replace(PARAMS, specialties=None, max_specialties=3))
    matrix = features.feature_matrix(shared.claims, shared.days, shared.codes, shared.people, params)
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("x")) for n in features.feature_names(params) if n.startswith("spec_")])
    return matrix.select("provider_id", F.explode(cells).alias("c")).where("c.x = 1").select("provider_id", "c.feature")


@register("j16_nearest_neighbours", f"WITH {LOF_CTES} SELECT provider_id, other AS neighbour_id, {rnd('d', 6)} AS distance, CAST(place AS INTEGER) AS place FROM near")
def j16_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    near = lof.nearest_neighbours(vectors, vectors.count(), _K, PARAMS.seed, block_rows=16)
    return near.select("provider_id", "neighbour_id", rounded("distance", 6).alias("distance"), "place")


@register("m4_local_outlier_factor", f"WITH {LOF_CTES} SELECT provider_id, {rnd('lof', 6)} AS lof FROM factors")
def m4_local_outlier_factor(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    factors = lof.local_outlier_factor(vectors, vectors.count(), _K, PARAMS.seed, block_rows=16, exact=True)
    return factors.select("provider_id", rounded("lof", 6).alias("lof"))


@register("j16_neighbour_graph")
def j16_neighbour_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The approximate graph with buckets far smaller than the table; its recall is measured in tests."""
    near = neighbour_graph(_vectors(spark, sf), _K, GraphSettings(bucket_rows=32))
    return near.select("provider_id", "neighbour_id", rounded("distance", 6).alias("distance"), "place")


@register("m4_graph_outlier_factor", f"WITH {LOF_CTES} SELECT provider_id, {rnd('lof', 6)} AS lof FROM factors")
def m4_graph_outlier_factor(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    return lof.local_outlier_factor(vectors, vectors.count(), _K, PARAMS.seed).select("provider_id", rounded("lof", 6).alias("lof"))


@register("m3_isolation_forest")
def m3_isolation_forest(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    n = vectors.count()
    trees = isolation_forest.fit_forest(vectors, n, PARAMS)
    return isolation_forest.forest_scores(vectors, trees, n, PARAMS)


@register("m5_one_class_svm")
def m5_one_class_svm(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    w = ocsvm.fit_svm(vectors, vectors.count(), len(_NAMES), PARAMS.contamination, PARAMS)
    return ocsvm.svm_scores(vectors, w, len(_NAMES), PARAMS.contamination, PARAMS)


# the vote and the normalisation, given three raw scores
def _norm(name: str) -> str:
    return f"(-{name} - min(-{name}) OVER ()) / (max(-{name}) OVER () - min(-{name}) OVER () + 1e-9) * 100.0"


@register("m7_consensus", f"""WITH {q.METRICS_ALL},
raw AS (SELECT provider_id, -claims_per_day AS if_raw, -avg_billed AS lof_raw, 0.45 - services_per_patient / 2.5 AS ocsvm_raw FROM metrics),
parts AS (SELECT provider_id, {_norm('if_raw')} AS i, {_norm('lof_raw')} AS l, {_norm('ocsvm_raw')} AS o,
  CAST(if_raw < (SELECT quantile_cont(if_raw, 0.1) FROM raw) AS INTEGER) AS fi, CAST(lof_raw < (SELECT quantile_cont(lof_raw, 0.1) FROM raw) AS INTEGER) AS fl,
  CAST(ocsvm_raw < 0 AS INTEGER) AS fo FROM raw)
SELECT provider_id, {rnd('0.5 * i + 0.3 * l + 0.2 * o', 2)} AS ml_score, CAST(fi + fl + fo >= 2 AS INTEGER) AS ml_is_anomaly,
  fi + fl + fo AS vote_count, {rnd('i', 2)} AS if_score, fi AS if_flag, {rnd('l', 2)} AS lof_score, fl AS lof_flag,
  {rnd('o', 2)} AS ocsvm_score, fo AS ocsvm_flag FROM parts""")
def m7_consensus(spark: SparkSession, sf: str) -> DataFrame:
    shared = _shared(spark, sf)
    metrics = peers.provider_metrics(shared.claims, shared.days, shared.codes, shared.people, PARAMS)
    raw = materialize(metrics.select(
        "provider_id", (-F.col("claims_per_day")).alias("if_raw"), (-F.col("avg_billed")).alias("lof_raw"),
        (0.45 - F.col("services_per_patient") / 2.5).alias("ocsvm_raw"),
    ))
    return ensemble.consensus(raw, PARAMS.contamination, PARAMS)


@register("m7_anomaly_scores")
def m7_anomaly_scores(spark: SparkSession, sf: str) -> DataFrame:
    shared = _shared(spark, sf)
    return ensemble.anomaly_scores(shared.claims, shared.days, shared.codes, shared.people, PARAMS)


@register("m8_funnel_candidates", f"""WITH {q.SCORES_ALL} SELECT provider_id FROM fused WHERE rules_score + peer_score >= {PARAMS.funnel_points}""")
def m8_funnel_candidates(spark: SparkSession, sf: str) -> DataFrame:
    shared = _shared(spark, sf)
    found = peers.peer_flags(risk.scored_metrics(shared, PARAMS), PARAMS)
    return ensemble.funnel_candidates(
        scoring.rules_component(risk.all_rule_flags(shared, PARAMS), PARAMS), scoring.peer_component(found, PARAMS), PARAMS
    )


@register("m8_funnel_scores")
def m8_funnel_scores(spark: SparkSession, sf: str) -> DataFrame:
    shared = _shared(spark, sf)
    found = peers.peer_flags(risk.scored_metrics(shared, PARAMS), PARAMS)
    candidates = materialize(ensemble.funnel_candidates(
        scoring.rules_component(risk.all_rule_flags(shared, PARAMS), PARAMS), scoring.peer_component(found, PARAMS), PARAMS
    ))
    return ensemble.anomaly_scores(shared.claims, shared.days, shared.codes, shared.people, PARAMS, candidates)


# ---------------------------------------------------------------- feedback

LABEL_CTES = """disp AS (SELECT event_id AS seq, user_id AS provider_id, CASE WHEN event_type = 'purchase' THEN 'confirmed' ELSE 'cleared' END AS outcome
  FROM events WHERE event_type IN ('purchase', 'error')),
latest AS (SELECT provider_id, outcome, CAST(outcome = 'confirmed' AS INTEGER) AS label FROM
  (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY seq DESC) AS k FROM disp) WHERE k = 1)"""


@register("w10_latest_dispositions", f"WITH {LABEL_CTES} SELECT * FROM latest")
def w10_latest_dispositions(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.latest_dispositions(feedback.checked_dispositions(tables.dispositions(spark, sf)))


@once
def _features(spark: SparkSession, sf: str) -> DataFrame:
    shared = _shared(spark, sf)
    metrics = materialize(peers.provider_metrics(shared.claims, shared.days, shared.codes, shared.people, PARAMS))
    drift = codemix.drift_scores(shared.codes, metrics, PARAMS)
    changes = temporal.temporal_scores(rollups.provider_month(shared.days), shared.people, PARAMS)
    return materialize(feedback.provider_features(metrics, drift, None, changes))


_F10 = ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in feedback.FEATURES if c != "ml_score") + ", 0.0::DOUBLE AS ml_score"


@register("l1_training_set", f"""WITH {q.DRIFT_ALL}, {q.TEMPORAL_CTES}, {LABEL_CTES}
SELECT l.provider_id, outcome, label, {_F10} FROM latest l LEFT JOIN metrics USING (provider_id)
  LEFT JOIN drift USING (provider_id) LEFT JOIN temporal USING (provider_id)""")
def l1_training_set(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.training_set(tables.dispositions(spark, sf), _features(spark, sf))


@register("l2_feedback_boosted")
def l2_feedback_boosted(spark: SparkSession, sf: str) -> DataFrame:
    scored = materialize(_features(spark, sf))
    training = materialize(feedback.training_set(tables.dispositions(spark, sf), scored))
    return feedback.feedback_scores(feedback.fit_feedback(training, PARAMS), scored, PARAMS)


@register("l2_feedback_logistic")
def l2_feedback_logistic(spark: SparkSession, sf: str) -> DataFrame:
    scored = materialize(_features(spark, sf))
    training = materialize(feedback.training_set(tables.dispositions(spark, sf), scored))
    return feedback.feedback_scores(feedback.fit_feedback(training, PARAMS, "logistic"), scored, PARAMS)


@register("l4_holdout_metrics")
def l4_holdout_metrics(spark: SparkSession, sf: str) -> DataFrame:
    training = materialize(feedback.training_set(tables.dispositions(spark, sf), _features(spark, sf)))
    return feedback.holdout_metrics(training, PARAMS, "logistic")


_HELD = "cast(round_even(count(*) FILTER (label = 1) * 0.2, 0) + round_even(count(*) FILTER (label = 0) * 0.2, 0) AS BIGINT)"


@register("l5_versions", f"""WITH {LABEL_CTES}, n AS (SELECT count(*) AS n_total_labels, count(*) FILTER (label = 1) AS n_confirmed, count(*) FILTER (label = 0) AS n_cleared,
  {_HELD} AS val_size FROM latest)
SELECT CAST(k AS BIGINT) AS version_no, 'v00' || k AS version_id, CASE k WHEN 1 THEN 'logistic' ELSE 'boosted' END AS model_type, n.*,
  'stratified_80_20_split_proxy' AS method, k = 2 AS is_current, TRUE AS same_data, TRUE AS scores_after_reload FROM n, (VALUES (1), (2)) v(k)""")
def l5_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Two registered versions, what they were trained on, and whether a reloaded model scores as the fitted one did."""
    base = f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}"
    scored = materialize(_features(spark, sf))
    training = materialize(feedback.training_set(tables.dispositions(spark, sf), scored))
    told = []
    for kind in ("logistic", "boosted"):
        model = feedback.fit_feedback(training, PARAMS, kind)
        version = registry.register(model, training, PARAMS, base, kind)
        again = feedback.feedback_scores(registry.load_version(spark, base, version), scored, PARAMS)
        other = again.exceptAll(feedback.feedback_scores(model, scored, PARAMS))
        told.append(other.agg((F.count(F.lit(1)) == 0).alias("scores_after_reload")).withColumn("v", F.lit(version)))
    versions = registry.list_versions(spark, base).join(told[0].union(told[1]), F.col("version_id") == F.col("v"))
    newest = registry.current_version(spark, base).select(F.col("version_id").alias("newest"), F.col("training_data_hash").alias("h"))
    return versions.join(F.broadcast(newest)).select(
        "version_no", "version_id", "model_type", "n_total_labels", "n_confirmed", "n_cleared", "val_size", "method",
        (F.col("version_id") == F.col("newest")).alias("is_current"), (F.col("training_data_hash") == F.col("h")).alias("same_data"), "scores_after_reload",
    )


# ---------------------------------------------------------------- attribution and privacy

#: rows that a task explains: seconds of work, so the tasks follow the number of rows
_EXPLAINED_ROWS = 4096


@register("x3_feature_attributions")
def x3_feature_attributions(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    trees = isolation_forest.fit_forest(vectors, vectors.count(), PARAMS)
    listed = vectors.join(_listed(spark, sf), "provider_id", "left_semi")
    listed = materialize(listed)
    tasks = max(8, -(-listed.count() // _EXPLAINED_ROWS))
    shown = materialize(attribution.attributions(listed.repartition(tasks), trees, _NAMES))
    return attribution.feature_explanations(shown, PARAMS)


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    """The providers worth explaining: those on the worklist."""
    from verification.score_queries import k10_worklist

    return k10_worklist(spark, sf).select("provider_id")


@register("p1_sensitivity", "SELECT greatest(quantile_cont(abs(value - 10), 0.95), 0.001) AS sensitivity FROM events")
def p1_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    values = materialize(tables.table(spark, sf, "events").select((F.col("value") - 10).alias("v")))
    return privacy.sensitivity(values, "v", PARAMS)


@register("p2_display_noise", f"""WITH s AS (SELECT greatest(quantile_cont(abs(value - 10), 0.95), 0.001) AS b FROM events),
u AS (SELECT event_id, user_id, value - 10 AS v, b,
  (('0x' || substr(md5(event_id || '|' || user_id || '|42'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0 - 0.5 AS c FROM events, s)
SELECT event_id, user_id, v, {rnd('v - b * sign(c) * ln(1 - 2 * abs(c))', 6)} AS noisy, 1.0::DOUBLE AS epsilon, {rnd('b', 6)} AS sensitivity FROM u""")
def p2_display_noise(spark: SparkSession, sf: str) -> DataFrame:
    values = materialize(tables.table(spark, sf, "events").select("event_id", "user_id", (F.col("value") - 10).alias("v")))
    return privacy.with_noise(values, "v", ["event_id", "user_id"], PARAMS).withColumn("noisy", rounded("noisy", 6))
