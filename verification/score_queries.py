"""Score fusion, worklist, dashboard aggregates, fairness, evaluation and the mart's analyst queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import dashboard, evaluation, explain, fairness, scoring
from auditlake.params import Params
from auditlake.plans import mart, risk
from auditlake.session import shared_dir
from auditlake.sources import readers, sinks
from verification import ctes as q
from verification import tables
from verification.batch_queries import RECOVERY, SUMMARY_SQL, _claims, t5_recovery_summary
from verification.catalog import once, register
from verification.ctes import rnd
from verification.tables import PARAMS


@once
def _run(spark: SparkSession, sf: str) -> risk.RiskRun:
    """All layers that SQL can follow; the ensemble and the classifier are checked on their own."""
    return risk.run(_claims(spark, sf), PARAMS, with_ml=False, buckets=tables.claim_buckets(spark, sf))


def _cents(name: str) -> str:
    return f"coalesce(CAST(sum(CAST(round({name} * 100) AS BIGINT)) AS DOUBLE) / 100.0, 0.0)"


# ---------------------------------------------------------------- fusion and worklist

@register("k1_rules_component", f"WITH {q.SCORES_ALL} SELECT * FROM rules_part")
def k1_rules_component(spark: SparkSession, sf: str) -> DataFrame:
    shared = risk.share(_claims(spark, sf), tables.claim_buckets(spark, sf))
    return scoring.rules_component(risk.all_rule_flags(shared, PARAMS), PARAMS)


@register("k2_peer_component", f"WITH {q.SCORES_ALL} SELECT * FROM peer_part JOIN (SELECT provider_id, max(estimated_exposure) AS peer_exposure_max FROM peer_flags GROUP BY provider_id) USING (provider_id)")
def k2_peer_component(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.peer_component(_run(spark, sf).peer_flags, PARAMS)


@register("k3_ml_component", f"""WITH {q.CLAIMS}, ml AS (SELECT provider_id, {rnd('avg(service_minutes) / 10.0', 2)} AS ml_score, CAST(count(*) > 600 AS INTEGER) AS ml_is_anomaly FROM claims GROUP BY provider_id)
SELECT *, {rnd('ml_score / 100.0 * 15.0', 2)} AS ml_points FROM ml""")
def k3_ml_component(spark: SparkSession, sf: str) -> DataFrame:
    from auditlake.functions.numbers import rounded

    ml = tables.claims(spark, sf).groupBy("provider_id").agg(
        rounded(F.avg("service_minutes") / 10.0, 2).alias("ml_score"), (F.count(F.lit(1)) > 600).cast("int").alias("ml_is_anomaly")
    )
    return scoring.ml_component(ml, PARAMS)


@register("k4_codemix_component", f"WITH {q.SCORES_ALL} SELECT provider_id, kl_divergence, cosine_distance, codemix_score, codemix_flag FROM fused")
def k4_codemix_component(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.codemix_component(_run(spark, sf).drift, PARAMS)


@register("k5_temporal_component", f"WITH {q.SCORES_ALL} SELECT provider_id, temporal_score, temporal_flag FROM fused")
def k5_temporal_component(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.temporal_component(_run(spark, sf).temporal, PARAMS)


@register("k6_risk_scores", f"WITH {q.SCORES_ALL} SELECT {q.WORKLIST} FROM scores")
def k6_risk_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).scores.select(*scoring.WORKLIST_COLUMNS)


@register("k10_worklist", f"WITH {q.SCORES_ALL} SELECT {q.WORKLIST} FROM ranked")
def k10_worklist(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.worklist(_run(spark, sf).scores, PARAMS)


@register("w11_ranked_worklist", f"WITH {q.SCORES_ALL} SELECT rank, {q.WORKLIST} FROM ranked")
def w11_ranked_worklist(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.ranked_worklist(_run(spark, sf).scores, PARAMS)


@register("o2_worklist_top20", f"WITH {q.SCORES_ALL} SELECT {q.WORKLIST} FROM ranked WHERE rank <= 20")
def o2_worklist_top20(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.worklist(_run(spark, sf).scores, PARAMS).limit(20)


@register("v9_worklist_filter", f"WITH {q.SCORES_ALL} SELECT {q.WORKLIST} FROM scores WHERE risk_score >= 45 AND specialty = 'ASIA' AND confidence = 'HIGH'")
def v9_worklist_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = scoring.filter_worklist(_run(spark, sf).scores, "ASIA", "HIGH", 45.0)
    return kept.select(*scoring.WORKLIST_COLUMNS)


@register("c7_flag_events", f"""WITH {q.SCORES_ALL}
SELECT 'flag_generated' AS event_type, 'system' AS user, provider_id, 'v001' AS model_version,
  '[' || concat_ws(',', CASE WHEN rules_score > 0 THEN '"' || rules_reasons || '"' END, CASE WHEN peer_score > 0 THEN '"peer_stats"' END,
    CASE WHEN codemix_flag = 1 THEN '"codemix_drift"' END, CASE WHEN temporal_flag = 1 THEN '"temporal_change_point"' END) || ']' AS signals_shown,
  CAST(NULL AS VARCHAR) AS action_taken, top_reason AS reasoning FROM ranked""")
def c7_flag_events(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.flag_events(scoring.worklist(_run(spark, sf).scores, PARAMS), "v001")


@register("k6_full_risk_run")
def k6_full_risk_run(spark: SparkSession, sf: str) -> DataFrame:
    """Every layer together: ensemble and classifier included."""
    run = risk.run(
        _claims(spark, sf), PARAMS, with_ml=True, dispositions=tables.dispositions(spark, sf), feedback_kind="logistic",
        buckets=tables.claim_buckets(spark, sf),
    )
    return scoring.worklist(run.scores, PARAMS)


# ---------------------------------------------------------------- dashboard

@register("a24_kpis", f"""WITH {q.SCORES_ALL}
SELECT {_cents('estimated_exposure')} AS total_exposure, count(*) AS n_flagged,
  count(*) FILTER (rules_score = 0 AND (peer_score > 0 OR ml_is_anomaly = 1)) AS n_proactive, max(estimated_exposure) AS top_exposure FROM ranked""")
def a24_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.kpis(_run(spark, sf).scores, PARAMS)


@register("a25_exposure_by_specialty", f"""WITH {q.SCORES_ALL}
SELECT specialty, {_cents('estimated_exposure')} AS estimated_exposure FROM ranked GROUP BY specialty ORDER BY 2 DESC, 1 LIMIT 8""")
def a25_exposure_by_specialty(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.exposure_by_specialty(scoring.worklist(_run(spark, sf).scores, PARAMS))


@register("a25_tier_counts", f"""WITH {q.SCORES_ALL}
SELECT t.confidence, count(provider_id) AS n_providers FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) t(confidence)
LEFT JOIN ranked USING (confidence) GROUP BY t.confidence""")
def a25_tier_counts(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.tier_counts(scoring.worklist(_run(spark, sf).scores, PARAMS))


@register("a25_score_histogram", f"""WITH {q.SCORES_ALL}
SELECT CAST(least(floor(risk_score / 5.0) + 1, 20) AS INTEGER) AS bin, count(*) AS n_providers FROM ranked GROUP BY 1""")
def a25_score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.score_histogram(scoring.worklist(_run(spark, sf).scores, PARAMS))


@register("a26_layer_coverage", f"""WITH {q.SCORES_ALL}
SELECT 'Rules' AS layer, count(*) FILTER (rules_score > 0) AS providers_hit FROM ranked
UNION ALL SELECT 'Peer Stats', count(*) FILTER (peer_score > 0) FROM ranked
UNION ALL SELECT 'ML Ensemble', count(*) FILTER (ml_is_anomaly = 1) FROM ranked
UNION ALL SELECT 'Code-Mix', count(*) FILTER (codemix_flag = 1) FROM ranked
UNION ALL SELECT 'Temporal', count(*) FILTER (temporal_flag = 1) FROM ranked
UNION ALL SELECT 'Feedback', count(*) FILTER (feedback_score > 0) FROM ranked""")
def a26_layer_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.layer_coverage(scoring.worklist(_run(spark, sf).scores, PARAMS))


# ---------------------------------------------------------------- explanations

@register("x1_explanations")
def x1_explanations(spark: SparkSession, sf: str) -> DataFrame:
    return risk.explained(_run(spark, sf), PARAMS)


@register("w13_top_peer_flags", f"""WITH {q.PEERS_ALL}
SELECT * FROM (SELECT provider_id, metric, z_score, CAST(row_number() OVER (PARTITION BY provider_id ORDER BY abs(z_score) DESC, metric) AS INTEGER) AS place FROM peer_flags)
WHERE place <= 3""")
def w13_top_peer_flags(spark: SparkSession, sf: str) -> DataFrame:
    return explain.top_peer_flags(_run(spark, sf).peer_flags).select("provider_id", "metric", "z_score", "place")


# ---------------------------------------------------------------- fairness and evaluation

TRUTH = """truth AS (SELECT s_suppkey AS provider_id, CASE WHEN s_acctbal < 1000 THEN 1 ELSE 0 END AS label
  FROM supplier WHERE s_acctbal < 1000 OR s_acctbal > 9000)"""
# most providers pass the default threshold on this data, so fairness is asked of the upper half
_HIGH = Params(worklist_from=60.0)


def _high_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).scores.where(F.col("risk_score") >= 60)


def _roster(spark: SparkSession, sf: str) -> DataFrame:
    shared = _run(spark, sf).shared
    return fairness.roster(shared.days, shared.people, PARAMS)


@register("a17_provider_roster", f"""WITH {q.METRICS_ALL}
SELECT provider_id, specialty, clinic_id, total_claims AS n_claims, billed_days, active_day_fraction, practice_setting FROM metrics""")
def a17_provider_roster(spark: SparkSession, sf: str) -> DataFrame:
    return _roster(spark, sf)


FAIRNESS = f"""{q.SCORES_ALL}, {TRUTH},
people AS (SELECT f.provider_id, f.specialty, f.clinic_id, f.practice_setting, CASE WHEN risk_score >= 60 THEN 1 ELSE 0 END AS flagged,
    CASE WHEN risk_score >= 60 THEN risk_score ELSE 0.0 END AS risk, CASE WHEN label = 1 THEN 1 ELSE 0 END AS bad
  FROM scores f LEFT JOIN truth USING (provider_id)),
grp AS (
  SELECT CASE WHEN grouping(specialty) = 0 THEN 'specialty' WHEN grouping(clinic_id) = 0 THEN 'clinic_id' ELSE 'practice_setting' END AS dimension,
    coalesce(specialty, clinic_id, practice_setting) AS grp, count(*) AS n, sum(flagged) AS f, avg(risk) AS mean_risk, sum(flagged * bad) AS b
  FROM people GROUP BY GROUPING SETS ((specialty), (clinic_id), (practice_setting)) HAVING count(*) >= 5),
tot AS (SELECT count(*) AS nn, sum(flagged) AS ff FROM people),
cell AS (SELECT *, CAST(f AS DOUBLE) AS a1, CAST(n - f AS DOUBLE) AS b1, CAST(ff - f AS DOUBLE) AS c1, CAST(nn - n - (ff - f) AS DOUBLE) AS d1 FROM grp, tot),
chi AS (SELECT *, CASE WHEN (a1 + b1) * (c1 + d1) * (a1 + c1) * (b1 + d1) = 0 THEN 0.0
  ELSE nn * power(greatest(0.0, abs(a1 * d1 - b1 * c1) - nn / 2.0), 2) / ((a1 + b1) * (c1 + d1) * (a1 + c1) * (b1 + d1)) END AS x2 FROM cell)"""


@register("f1_group_stats", f"""WITH {FAIRNESS}
SELECT dimension, grp AS group, n AS n_providers, CAST(f AS BIGINT) AS n_flagged, {rnd('CAST(f AS DOUBLE) / n', 4)} AS flag_rate, {rnd('mean_risk', 2)} AS mean_risk_score,
  CAST(b AS BIGINT) AS n_confirmed_bad, {rnd('CAST(b AS DOUBLE) / nullif(f, 0)', 4)} AS precision_proxy, {rnd('x2', 6)} AS chi2,
  x2 > 3.841458820694124 AND CAST(f AS DOUBLE) / n > CAST(ff AS DOUBLE) / nn AS alert FROM chi""")
def f1_group_stats(spark: SparkSession, sf: str) -> DataFrame:
    people = _roster(spark, sf)
    return fairness.group_stats(people, _high_scores(spark, sf), tables.truth(spark, sf), PARAMS)


# the same approximation of the tail in SQL
_T = f"(1.0 / (1.0 + {fairness._ERFC_P} * sqrt(x2 / 2.0)))"
_TAIL = "0.0::DOUBLE"
for _a in reversed(fairness._ERFC_A):
    _TAIL = f"(({_TAIL} + {_a}::DOUBLE) * {_T})"


@register("f2_fairness_summary", f"""WITH {FAIRNESS}
SELECT dimension, grp AS group, n AS n_providers, CAST(f AS BIGINT) AS n_flagged, {rnd('CAST(f AS DOUBLE) / n', 4)} AS flag_rate, {rnd('mean_risk', 2)} AS mean_risk_score,
  CAST(b AS BIGINT) AS n_confirmed_bad, {rnd('CAST(b AS DOUBLE) / nullif(f, 0)', 4)} AS precision_proxy, {rnd('x2', 6)} AS chi2,
  x2 > 3.841458820694124 AND CAST(f AS DOUBLE) / n > CAST(ff AS DOUBLE) / nn AS alert, {rnd(f'{_TAIL} * exp(-x2 / 2.0)', 4)} AS chi2_p_value FROM chi""")
def f2_fairness_summary(spark: SparkSession, sf: str) -> DataFrame:
    people = _roster(spark, sf)
    return fairness.fairness_summary(people, _high_scores(spark, sf), tables.truth(spark, sf), PARAMS)


@register("q1_resolved_labels", f"""WITH {TRUTH}
SELECT s_suppkey AS provider_id, CASE WHEN s_acctbal < 1000 THEN 1 ELSE 0 END AS label, CAST(NULL AS DOUBLE) AS recovered_amount, 'SYNTHETIC' AS basis FROM supplier""")
def q1_resolved_labels(spark: SparkSession, sf: str) -> DataFrame:
    planted = tables.truth(spark, sf).where(F.col("label") == 1)
    everyone = tables.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("provider_id"))
    return evaluation.resolve_labels(spark, planted=planted, universe=everyone)


@register("q2_confusion", f"""WITH {q.SCORES_ALL}, lab AS (SELECT s_suppkey AS provider_id, CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END AS label FROM supplier WHERE s_acctbal > 0),
cnt AS (SELECT count(*) AS n_labelled, count(*) FILTER (risk_score >= 60 AND label = 1) AS tp, count(*) FILTER (risk_score >= 60 AND label = 0) AS fp,
  count(*) FILTER (risk_score < 60 AND label = 1) AS fn, count(*) FILTER (risk_score < 60 AND label = 0) AS tn FROM lab JOIN scores USING (provider_id)),
rat AS (SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS p, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS r, CAST(tn AS DOUBLE) / nullif(tn + fp, 0) AS s FROM cnt)
SELECT n_labelled, tp, fp, fn, tn, {rnd('p', 3)} AS precision, {rnd('r', 3)} AS recall, {rnd('s', 3)} AS specificity,
  CASE WHEN p > 0 AND r > 0 THEN {rnd('2.0 * p * r / (p + r)', 3)} END AS f1 FROM rat""")
def q2_confusion(spark: SparkSession, sf: str) -> DataFrame:
    labels = evaluation.resolve_labels(spark, outcomes=tables.outcomes(spark, sf))
    return evaluation.confusion(labels, evaluation.flagged_providers(_run(spark, sf).scores, _HIGH))


@register("q2_calibration", f"""WITH {RECOVERY}, summary AS ({SUMMARY_SQL}),
both_sides AS (SELECT statutory_recoverable AS e, s_acctbal * 100.0 AS a FROM summary JOIN supplier ON s_suppkey = provider_id WHERE s_acctbal > 0)
SELECT count(*) AS n, {rnd('avg(e / a)', 3)} AS mean_estimate_to_actual_ratio, {rnd('avg(abs(e - a))', 2)} AS mae FROM both_sides""")
def q2_calibration(spark: SparkSession, sf: str) -> DataFrame:
    labels = evaluation.resolve_labels(spark, outcomes=tables.outcomes(spark, sf))
    return evaluation.calibration(labels, t5_recovery_summary(spark, sf))


def _card(suffix: str, ranked: str) -> str:
    """Rows, counts and card of a run, as CTEs that end in ``suffix``."""
    return f"""rows{suffix} AS (SELECT t.provider_id, label, rank, coalesce(risk_score, 0.0) AS risk_score, coalesce(estimated_exposure, 0.0) AS estimated_exposure,
  CASE WHEN rank IS NULL THEN 'not scored' WHEN rank <= 10 THEN 'top 10' WHEN rank <= 20 THEN 'top 20' ELSE 'below top 20' END AS status,
  coalesce(label = 0 AND risk_score >= 10, FALSE) AS false_positive FROM truth t LEFT JOIN {ranked} USING (provider_id)),
cnt{suffix} AS (SELECT count(*) FILTER (label = 1) AS n_total, count(*) FILTER (label = 1 AND rank <= 10) AS n_caught_10,
  count(*) FILTER (label = 1 AND rank <= 20) AS n_caught_20, {rnd('coalesce(avg(CASE WHEN label = 1 THEN rank END), 9999.0)', 1)} AS avg_rank,
  count(*) FILTER (label = 0 AND false_positive) AS n_fp, count(*) FILTER (label = 0) AS n_traps FROM rows{suffix}),
card{suffix} AS (SELECT *, {rnd('CAST(n_caught_10 AS DOUBLE) / n_total * 100.0', 1)} AS det_rate_10, {rnd('CAST(n_caught_20 AS DOUBLE) / n_total * 100.0', 1)} AS det_rate_20,
  coalesce({rnd('CAST(n_fp AS DOUBLE) / nullif(n_traps, 0) * 100.0', 1)}, 0.0) AS fp_rate FROM cnt{suffix})"""


_CARD = f"{q.SCORES_ALL}, {TRUTH}, {_card('', 'ranked')}"


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.ranked_worklist(_run(spark, sf).scores, PARAMS)


@register("q3_scorecard_rows", f"WITH {_CARD} SELECT * FROM rows")
def q3_scorecard_rows(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.scorecard_rows(_ranked(spark, sf), tables.truth(spark, sf), PARAMS)


@register("q3_scorecard", f"WITH {_CARD} SELECT * FROM card")
def q3_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.scorecard(_ranked(spark, sf), tables.truth(spark, sf), PARAMS)


@register("q3_unregistered", f"WITH {_CARD} SELECT provider_id FROM ranked WHERE rank <= 20 AND provider_id NOT IN (SELECT provider_id FROM truth)")
def q3_unregistered(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.unregistered(_ranked(spark, sf), tables.truth(spark, sf))


_METRICS = ("det_rate_10", "det_rate_20", "avg_rank", "fp_rate", "n_fp")
_CHANGES = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CAST(b.{m} AS DOUBLE) AS baseline, CAST(c.{m} AS DOUBLE) AS now, {rnd(f'CAST(c.{m} AS DOUBLE) - CAST(b.{m} AS DOUBLE)', 1)} AS delta FROM card c, card_before b"
    for m in _METRICS
)


@register("q3_scorecard_change", f"WITH {_CARD}, {_card('_before', '(SELECT * FROM ranked WHERE provider_id % 2 = 0) AS half')} {_CHANGES}")
def q3_scorecard_change(spark: SparkSession, sf: str) -> DataFrame:
    """Against the saved card of an earlier run that had ranked only the providers with even ids."""
    path = f"{shared_dir(spark)}/scorecard-{uuid.uuid4().hex}"
    ranked, truth = _ranked(spark, sf), tables.truth(spark, sf)
    sinks.write_table(evaluation.scorecard(ranked.where("provider_id % 2 = 0"), truth, PARAMS), path)
    return evaluation.scorecard_change(evaluation.scorecard(ranked, truth, PARAMS), spark.read.parquet(path))


@register("q1_trusted_labels", """WITH disp AS (SELECT event_id AS seq, user_id AS provider_id, event_type FROM events WHERE event_type IN ('purchase', 'error'))
SELECT provider_id, CAST(arg_max(event_type, seq) = 'purchase' AS INTEGER) AS label, CAST(NULL AS DOUBLE) AS recovered_amount, 'AUDITOR_DISPOSITIONS' AS basis
FROM disp GROUP BY provider_id""")
def q1_trusted_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Dispositions that are trusted go before the planted truth."""
    planted = tables.truth(spark, sf).where(F.col("label") == 1)
    return evaluation.resolve_labels(spark, dispositions=tables.dispositions(spark, sf), trusted=True, planted=planted)


@register("s5_ground_truth", """SELECT CAST(s_suppkey AS VARCHAR) AS provider_id, 1 AS label, CASE WHEN s_acctbal < 0 THEN 'deep' ELSE 'shallow' END AS scheme FROM supplier WHERE s_acctbal < 1000
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 0, NULL FROM supplier WHERE s_acctbal > 9000""")
def s5_ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    """A ground-truth file with id lists, a map of traps and a map of schemes, read back as labels and schemes."""
    path = f"{shared_dir(spark)}/truth-{uuid.uuid4().hex}"
    ids = tables.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_acctbal").alias("x"))
    trap = F.struct("id", F.struct(F.lit("clean outlier").alias("description"), F.lit("trap").alias("type")))

    def listed(condition: Column) -> Column:
        return F.collect_list(F.when(condition, F.col("id")))

    whole = ids.agg(
        listed(F.col("x") < 1000).alias("all_bad_actors"), F.map_from_entries(F.collect_list(F.when(F.col("x") > 9000, trap))).alias("clean_providers"),
        F.create_map(F.lit("deep"), listed(F.col("x") < 0), F.lit("shallow"), listed((F.col("x") >= 0) & (F.col("x") < 1000))).alias("schemes"),
    )
    whole.coalesce(1).write.json(path)
    truth = readers.read_ground_truth(spark, path)
    return readers.truth_labels(truth).join(readers.truth_schemes(truth), "provider_id", "left")


@register("s4_provenance", """SELECT 'price list' AS source, 'v' || count(DISTINCT p_brand) AS version, CAST(NULL AS DATE) AS effective_date, TRUE AS authoritative, CAST(count(*) AS INTEGER) AS n_codes FROM part""")
def s4_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """The provenance file beside a price list, read with its declared types."""
    path = f"{shared_dir(spark)}/meta-{uuid.uuid4().hex}"
    told = tables.table(spark, sf, "part").agg(
        F.lit("price list").alias("source"), F.concat(F.lit("v"), F.countDistinct("p_brand").cast("string")).alias("version"),
        F.lit(True).alias("authoritative"), F.count(F.lit(1)).alias("n_codes"),
    )
    told.write.json(path)
    meta = readers.read_fee_meta(spark, path)
    return meta.select("source", "version", F.col("effective_date").cast("date").alias("effective_date"), "authoritative", F.col("n_codes").cast("int").alias("n_codes"))


# ---------------------------------------------------------------- mart

def _mart(spark: SparkSession, sf: str, **results: DataFrame) -> mart.Mart:
    return mart.build(_claims(spark, sf), tables.fee_schedule(spark, sf), PARAMS, **results)


def _scored_mart(spark: SparkSession, sf: str) -> mart.Mart:
    run = _run(spark, sf)
    ml = run.drift.select(
        "provider_id", "provider_name", "specialty", (F.col("kl_divergence") * 1000.0).alias("ml_score"),
        (F.col("kl_divergence") > 0.02).cast("int").alias("ml_is_anomaly"),
    )
    return _mart(
        spark, sf, rule_flags=run.flags, peer_flags=run.peer_flags, provider_metrics=run.metrics, ml_scores=ml,
        risk_scores=run.scores.where(F.col("risk_score") >= PARAMS.worklist_from),
    )


MART = f"{q.SCORES_ALL}, {q.SCHEDULE}"
_SUM = "CAST(sum(c) AS DOUBLE) / 100.0"


@register("s11_mart_row_counts", f"""WITH {MART}
SELECT 'claims' AS table_name, count(*) AS n_rows FROM claims UNION ALL SELECT 'fee_schedule', count(*) FROM schedule
UNION ALL SELECT 'providers', count(DISTINCT provider_id) FROM claims UNION ALL SELECT 'clinics', count(DISTINCT clinic_id) FROM claims
UNION ALL SELECT 'bundle_rules', 1 UNION ALL SELECT 'top_codes', 15 UNION ALL SELECT 'rule_flags', count(*) FROM rule_flags
UNION ALL SELECT 'peer_flags', count(*) FROM peer_flags UNION ALL SELECT 'provider_metrics', count(*) FROM metrics
UNION ALL SELECT 'ml_scores', count(*) FROM drift UNION ALL SELECT 'risk_scores', count(*) FROM ranked""")
def s11_mart_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return mart.row_counts(_scored_mart(spark, sf))


@register("s10_saved_mart", f"""WITH {q.CLAIMS}
SELECT provider_id, specialty, clinic_name, count(*) AS n_claims, {_SUM} AS billed
FROM claims JOIN (SELECT clinic_id, 'Clinic ' || clinic_id AS clinic_name FROM claims GROUP BY clinic_id) USING (clinic_id)
GROUP BY provider_id, specialty, clinic_name""")
def s10_saved_mart(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    from auditlake.functions.numbers import money_sum
    from auditlake.session import shared_dir

    base = f"{shared_dir(spark)}/mart-{uuid.uuid4().hex}"
    mart.save(_mart(spark, sf), base)
    read = {t: spark.read.parquet(f"{base}/{t}") for t in ("claims", "providers", "clinics")}
    billed = read["claims"].groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("n_claims"), money_sum("amount_billed").alias("billed")
    )
    return billed.join(read["providers"], "provider_id").join(read["clinics"], "clinic_id").select(
        "provider_id", "specialty", "clinic_name", "n_claims", "billed"
    )


@register("q01_ranked_worklist", f"""WITH {MART}
SELECT provider_id, provider_name, specialty, risk_score, estimated_exposure, rules_score, peer_score, {rnd('ml_score', 1)} AS ml_score, top_reason
FROM ranked ORDER BY risk_score * log10(1 + estimated_exposure / 1000.0) DESC, provider_id LIMIT 20""")
def q01_ranked_worklist(spark: SparkSession, sf: str) -> DataFrame:
    return mart.worklist(_scored_mart(spark, sf))


@register("q02_impossible_days", f"""WITH {q.BASE}
SELECT provider_id, provider_name, specialty, service_date, minutes AS total_minutes, n AS n_claims, c / 100.0 AS total_billed FROM days WHERE minutes > 1440""")
def q02_impossible_days(spark: SparkSession, sf: str) -> DataFrame:
    return mart.impossible_days(_mart(spark, sf), PARAMS)


@register("q03_duplicate_claims", f"""WITH {q.CLAIMS}, {q.SCHEDULE},
rep AS (SELECT {', '.join(PARAMS.duplicate_keys)}, min(provider_name) AS provider_name, min(specialty) AS specialty, min(fee_code) AS fee_code, count(*) AS n_submissions,
  {_SUM} AS total_billed, min(amount_billed) AS unit_amount FROM claims GROUP BY {', '.join(PARAMS.duplicate_keys)} HAVING count(*) > 1)
SELECT rep.* EXCLUDE (fee_code), fee_description FROM rep JOIN schedule USING (fee_code)""")
def q03_duplicate_claims(spark: SparkSession, sf: str) -> DataFrame:
    return mart.duplicate_claims(_mart(spark, sf), PARAMS)


@register("q04_unbundled_pairs", f"""WITH {q.CLAIMS}, {q.SCHEDULE}
SELECT a.provider_id, a.service_month, a.provider_name, a.specialty, a.fee_code AS component_1, b.fee_code AS component_2, 'Brand#3' AS bundle_code,
  {rnd('a.amount_billed + b.amount_billed', 2)} AS billed_as_components, standard_amount AS bundle_price,
  {rnd('a.amount_billed + b.amount_billed - standard_amount', 2)} AS overcharge, count(*) AS n_pairs
FROM claims a JOIN claims b ON a.provider_id = b.provider_id AND a.service_month = b.service_month AND a.fee_code < b.fee_code
JOIN schedule s ON s.fee_code = 'Brand#3' WHERE a.fee_code = 'Brand#1' AND b.fee_code = 'Brand#2'
GROUP BY a.provider_id, a.service_month, a.provider_name, a.specialty, a.fee_code, b.fee_code, a.amount_billed, b.amount_billed, standard_amount""")
def q04_unbundled_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return mart.unbundled_pairs(_mart(spark, sf), PARAMS)


@register("q05_top_tier_share", f"""WITH {q.METRICS_ALL},
sh AS (SELECT provider_id, provider_name, specialty, {rnd('top_tier_share', 4)} AS share FROM metrics),
mn AS (SELECT specialty, CAST(sum(CAST(round(share * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 10000.0 AS m FROM sh GROUP BY specialty)
SELECT provider_id, provider_name, specialty, {rnd('share * 100.0', 1)} AS pct_top_tier, {rnd('m * 100.0', 1)} AS specialty_avg_pct, {rnd('(share - m) * 100.0', 1)} AS pct_above_avg
FROM sh JOIN mn USING (specialty) WHERE share > m * 1.1""")
def q05_top_tier_share(spark: SparkSession, sf: str) -> DataFrame:
    return mart.top_tier_share(_mart(spark, sf), over=1.1)


@register("q06_busiest_days", f"""WITH {q.BASE}
SELECT provider_id, provider_name, specialty, service_date, n AS n_claims, minutes AS total_minutes, c / 100.0 AS daily_billed FROM days
ORDER BY n DESC, provider_id, service_date LIMIT 30""")
def q06_busiest_days(spark: SparkSession, sf: str) -> DataFrame:
    return mart.busiest_days(_mart(spark, sf))


@register("q07_provider_summary", f"""WITH {q.METRICS_ALL}
SELECT provider_id, provider_name, specialty, total_claims, total_billed, {rnd('avg_billed', 2)} AS avg_per_claim, {rnd('claims_per_day', 2)} AS claims_per_day,
  unique_patients, {rnd('services_per_patient', 2)} AS svc_per_patient, {rnd('top_tier_share * 100.0', 1)} AS top_tier_pct, max_daily_minutes FROM metrics""")
def q07_provider_summary(spark: SparkSession, sf: str) -> DataFrame:
    return mart.provider_summary(_scored_mart(spark, sf))


@register("q08_model_and_peer_overlap", f"""WITH {MART}
SELECT d.provider_id, d.provider_name, d.specialty, {rnd('kl_divergence * 1000.0', 1)} AS ml_score, count(*) AS n_peer_flags,
  string_agg(metric, ' | ' ORDER BY metric) AS flagged_metrics, min(total_billed) AS total_billed
FROM drift d JOIN peer_flags p USING (provider_id) JOIN (SELECT provider_id, total_billed FROM metrics) USING (provider_id)
WHERE kl_divergence > 0.02 GROUP BY d.provider_id, d.provider_name, d.specialty, kl_divergence""")
def q08_model_and_peer_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return mart.model_and_peer_overlap(_scored_mart(spark, sf))


@register("q09_monthly_trend", f"""WITH {q.CLAIMS}
SELECT strftime(service_date, '%Y-%m') AS month, specialty, count(*) AS n_claims, count(DISTINCT provider_id) AS active_providers, {_SUM} AS total_billed,
  {rnd('CAST(sum(c) AS DOUBLE) / 100.0 / count(*)', 2)} AS avg_billed FROM claims GROUP BY 1, 2""")
def q09_monthly_trend(spark: SparkSession, sf: str) -> DataFrame:
    return mart.monthly_trend(_mart(spark, sf))


@register("q10_code_utilisation", f"""WITH {q.CLAIMS}, {q.SCHEDULE}
SELECT fee_code, fee_description, standard_amount, specialty, count(*) AS n_claims,
  {rnd('count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY specialty)', 2)} AS pct_of_specialty
FROM claims JOIN schedule USING (fee_code) GROUP BY fee_code, fee_description, standard_amount, specialty""")
def q10_code_utilisation(spark: SparkSession, sf: str) -> DataFrame:
    return mart.code_utilisation(_mart(spark, sf))


@register("q11_rule_summary", f"""WITH {q.RULES_ALL}
SELECT rule, provider_id, min(provider_name) AS provider_name, min(specialty) AS specialty, count(*) AS n_flag_events,
  {_cents('estimated_exposure')} AS total_exposure, min(evidence) AS evidence FROM rule_flags GROUP BY rule, provider_id""")
def q11_rule_summary(spark: SparkSession, sf: str) -> DataFrame:
    shared = risk.share(_claims(spark, sf), tables.claim_buckets(spark, sf))
    return mart.rule_summary(_mart(spark, sf, rule_flags=risk.all_rule_flags(shared, PARAMS)))


def _reviews(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "events").select(F.col("user_id").alias("provider_id"), F.col("event_type").alias("outcome"))


@register("q12_review_outcomes", f"""WITH {MART}
SELECT event_type AS outcome, count(*) AS n_reviews, count(DISTINCT user_id) AS n_providers, {_cents('estimated_exposure')} AS total_exposure_reviewed
FROM events LEFT JOIN ranked ON user_id = provider_id GROUP BY event_type""")
def q12_review_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return mart.review_outcomes(_scored_mart(spark, sf), _reviews(spark, sf))


@register("q12_reviewed_providers", "SELECT event_type AS outcome, user_id AS provider_id, count(*) AS n_reviews FROM events GROUP BY ALL")
def q12_reviewed_providers(spark: SparkSession, sf: str) -> DataFrame:
    return mart.reviewed_providers(_reviews(spark, sf))
