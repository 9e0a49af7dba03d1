"""Scans, validation, rules, peers, drift, temporal, evidence and recovery."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.numbers import money_sum, rounded
from auditlake.operators import codemix, evidence, peers, quality, report, rollups, rules, statutory, temporal
from auditlake.plans import risk
from auditlake.session import materialize, shared_dir
from auditlake.sources import readers, sinks
from verification import ctes as q
from verification import tables
from verification.catalog import once, register
from verification.ctes import rnd
from verification.tables import PARAMS


def _days(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.provider_day(tables.claims(spark, sf))


@once
def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return tables.stored_claims(spark, sf)


@once
def _shared(spark: SparkSession, sf: str) -> risk.Shared:
    return risk.share(_claims(spark, sf), tables.claim_buckets(spark, sf))


@once
def _people(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(rollups.provider_dim(tables.claims(spark, sf)))


@once
def _inputs(spark: SparkSession, sf: str) -> evidence.Inputs:
    claims = quality.validate_claims(_claims(spark, sf))
    return evidence.Inputs(
        claims, rollups.kept_days(rollups.provider_day(claims), tables.claim_buckets(spark, sf)), materialize(rollups.provider_code(claims)),
        materialize(rollups.provider_dim(claims)),
    )


# ---------------------------------------------------------------- scans and validation

@register("s1_typed_csv_scan", f"""WITH {q.CLAIMS}, {q.RAW}
SELECT fee_code, specialty, count(*) AS n, sum(service_minutes) AS minutes, min(service_date) AS first_date,
  CAST(sum(CAST(round(amount_billed * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS billed
FROM valid GROUP BY fee_code, specialty""")
def s1_typed_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/claims-csv-{uuid.uuid4().hex}"
    sinks.export_csv(tables.raw_claims(spark, sf), path)
    valid = quality.validate_claims(readers.read_claims_csv(spark, path))
    return valid.groupBy("fee_code", "specialty").agg(
        F.count(F.lit(1)).alias("n"), F.sum("service_minutes").alias("minutes"),
        F.min("service_date").alias("first_date"), money_sum("amount_billed").alias("billed"),
    )


@register("s1_mixed_column_order", f"""WITH {q.CLAIMS}, {q.RAW}
SELECT nullif(trim(provider_id), '') AS provider_id, fee_code, count(*) AS n FROM raw GROUP BY 1, 2""")
def s1_mixed_column_order(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the files list the columns the other way round."""
    raw, path = tables.raw_claims(spark, sf), f"{shared_dir(spark)}/claims-csv-{uuid.uuid4().hex}"
    odd = F.pmod(F.xxhash64("claim_id"), F.lit(2)) == 1
    sinks.export_csv(raw.where(odd), f"{path}/one")
    sinks.export_csv(raw.where(~odd).select(*reversed(raw.columns)), f"{path}/two")
    read = readers.read_claims_csv(spark, f"{path}/*")
    known = F.nullif(F.trim("provider_id"), F.lit("")).alias("provider_id")
    return read.groupBy(known, "fee_code").agg(F.count(F.lit(1)).alias("n"))


@register("s2_optional_columns", f"""WITH {q.CLAIMS}, {q.RAW}
SELECT CASE WHEN modifier LIKE '25%' THEN '25' ELSE '' END AS modifier, units, count(*) AS n FROM raw GROUP BY ALL""")
def s2_optional_columns(spark: SparkSession, sf: str) -> DataFrame:
    full = readers.with_optional_columns(tables.raw_claims(spark, sf))
    return full.groupBy("modifier", "units").agg(F.count(F.lit(1)).alias("n"))


@register("s4_fee_lookup", f"""WITH {q.CLAIMS}, {q.SCHEDULE}
SELECT c.fee_code, standard_amount AS scheduled_amount, count(*) AS n
FROM claims c LEFT JOIN (SELECT * FROM schedule WHERE standard_amount < 901) USING (fee_code)
GROUP BY c.fee_code, standard_amount""")
def s4_fee_lookup(spark: SparkSession, sf: str) -> DataFrame:
    cheap = tables.fee_schedule(spark, sf).where(F.col("standard_amount") < 901)
    priced = readers.price_of(tables.claims(spark, sf), cheap.withColumnRenamed("standard_amount", "amount"))
    return priced.groupBy("fee_code", "scheduled_amount").agg(F.count(F.lit(1)).alias("n"))


@register("v1_validated_claims", f"""WITH {q.CLAIMS}, {q.RAW}
SELECT claim_id, provider_id, specialty, patient_id, service_date, fee_code, service_minutes, amount_billed FROM valid""")
def v1_validated_claims(spark: SparkSession, sf: str) -> DataFrame:
    return quality.validate_claims(tables.raw_claims(spark, sf)).select(
        "claim_id", "provider_id", "specialty", "patient_id", "service_date", "fee_code", "service_minutes", "amount_billed"
    )


@register("v5_quality_counts", f"""WITH {q.CLAIMS}, {q.RAW}
SELECT count(*) AS n_rows,
  count(*) FILTER (service_minutes IS NOT NULL AND TRY_CAST(service_minutes AS DOUBLE) IS NULL) AS non_numeric_service_minutes,
  count(*) FILTER (amount_billed IS NOT NULL AND TRY_CAST(amount_billed AS DOUBLE) IS NULL) AS non_numeric_amount_billed,
  count(*) FILTER (TRY_CAST(service_minutes AS DOUBLE) <= 0) AS non_positive_minutes,
  count(*) FILTER (TRY_CAST(amount_billed AS DOUBLE) < 0) AS negative_amounts,
  count(*) FILTER (TRY_CAST(service_date AS DATE) IS NULL) AS bad_dates,
  count(*) FILTER (trim(coalesce(provider_id, '')) = '') AS blank_provider_id,
  count(*) FILTER (trim(coalesce(fee_code, '')) = '') AS blank_fee_code,
  count(*) FILTER (trim(coalesce(specialty, '')) = '') AS blank_specialty FROM raw""")
def v5_quality_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_counts(tables.raw_claims(spark, sf))


@register("v6_null_policies", f"""WITH {q.CLAIMS}, {q.RAW}
SELECT provider_id, count(*) FILTER (service_minutes IS NOT NULL) AS n_rules, count(*) AS n_statistics,
  avg(coalesce(service_minutes, 0)) AS avg_minutes,
  CAST(sum(CAST(round(coalesce(amount_billed, 0) * 100) AS BIGINT)) AS DOUBLE) / 100.0 / count(*) AS avg_billed,
  count(amount_billed) AS n_amounts
FROM valid GROUP BY provider_id""")
def v6_null_policies(spark: SparkSession, sf: str) -> DataFrame:
    valid = quality.validate_claims(tables.raw_claims(spark, sf))
    dropped = quality.for_rules(valid).groupBy("provider_id").agg(F.count(F.lit(1)).alias("n_rules"))
    filled = rollups.provider_totals(rollups.provider_day(quality.for_statistics(valid))).select(
        "provider_id", F.col("total_claims").alias("n_statistics"), "avg_minutes", "avg_billed"
    )
    known = valid.groupBy("provider_id").agg(F.count("amount_billed").alias("n_amounts"))
    return filled.join(dropped, "provider_id", "left").fillna(0, ["n_rules"]).join(known, "provider_id")


@register("v7_valid_risk_scores", """SELECT event_id, CASE WHEN event_type = 'error' OR value IS NULL THEN 0.0
  ELSE greatest(0.0, least(100.0, value * 4 - 20)) END AS risk_score FROM events""")
def v7_valid_risk_scores(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value") * 4 - 20).alias("risk_score")
    )
    return quality.validate_risk_scores(raw)


@register("v7_risk_score_counts", """SELECT count(*) FILTER (event_type = 'error' OR value IS NULL) AS n_missing,
  count(*) FILTER (event_type <> 'error' AND value * 4 - 20 < 0) AS n_negative,
  count(*) FILTER (event_type <> 'error' AND value * 4 - 20 > 100) AS n_over FROM events""")
def v7_risk_score_counts(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value") * 4 - 20).alias("risk_score")
    )
    return quality.risk_score_counts(raw)


@register("v10_provider_slice", f"""WITH {q.CLAIMS}
SELECT claim_id, service_date, fee_code, amount_billed FROM claims WHERE provider_id = 7""")
def v10_provider_slice(spark: SparkSession, sf: str) -> DataFrame:
    from auditlake.operators.scoring import provider_slice

    return provider_slice(tables.claims(spark, sf), 7).select("claim_id", "service_date", "fee_code", "amount_billed")


@register("v12_practice_setting", f"""WITH {q.METRICS_ALL}
SELECT provider_id, {rnd('active_day_fraction', 6)} AS active_day_fraction, practice_setting, cohort_key FROM metrics""")
def v12_practice_setting(spark: SparkSession, sf: str) -> DataFrame:
    per = rollups.provider_totals(_days(spark, sf)).join(_people(spark, sf), "provider_id")
    return peers.with_practice_setting(per, PARAMS).select(
        "provider_id", rounded("active_day_fraction", 6).alias("active_day_fraction"), "practice_setting", "cohort_key"
    )


# ---------------------------------------------------------------- rules

_FLAGS = "provider_id, provider_name, specialty, rule, evidence, estimated_exposure"


@register("a1_impossible_days", f"WITH {q.RULES_ALL} SELECT {_FLAGS} FROM impossible")
def a1_impossible_days(spark: SparkSession, sf: str) -> DataFrame:
    claims = quality.for_rules(quality.validate_claims(tables.claims(spark, sf)))
    return rules.impossible_days(rollups.provider_day(claims), rollups.provider_dim(claims), PARAMS).select(*rules.FLAG_COLUMNS)


@register("a2_duplicate_flags", f"WITH {q.RULES_ALL} SELECT {_FLAGS} FROM dups")
def a2_duplicate_flags(spark: SparkSession, sf: str) -> DataFrame:
    return rules.duplicate_flags(tables.claims(spark, sf), _people(spark, sf), PARAMS).select(*rules.FLAG_COLUMNS)


@register("a3_unbundling_flags", f"WITH {q.RULES_ALL} SELECT {_FLAGS} FROM unbundled")
def a3_unbundling_flags(spark: SparkSession, sf: str) -> DataFrame:
    return rules.unbundling_flags(tables.claims(spark, sf), _people(spark, sf), PARAMS).select(*rules.FLAG_COLUMNS)


@register("a4_rule_flags", f"WITH {q.RULES_ALL} SELECT {_FLAGS} FROM rule_flags")
def a4_rule_flags(spark: SparkSession, sf: str) -> DataFrame:
    claims = quality.for_rules(quality.validate_claims(tables.claims(spark, sf)))
    return rules.rule_flags(claims, rollups.provider_day(claims), rollups.provider_dim(claims), PARAMS)


@register("a4_rule_summary", f"""WITH {q.RULES_ALL}
SELECT rule, count(*) AS n_flags, count(DISTINCT provider_id) AS n_providers,
  CAST(sum(CAST(round(estimated_exposure * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS total_exposure
FROM rule_flags GROUP BY rule""")
def a4_rule_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rules.rule_summary(a4_rule_flags(spark, sf))


# ---------------------------------------------------------------- peers

_METRICS = (
    "provider_id, provider_name, specialty, total_claims, total_billed, avg_billed, avg_minutes, unique_patients, "
    "unique_codes, billed_days, claims_per_day, services_per_patient, top_tier_share, active_day_fraction, "
    "practice_setting, cohort_key, max_daily_minutes"
)


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    claims = quality.for_statistics(quality.validate_claims(_claims(spark, sf)))
    return peers.provider_metrics(
        claims, rollups.provider_day(claims), rollups.provider_code(claims), _people(spark, sf), PARAMS
    )


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(peers.cohort_z_scores(materialize(_metrics(spark, sf)), PARAMS))


@register("a5_provider_metrics", f"WITH {q.METRICS_ALL} SELECT {_METRICS} FROM metrics")
def a5_provider_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf)


@register("a12_top_tier_share", f"WITH {q.METRICS_ALL} SELECT provider_id, unique_codes, top_tier_share FROM metrics")
def a12_top_tier_share(spark: SparkSession, sf: str) -> DataFrame:
    claims = tables.claims(spark, sf)
    return rollups.codes_per_provider(
        rollups.provider_code(claims), _people(spark, sf), rollups.top_code_table(claims, PARAMS.model_top_codes)
    )


@register("a13_cohort_medians", f"""WITH {q.METRICS_ALL}
SELECT 'cohort' AS level, cohort_key AS peer_group, m.metric, median(x) AS median, count(*) AS group_size
FROM ({q._LONG}) m GROUP BY cohort_key, m.metric
UNION ALL SELECT 'specialty', specialty, m.metric, median(x), count(*) FROM ({q._LONG}) m GROUP BY specialty, m.metric""")
def a13_cohort_medians(spark: SparkSession, sf: str) -> DataFrame:
    stats = peers.peer_group_stats(materialize(_metrics(spark, sf)))
    return stats.select("level", "peer_group", "metric", "median", "group_size")


@register("w1_cohort_z_scores", f"""WITH {q.PEERS_ALL}
SELECT provider_id, metric, {rnd('z', 6)} AS z, cohort_size, cohort_fallback FROM zs""")
def w1_cohort_z_scores(spark: SparkSession, sf: str) -> DataFrame:
    wide = _scored(spark, sf)
    names = list(peers.PEER_METRICS)
    return wide.select("provider_id", "cohort_size", "cohort_fallback", *[F.col(f"z_{m}").alias(m) for m in names]).unpivot(
        ["provider_id", "cohort_size", "cohort_fallback"], names, "metric", "z"
    ).withColumn("z", rounded("z", 6))


@register("w3_peer_flags", f"WITH {q.PEERS_ALL} SELECT * FROM peer_flags")
def w3_peer_flags(spark: SparkSession, sf: str) -> DataFrame:
    return peers.peer_flags(_scored(spark, sf), PARAMS)


@register("w14_peer_ratios", f"""WITH {q.PEERS_ALL}
SELECT provider_id, specialty, metric, x AS provider_value, med AS peer_median,
  CASE WHEN med > 0 THEN x / med ELSE 1.0 END AS ratio,
  CASE WHEN med > 0 AND x / med > 1.5 THEN 'high' WHEN med > 0 AND x / med > 1.0 THEN 'above' ELSE 'normal' END AS band
FROM spe_m""")
def w14_peer_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return peers.peer_ratios(materialize(_metrics(spark, sf)))


# ---------------------------------------------------------------- drift and temporal

@register("a14_cohort_reference", f"""WITH {q.DRIFT_ALL}
SELECT DISTINCT cohort_key, fee_code, q AS ref FROM both_sides WHERE q > 0""")
def a14_cohort_reference(spark: SparkSession, sf: str) -> DataFrame:
    shared = _shared(spark, sf)
    metrics = materialize(peers.provider_metrics(shared.claims, shared.days, shared.codes, shared.people, PARAMS))
    freq = codemix.with_cohort(codemix.code_frequencies(shared.codes), metrics)
    return codemix.cohort_reference(freq)


def _drift(spark: SparkSession, sf: str) -> DataFrame:
    shared = _shared(spark, sf)
    metrics = materialize(peers.provider_metrics(shared.claims, shared.days, shared.codes, shared.people, PARAMS))
    return codemix.drift_scores(shared.codes, metrics, PARAMS)


@register("d3_drift_scores", f"WITH {q.DRIFT_ALL} SELECT * FROM drift")
def d3_drift_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf)


@register("d3_drift_flags", f"WITH {q.DRIFT_ALL} SELECT * FROM drift WHERE drift_flag")
def d3_drift_flags(spark: SparkSession, sf: str) -> DataFrame:
    return codemix.drift_flags(_drift(spark, sf))


def _months(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.provider_month(_days(spark, sf))


@register("a15_monthly_series", f"""WITH {q.BASE}, {q.TEMPORAL_CTES}
SELECT provider_id, provider_name, specialty, month, n AS n_claims, billed AS total_billed FROM months""")
def a15_monthly_series(spark: SparkSession, sf: str) -> DataFrame:
    return _months(spark, sf).join(_people(spark, sf).drop("clinic_id"), "provider_id")


@register("w4_monthly_changes", f"""WITH {q.BASE}, {q.TEMPORAL_CTES}
SELECT provider_id, month, {rnd('change', 6)} AS change FROM changes""")
def w4_monthly_changes(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.monthly_changes(_months(spark, sf)).select("provider_id", "month", rounded("change", 6).alias("change"))


@register("w7_temporal_scores", f"WITH {q.BASE}, {q.TEMPORAL_CTES} SELECT * FROM temporal")
def w7_temporal_scores(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.temporal_scores(_months(spark, sf), _people(spark, sf), PARAMS)


@register("w7_temporal_flags", f"WITH {q.BASE}, {q.TEMPORAL_CTES} SELECT * FROM temporal WHERE temporal_flag")
def w7_temporal_flags(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.temporal_flags(temporal.temporal_scores(_months(spark, sf), _people(spark, sf), PARAMS))


# ---------------------------------------------------------------- evidence

_P = PARAMS
_EM, _TOP = q.codes(_P.office_codes), q.codes(_P.office_top_codes)
_FIND = "provider_id, specialty, scheme, evidence, estimated_extra_revenue, support_claims"


def _find(source: str, scheme: str, text: str, extra: str, support: str) -> str:
    return (
        f"SELECT provider_id, specialty, '{scheme}' AS scheme, {text} AS evidence, "
        f"{rnd(f'greatest({extra}, 0.0)', 2)} AS estimated_extra_revenue, CAST({support} AS BIGINT) AS support_claims {source}"
    )


_DOLLARS = "CAST(sum(c) AS DOUBLE) / 100.0"
E_SQL = {
    "e1": f"""{q.CLAIMS}, per AS (SELECT provider_id, min(specialty) AS specialty, count(*) AS n, {_DOLLARS} / count(*) AS price,
  CAST(count(*) FILTER (fee_code IN {_TOP}) AS DOUBLE) / count(*) AS share FROM claims WHERE fee_code IN {_EM} GROUP BY provider_id),
med AS (SELECT *, median(share) OVER (PARTITION BY specialty) AS bs, median(price) OVER (PARTITION BY specialty) AS bp FROM per)
""" + _find(f"FROM med WHERE n >= 25 AND share >= greatest({_P.upcode_share}, bs + {_P.upcode_delta})", evidence.UPCODING,
            f"'Top-tier E/M codes on ' || {q.pct('share')} || ' of ' || n || ' office visits vs ' || specialty || ' cohort median ' || {q.pct('bs')} || '; avg E/M $' || {q.whole('price')} || ' vs cohort $' || {q.whole('bp')}",
            "n * greatest(0.0, price - bp)", "n"),
    "e2": f"""{q.CLAIMS}, per AS (SELECT provider_id, min(specialty) AS specialty, count(*) AS n,
  CAST(count(*) FILTER (fee_code = 'Brand#12') AS DOUBLE) / count(*) AS share FROM claims WHERE fee_code IN {q.codes(_P.therapy_codes)} GROUP BY provider_id),
med AS (SELECT *, median(share) OVER (PARTITION BY specialty) AS bs FROM per)
""" + _find(f"FROM med WHERE n >= 25 AND share >= greatest({_P.therapy_share}, bs + {_P.therapy_delta})", evidence.THERAPY_TIME,
            f"'Billed 60-min psychotherapy (Brand#12) on ' || {q.pct('share')} || ' of ' || n || ' sessions vs cohort median ' || {q.pct('bs')}",
            "n * share * 40.0", "n"),
    "e3": f"{q.RULES_ALL}\n" + _find(
        "FROM bundle_events JOIN names USING (provider_id) GROUP BY provider_id, specialty", evidence.UNBUNDLING,
        "count(*) || ' patient-dates billed Brand#1+Brand#2 separately instead of bundle Brand#3 (Combined service)'",
        "CAST(sum(CAST(round(total * 100) AS BIGINT)) AS DOUBLE) / 100.0 - count(*) * 60000.0", "count(*)"),
    "e4": f"""{q.RULES_ALL}, ev AS (SELECT {', '.join(_P.evidence_duplicate_keys)}, count(*) AS n, list(c ORDER BY claim_id, c)[1] AS fc
  FROM claims GROUP BY {', '.join(_P.evidence_duplicate_keys)} HAVING count(*) > 1)
""" + _find("FROM ev JOIN names USING (provider_id) GROUP BY provider_id, specialty", evidence.DUPLICATES,
            "count(*) || ' claim(s) resubmitted with identical patient, code, date and units (paid more than once)'",
            "CAST(sum((n - 1) * fc) AS DOUBLE) / 100.0", "count(*)"),
    "e5": f"""{q.BASE}, bad AS (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY minutes DESC, service_date) AS k FROM days WHERE minutes > 1440),
per AS (SELECT provider_id, min(specialty) AS specialty, count(*) AS n, {_DOLLARS} AS billed,
  max(minutes) FILTER (k = 1) AS wm, max(bad.n) FILTER (k = 1) AS wn, max(service_date) FILTER (k = 1) AS wd FROM bad GROUP BY provider_id)
""" + _find("FROM per", evidence.IMPOSSIBLE_DAY,
            f"n || ' day(s) over 1440 service-minutes; worst: ' || {q.grouped('wm')} || ' min across ' || wn || ' claims on ' || wd", "billed", "n"),
    "e6": f"""{q.BASE}, per AS (SELECT provider_id, min(specialty) AS specialty, sum(n) AS n, count(*) AS d, {_DOLLARS} / sum(n) AS price,
  CAST(sum(n) AS DOUBLE) / count(*) AS cpd FROM days GROUP BY provider_id),
med AS (SELECT *, median(cpd) OVER (PARTITION BY specialty) AS base FROM per)
""" + _find(f"FROM med WHERE cpd >= {_P.volume_multiple} * base AND cpd >= {_P.volume_floor}", evidence.VOLUME,
            f"{q.fixed('cpd', 1)} || ' claims/active-day vs ' || specialty || ' cohort median ' || {q.fixed('base', 1)} || ' (~' || {q.grouped('floor((cpd - base) * d)')} || ' excess claims)'",
            "(cpd - base) * d * price", "n"),
    "e7": f"""{q.CLAIMS}, per AS (SELECT provider_id, min(specialty) AS specialty, count(*) AS n, {_DOLLARS} AS billed FROM claims
  WHERE fee_code IN {q.codes(_P.imaging_codes)} AND specialty <> 'ASIA' GROUP BY provider_id HAVING count(*) >= 10)
""" + _find("FROM per", evidence.SELF_REFERRAL,
            f"'Billed ' || n || ' high-value MRI/CT studies ($' || {q.grouped('billed')} || ') under the ' || specialty || ' specialty — imaging normally read by ASIA'", "billed", "n"),
    "e8": f"""{q.CLAIMS}, per AS (SELECT provider_id, min(specialty) AS specialty, count(*) AS n, {_DOLLARS} AS billed FROM claims
  WHERE modifier = '25' AND fee_code IN {_EM} GROUP BY provider_id HAVING count(*) >= 15)
""" + _find("FROM per", evidence.MODIFIER,
            f"n || ' office visits billed with modifier 25 (separately-payable E/M) stacked onto same-day procedures ($' || {q.grouped('billed')} || ')'", "billed", "n"),
    "e9": f"""{q.CLAIMS}, sub AS (SELECT *, greatest(median(CAST(units AS DOUBLE)) OVER (PARTITION BY fee_code), 1.0) AS base FROM claims WHERE fee_code IN {q.codes(_P.unit_codes)}),
code AS (SELECT provider_id, fee_code, min(specialty) AS specialty, max(base) AS base, count(*) AS n, avg(CAST(units AS DOUBLE)) AS au,
  sum(greatest(units - base, 0.0)) AS over_units, sum(c / 100.0 / greatest(units, 1)) / count(*) AS unit_price FROM sub GROUP BY provider_id, fee_code),
per AS (SELECT provider_id, min(specialty) AS specialty, sum(n) AS n, sum(over_units * unit_price) AS extra,
  string_agg(fee_code || '(avg ' || {q.fixed('au', 1)} || 'u vs ' || {q.whole('base')} || ')', ', ' ORDER BY fee_code || '(avg ' || {q.fixed('au', 1)} || 'u vs ' || {q.whole('base')} || ')') AS listed
  FROM code WHERE au >= {_P.unit_multiple} * base AND n >= 10 GROUP BY provider_id HAVING sum(n) >= 10)
""" + _find("FROM per", evidence.UNITS, "'Inflated units on dose-based codes: ' || listed", "extra", "n"),
    "e10": f"""{q.CLAIMS}, em AS (SELECT *, 2 * (service_date - (SELECT min(service_date) FROM claims WHERE fee_code IN {_EM})) >
    (SELECT max(service_date) - min(service_date) FROM claims WHERE fee_code IN {_EM}) AS late FROM claims WHERE fee_code IN {_EM}),
per AS (SELECT provider_id, min(specialty) AS specialty, count(*) FILTER (NOT late) AS ne, count(*) FILTER (late) AS nl,
  CAST(count(*) FILTER (NOT late AND fee_code IN {_TOP}) AS DOUBLE) / count(*) FILTER (NOT late) AS se,
  CAST(count(*) FILTER (late AND fee_code IN {_TOP}) AS DOUBLE) / count(*) FILTER (late) AS sl,
  CAST(sum(c) FILTER (NOT late) AS DOUBLE) / (count(*) FILTER (NOT late) * 100.0) AS ae,
  CAST(sum(c) FILTER (late) AS DOUBLE) / (count(*) FILTER (late) * 100.0) AS al FROM em GROUP BY provider_id)
""" + _find(f"FROM per WHERE ne >= 20 AND nl >= 20 AND sl - se >= {_P.escalation_rise} AND sl >= {_P.escalation_late}", evidence.ESCALATION,
            f"'Top-tier E/M share climbed from ' || {q.pct('se')} || ' (early) to ' || {q.pct('sl')} || ' (late); avg visit $' || {q.whole('ae')} || ' → $' || {q.whole('al')}",
            "nl * greatest(0.0, al - ae)", "ne + nl"),
    "e11": f"""{q.CLAIMS}, per AS (SELECT provider_id, min(specialty) AS specialty, count(*) AS n, {_DOLLARS} AS billed FROM claims
  WHERE isodow(service_date) >= 6 GROUP BY provider_id HAVING count(*) >= 20)
""" + _find("FROM per", evidence.WEEKEND,
            f"n || ' claims ($' || {q.grouped('billed')} || ') billed on weekends — unusual for an outpatient ' || specialty || ' practice'", "billed", "n"),
}
FINDINGS = "findings AS (" + "\nUNION ALL ".join(f"SELECT * FROM (WITH {s})" for s in E_SQL.values()) + ")"

for _id, _name in zip(E_SQL, evidence.DETECTORS, strict=True):
    def _detector(spark: SparkSession, sf: str, _name: str = _name) -> DataFrame:
        return evidence.DETECTORS[_name](_inputs(spark, sf), PARAMS)

    register(f"{_id}_{_name}", f"WITH {E_SQL[_id]}")(_detector)


@once
def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(evidence.findings(_inputs(spark, sf), PARAMS))


@register("e12_findings", f"WITH {FINDINGS} SELECT * FROM findings")
def e12_findings(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.findings(_inputs(spark, sf), PARAMS)


_CENTS = "CAST(sum(CAST(round(estimated_extra_revenue * 100) AS BIGINT)) AS DOUBLE) / 100.0"


@register("a18_provider_evidence", f"""WITH {FINDINGS}
SELECT provider_id, specialty, {_CENTS} AS total_extra, count(DISTINCT scheme) AS n_schemes,
  string_agg(DISTINCT scheme, ', ' ORDER BY scheme) AS schemes FROM findings GROUP BY provider_id, specialty""")
def a18_provider_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.provider_evidence(_findings(spark, sf))


@register("a19_scheme_summary", f"""WITH {FINDINGS}
SELECT scheme, count(DISTINCT provider_id) AS providers, {_CENTS} AS total FROM findings GROUP BY scheme""")
def a19_scheme_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.scheme_summary(_findings(spark, sf))


@register("o5_top_per_scheme", f"""WITH {FINDINGS}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY estimated_extra_revenue DESC, provider_id) AS place FROM findings)
WHERE place <= 6""")
def o5_top_per_scheme(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.top_per_scheme(_findings(spark, sf))


@register("o7_truth_check", f"""WITH {FINDINGS}, planted AS (SELECT s_suppkey AS provider_id FROM supplier WHERE s_acctbal < 1000)
SELECT coalesce(f.provider_id, p.provider_id) AS provider_id,
  CASE WHEN f.provider_id IS NULL THEN 'missed' WHEN p.provider_id IS NULL THEN 'not_planted' ELSE 'hit' END AS status
FROM (SELECT DISTINCT provider_id FROM findings WHERE scheme = '{evidence.UPCODING}') f FULL JOIN planted p ON f.provider_id = p.provider_id""")
def o7_truth_check(spark: SparkSession, sf: str) -> DataFrame:
    planted = tables.truth(spark, sf).where(F.col("label") == 1)
    return evidence.truth_check(evidence.upcoding(_inputs(spark, sf), PARAMS), planted)


_REPORT = f"""{q.BASE}, {FINDINGS}, per AS (SELECT provider_id, specialty, {_CENTS} AS total_extra, count(DISTINCT scheme) AS n_schemes,
  string_agg(DISTINCT scheme, ', ' ORDER BY scheme) AS schemes FROM findings GROUP BY provider_id, specialty),
facts AS (SELECT count(*) AS claims, count(DISTINCT provider_id) AS providers, count(DISTINCT specialty) AS specialties, count(DISTINCT fee_code) AS codes,
  min(service_date) AS d1, max(service_date) AS d2 FROM claims),
by_scheme AS (SELECT scheme, count(DISTINCT provider_id) AS providers, {_CENTS} AS total FROM findings GROUP BY scheme),
best AS (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY estimated_extra_revenue DESC, provider_id) AS place FROM findings),
truth_status AS (SELECT CASE WHEN f.provider_id IS NULL THEN 'missed' WHEN s_suppkey IS NULL THEN 'not_planted' ELSE 'hit' END AS status
  FROM (SELECT DISTINCT provider_id FROM findings) f FULL JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000) ON s_suppkey = f.provider_id)"""


@register("s12_report_rows", f"""WITH {_REPORT}
SELECT 'dataset' AS section, 1 AS place, 'claims' AS name, NULL AS detail, claims AS n, CAST(NULL AS DOUBLE) AS amount FROM facts
UNION ALL SELECT 'dataset', 2, 'providers', NULL, providers, NULL FROM facts UNION ALL SELECT 'dataset', 3, 'specialties', NULL, specialties, NULL FROM facts
UNION ALL SELECT 'dataset', 4, 'billing codes', NULL, codes, NULL FROM facts
UNION ALL SELECT 'dataset', 5, 'first day', CAST(CAST(d1 AS DATE) AS VARCHAR), NULL, NULL FROM facts UNION ALL SELECT 'dataset', 6, 'last day', CAST(CAST(d2 AS DATE) AS VARCHAR), NULL, NULL FROM facts
UNION ALL SELECT 'dataset', 7, 'providers with a finding', NULL, count(*), NULL FROM per UNION ALL SELECT 'dataset', 8, 'estimated extra revenue', NULL, NULL, {_CENTS} FROM findings
UNION ALL SELECT 'providers', place, CAST(provider_id AS VARCHAR), specialty || ': ' || schemes, n_schemes, total_extra
  FROM (SELECT *, CAST(row_number() OVER (ORDER BY total_extra DESC, provider_id) AS INTEGER) AS place FROM per) WHERE place <= 25
UNION ALL SELECT 'schemes', CAST(row_number() OVER (ORDER BY total DESC, scheme) AS INTEGER), scheme, NULL, providers, total FROM by_scheme
UNION ALL SELECT 'examples', CAST(place AS INTEGER), CAST(provider_id AS VARCHAR), scheme || ': ' || evidence, support_claims, estimated_extra_revenue FROM best WHERE place <= 6
UNION ALL SELECT 'truth', CASE status WHEN 'hit' THEN 1 WHEN 'missed' THEN 2 ELSE 3 END, status, NULL, count(*), NULL FROM truth_status GROUP BY status""")
def s12_report_rows(spark: SparkSession, sf: str) -> DataFrame:
    given = _inputs(spark, sf)
    planted = tables.truth(spark, sf).where(F.col("label") == 1)
    return report.report_rows(_findings(spark, sf), given.days, given.codes, given.people, planted)


# ---------------------------------------------------------------- statutory recovery

_TAXONOMY = "taxonomy(scheme, concern, circumstances, basis, consult) AS (VALUES " + ", ".join(
    f"('{s}', '{c}', [{', '.join(repr(x) for x in h)}], '{b}', {str(n).upper()})" for s, c, h, b, n in statutory.TAXONOMY
) + ")"
RECOVERY = f"""{q.BASE}, {FINDINGS}, {_TAXONOMY},
exposure AS (
  SELECT provider_id, min(specialty) AS specialty, {_CENTS} AS exposure, count(*) AS n_concerns,
    string_agg(scheme, '; ' ORDER BY scheme) AS concerns,
    array_to_string(list_sort(list_distinct(flatten(list(circumstances)))), '; ') AS hia_circumstances,
    bool_or(consult) AS needs_medical_consult, bool_or(basis = 'documentary') AS has_documentary
  FROM findings JOIN taxonomy USING (scheme) GROUP BY provider_id),
ratios AS (
  SELECT *, least(1.0, exposure / total_billed) AS inflation_ratio FROM exposure
  JOIN (SELECT provider_id, {_DOLLARS} AS total_billed FROM claims GROUP BY provider_id) USING (provider_id)),
asked AS (SELECT CAST(max(service_date) + INTERVAL 1 DAY AS DATE) AS d FROM claims),
spine AS (
  SELECT provider_id, unnest(generate_series(min(service_month), max(service_month), INTERVAL 1 MONTH))::DATE AS month
  FROM claims, asked WHERE service_date BETWEEN CAST(d - INTERVAL 5 YEAR AS DATE) AND d GROUP BY provider_id),
monthly AS (
  SELECT provider_id, service_month AS month, {_DOLLARS} AS billed FROM claims, asked
  WHERE service_date BETWEEN CAST(d - INTERVAL 5 YEAR AS DATE) AND d GROUP BY provider_id, service_month),
filled AS (
  SELECT provider_id, month, coalesce(billed, 0.0) * inflation_ratio AS suspect
  FROM spine LEFT JOIN monthly USING (provider_id, month) JOIN ratios USING (provider_id)),
rolled AS (
  SELECT *, sum(suspect) OVER w AS r, row_number() OVER (PARTITION BY provider_id ORDER BY month) AS k,
    count(*) OVER (PARTITION BY provider_id) AS size, sum(suspect) OVER (PARTITION BY provider_id) AS total,
    min(month) OVER (PARTITION BY provider_id) AS first_month, max(month) OVER (PARTITION BY provider_id) AS last_month
  FROM filled WINDOW w AS (PARTITION BY provider_id ORDER BY month ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY {rnd('r', 6)} DESC, month) AS b FROM rolled WHERE k >= least(24, size)) WHERE b = 1),
windows AS (
  SELECT provider_id, {rnd('CASE WHEN size <= 24 THEN total ELSE r END', 2)} AS recoverable,
    CASE WHEN size <= 24 THEN first_month ELSE CAST(month - INTERVAL 23 MONTH AS DATE) END AS window_start,
    CASE WHEN size <= 24 THEN last_month ELSE month END AS window_end, CAST(least(size, 24) AS INTEGER) AS months_in_window,
    {rnd('greatest(0.0, CASE WHEN size <= 24 THEN 0.0 ELSE total - r END)', 2)} AS outside_window
  FROM best)"""


def _recovery(spark: SparkSession, sf: str) -> DataFrame:
    inputs = _inputs(spark, sf)
    return statutory.statutory_recovery(_findings(spark, sf), inputs.days, PARAMS, statutory.request_date(inputs.days))


@register("t1_classified_findings", f"""WITH {FINDINGS}, {_TAXONOMY}
SELECT provider_id, scheme, concern, array_to_string(circumstances, ',') AS circumstances, basis AS evidence_basis,
  consult AS needs_medical_consult FROM findings JOIN taxonomy USING (scheme)""")
def t1_classified_findings(spark: SparkSession, sf: str) -> DataFrame:
    return statutory.classify(_findings(spark, sf)).select(
        "provider_id", "scheme", "concern", F.array_join("circumstances", ",").alias("circumstances"), "evidence_basis",
        "needs_medical_consult",
    )


@register("t2_inflation_ratios", f"""WITH {RECOVERY}
SELECT provider_id, specialty, exposure, n_concerns, concerns, hia_circumstances, needs_medical_consult, has_documentary,
  total_billed, inflation_ratio FROM ratios""")
def t2_inflation_ratios(spark: SparkSession, sf: str) -> DataFrame:
    inputs = _inputs(spark, sf)
    return statutory.inflation_ratios(statutory.provider_exposure(_findings(spark, sf)), inputs.days).select(
        "provider_id", "specialty", "exposure", "n_concerns", "concerns", "hia_circumstances", "needs_medical_consult",
        "has_documentary", "total_billed", "inflation_ratio",
    )


@register("w8_best_windows", f"WITH {RECOVERY} SELECT * FROM windows")
def w8_best_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _recovery(spark, sf).select(
        "provider_id", "recoverable", "window_start", "window_end", "months_in_window", "outside_window"
    )


def _meta(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(
        F.lit("board_schedule").alias("source"), F.lit("7").alias("version"), F.lit("2000-01-01").alias("effective_date"),
        F.lit(True).alias("authoritative"),
    )


def _pathway_sql(part: int) -> str:
    def text(documentary: bool, high: bool) -> str:
        return "'" + statutory.PATHWAYS[documentary, high][part] + "'"

    high = f"recoverable >= {PARAMS.high_value}"
    return (
        f"CASE WHEN has_documentary AND {high} THEN {text(True, True)} WHEN has_documentary THEN {text(True, False)} "
        f"WHEN {high} THEN {text(False, True)} ELSE {text(False, False)} END"
    )


SUMMARY_SQL = f"""SELECT provider_id, specialty, n_concerns, concerns, {rnd('exposure', 2)} AS estimated_exposure,
  recoverable AS statutory_recoverable, window_start AS recovery_window_start, window_end AS recovery_window_end,
  outside_window AS barred_by_statute, hia_circumstances, needs_medical_consult, {_pathway_sql(0)} AS recommended_next_step,
  {_pathway_sql(1)} AS potential_outcome, 'INDICATIVE' AS figure_status, 'board_schedule v7 effective 2000-01-01' AS fee_schedule,
  TRUE AS fee_schedule_authoritative, FALSE AS recovery_defensible FROM ratios JOIN windows USING (provider_id)"""


@register("t5_recovery_summary", f"WITH {RECOVERY} {SUMMARY_SQL}")
def t5_recovery_summary(spark: SparkSession, sf: str) -> DataFrame:
    stamp = statutory.provenance(_meta(spark), validated=False)
    return statutory.recovery_summary(_recovery(spark, sf), stamp, PARAMS)


# ---------------------------------------------------------------- ordered tables

def _ordered(spark: SparkSession, result: str, df: DataFrame, *ties: str) -> DataFrame:
    """Written in order, read back with the place of each row."""
    path = f"{shared_dir(spark)}/ordered-{uuid.uuid4().hex}"
    sinks.write_ordered(df, result, path, ties)
    return spark.read.parquet(path).select("provider_id", *ties, sinks.ORDERS[result], "place")


def _placed(result: str, table: str, *ties: str) -> str:
    column, tie = sinks.ORDERS[result], ", ".join(["provider_id", *ties])
    return f"SELECT {tie}, {column}, row_number() OVER (ORDER BY {column} DESC NULLS LAST, {tie}) AS place FROM {table}"


@register("o1_ordered_findings", f"WITH {FINDINGS} {_placed('findings', 'findings', 'scheme')}")
def o1_ordered_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _ordered(spark, "findings", _findings(spark, sf), "scheme")


@register("o1_ordered_drift", f"WITH {q.DRIFT_ALL} {_placed('drift', 'drift')}")
def o1_ordered_drift(spark: SparkSession, sf: str) -> DataFrame:
    return _ordered(spark, "drift", _drift(spark, sf))


@register("o1_ordered_temporal", f"WITH {q.BASE}, {q.TEMPORAL_CTES} {_placed('temporal', 'temporal')}")
def o1_ordered_temporal(spark: SparkSession, sf: str) -> DataFrame:
    return _ordered(spark, "temporal", temporal.temporal_scores(_months(spark, sf), _people(spark, sf), PARAMS))


@register("o1_ordered_recovery", f"WITH {RECOVERY}, summary AS ({SUMMARY_SQL}) {_placed('recovery', 'summary')}")
def o1_ordered_recovery(spark: SparkSession, sf: str) -> DataFrame:
    return _ordered(spark, "recovery", t5_recovery_summary(spark, sf))


@register("o2_top_cases", f"WITH {RECOVERY}, summary AS ({SUMMARY_SQL}) SELECT * FROM summary ORDER BY statutory_recoverable DESC, provider_id LIMIT 25")
def o2_top_cases(spark: SparkSession, sf: str) -> DataFrame:
    return statutory.top_cases(t5_recovery_summary(spark, sf), 25)


@register("a27_portfolio", f"""WITH {RECOVERY}, summary AS ({SUMMARY_SQL})
SELECT count(*) AS n_providers, CAST(sum(CAST(round(estimated_exposure * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS exposure,
  CAST(sum(CAST(round(statutory_recoverable * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS recoverable,
  CAST(sum(CAST(round(barred_by_statute * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS barred FROM summary""")
def a27_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    return statutory.portfolio(t5_recovery_summary(spark, sf))
