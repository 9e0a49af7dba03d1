"""SQL fragments the oracles are built from. They share no code with the Spark side."""

from __future__ import annotations

from verification.tables import PARAMS, REGIONS, TOP

METRICS = ("avg_billed", "claims_per_day", "top_tier_share", "services_per_patient", "avg_minutes")


def rnd(expr: str, digits: int) -> str:
    return f"(round_even(({expr}) * {float(10 ** digits)}, 0) / {float(10 ** digits)})"


def codes(listed) -> str:
    return "(" + ", ".join(f"'{c}'" for c in listed) + ")"


def pct(expr: str) -> str:
    return f"CAST(CAST(round_even(({expr}) * 100.0, 0) AS BIGINT) AS VARCHAR) || '%'"


def whole(expr: str) -> str:
    return f"CAST(CAST(round_even(CAST(({expr}) AS DOUBLE), 0) AS BIGINT) AS VARCHAR)"


def grouped(expr: str) -> str:
    return f"format('{{:,}}', CAST(round_even(CAST(({expr}) AS DOUBLE), 0) AS BIGINT))"


def fixed(expr: str, digits: int) -> str:
    return f"printf('%.{digits}f', {rnd(expr, digits)})"


CLAIMS = """claims AS (
  SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_suppkey AS provider_id, s_name AS provider_name,
    r_name AS specialty, o_custkey AS patient_id, CAST(l_shipdate AS DATE) AS service_date,
    CAST(date_trunc('month', l_shipdate) AS DATE) AS service_month, p_brand AS fee_code, p_type AS code_family,
    l_quantity * 20 AS service_minutes, l_linenumber AS units, l_extendedprice AS amount_billed,
    CASE WHEN l_returnflag = 'R' THEN '25' ELSE '' END AS modifier, n_name AS clinic_id,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

RAW = """raw AS (
  SELECT CAST(claim_id AS VARCHAR) AS claim_id,
    CASE WHEN service_minutes = 140 THEN NULL WHEN service_minutes = 160 THEN '  ' ELSE CAST(provider_id AS VARCHAR) END AS provider_id,
    provider_name, CASE WHEN service_minutes = 180 THEN '' ELSE specialty END AS specialty,
    CASE WHEN service_minutes = 200 THEN NULL ELSE CAST(patient_id AS VARCHAR) END AS patient_id,
    CASE WHEN service_minutes = 220 THEN '2020-13-45' WHEN service_minutes = 240 THEN NULL ELSE CAST(service_date AS VARCHAR) END AS service_date,
    CASE WHEN service_minutes = 260 THEN NULL ELSE fee_code END AS fee_code,
    CASE WHEN service_minutes = 280 THEN 'n/a' WHEN service_minutes = 300 THEN '-5' WHEN service_minutes = 320 THEN '0'
      WHEN service_minutes = 340 THEN NULL ELSE CAST(service_minutes AS VARCHAR) END AS service_minutes,
    CASE WHEN service_minutes = 360 THEN 'free' WHEN service_minutes = 380 THEN '-' || CAST(amount_billed AS VARCHAR)
      ELSE CAST(amount_billed AS VARCHAR) END AS amount_billed,
    CASE WHEN modifier = '25' THEN CASE WHEN units > 3 THEN '25.0' ELSE '25' END WHEN units = 1 THEN 'nan' END AS modifier,
    CAST(units AS VARCHAR) AS units, clinic_id
  FROM claims),
valid AS (
  SELECT claim_id, provider_id, specialty, patient_id, TRY_CAST(service_date AS DATE) AS service_date, fee_code,
    TRY_CAST(service_minutes AS DOUBLE) AS service_minutes, TRY_CAST(amount_billed AS DOUBLE) AS amount_billed, modifier
  FROM raw
  WHERE TRY_CAST(service_date AS DATE) IS NOT NULL AND trim(coalesce(provider_id, '')) <> ''
    AND trim(coalesce(fee_code, '')) <> '' AND trim(coalesce(specialty, '')) <> '')"""

DAYS = """days AS (
  SELECT provider_id, service_date, min(provider_name) AS provider_name, min(specialty) AS specialty,
    count(*) AS n, sum(service_minutes) AS minutes, CAST(sum(c) AS BIGINT) AS c
  FROM claims GROUP BY provider_id, service_date)"""

SCHEDULE = """schedule AS (
  SELECT p_brand AS fee_code, 'Service ' || min(p_type) AS fee_description, min(p_retailprice) AS standard_amount
  FROM part GROUP BY p_brand)"""

TOP_CODES = "top_codes(specialty, fee_code) AS (VALUES " + ", ".join(
    f"('{r}', '{c}')" for r in REGIONS for c in TOP[r]
) + ")"

METRIC_CTES = f"""{TOP_CODES},
tops AS (
  SELECT provider_id, CAST(count(t.fee_code) AS DOUBLE) / count(*) AS top_tier_share
  FROM claims LEFT JOIN top_codes t USING (specialty, fee_code) GROUP BY provider_id),
totals AS (
  SELECT provider_id, min(provider_name) AS provider_name, min(specialty) AS specialty, min(clinic_id) AS clinic_id,
    count(*) AS total_claims, CAST(sum(c) AS DOUBLE) / 100.0 AS total_billed,
    CAST(sum(c) AS DOUBLE) / 100.0 / count(*) AS avg_billed, avg(service_minutes) AS avg_minutes,
    count(DISTINCT patient_id) AS unique_patients, count(DISTINCT fee_code) AS unique_codes,
    count(DISTINCT service_date) AS billed_days, stddev_samp(amount_billed) AS std_billed,
    max(amount_billed) AS max_billed
  FROM claims GROUP BY provider_id),
metrics AS (
  SELECT *, CAST(total_claims AS DOUBLE) / greatest(billed_days, 1) AS claims_per_day,
    CAST(total_claims AS DOUBLE) / greatest(unique_patients, 1) AS services_per_patient,
    CAST(billed_days AS DOUBLE) / {PARAMS.working_days} AS active_day_fraction,
    CASE WHEN CAST(billed_days AS DOUBLE) / {PARAMS.working_days} < {PARAMS.part_time_below} THEN 'part_time' ELSE 'full_time' END AS practice_setting,
    specialty || ' | ' || CASE WHEN CAST(billed_days AS DOUBLE) / {PARAMS.working_days} < {PARAMS.part_time_below} THEN 'part_time' ELSE 'full_time' END AS cohort_key
  FROM totals JOIN tops USING (provider_id)
  JOIN (SELECT provider_id, max(minutes) AS max_daily_minutes FROM days GROUP BY provider_id) USING (provider_id))"""

_LONG = "\nUNION ALL ".join(
    f"SELECT provider_id, specialty, cohort_key, '{m}' AS metric, {m} AS x FROM metrics" for m in METRICS
)


def _level(prefix: str, key: str) -> str:
    return f"""{prefix}_m AS (SELECT *, median(x) OVER (PARTITION BY {key}, metric) AS med,
    avg(x) OVER (PARTITION BY {key}, metric) AS mean, stddev_samp(x) OVER (PARTITION BY {key}, metric) AS sd,
    count(*) OVER (PARTITION BY {key}, metric) AS size FROM long),
{prefix}_z AS (SELECT provider_id, metric, x, med, size, CASE WHEN mad = 0 THEN coalesce((x - mean) / nullif(sd, 0), 0)
    ELSE 0.6745 * (x - med) / mad END AS z
  FROM (SELECT *, median(abs(x - med)) OVER (PARTITION BY {key}, metric) AS mad FROM {prefix}_m))"""


Z_CTES = f"""long AS ({_LONG}),
{_level('coh', 'cohort_key')},
{_level('spe', 'specialty')},
zs AS (
  SELECT provider_id, metric, c.x, c.med AS peer_median, s.med AS specialty_median, c.size AS cohort_size,
    c.size < {PARAMS.min_cohort} AS cohort_fallback,
    CASE WHEN c.size < {PARAMS.min_cohort} THEN s.z ELSE c.z END AS z
  FROM coh_z c JOIN spe_z s USING (provider_id, metric)),
peer_flags AS (
  SELECT provider_id, provider_name, specialty, cohort_key, practice_setting, metric,
    {rnd('x', 4)} AS provider_value, {rnd('peer_median', 4)} AS peer_median,
    {rnd('zs.specialty_median', 4)} AS specialty_median, {rnd('z', 2)} AS z_score,
    {rnd('total_billed', 2)} AS estimated_exposure, cohort_size, cohort_fallback
  FROM zs JOIN metrics USING (provider_id)
  WHERE z > CASE WHEN specialty = 'ASIA' AND metric = 'claims_per_day' THEN 2.5 ELSE {PARAMS.z_threshold} END)"""

_DK = ", ".join(PARAMS.duplicate_keys)
_BK = ", ".join(PARAMS.bundle_keys)
RULE_CTES = f"""impossible AS (
  SELECT provider_id, provider_name, specialty, 'impossible_day' AS rule,
    'Billed ' || {grouped('minutes')} || ' service-minutes on ' || service_date || ' across ' || n || ' claims (max 1 440 per day)' AS evidence,
    CAST(c AS DOUBLE) / 100.0 AS estimated_exposure
  FROM days WHERE minutes > 1440),
names AS (SELECT provider_id, min(provider_name) AS provider_name, min(specialty) AS specialty FROM claims GROUP BY provider_id),
dup_events AS (
  SELECT {_DK}, count(*) AS n, list(c ORDER BY claim_id, c)[1] AS first_c FROM claims GROUP BY {_DK} HAVING count(*) > 1),
dups AS (
  SELECT provider_id, provider_name, specialty, 'duplicate_billing' AS rule,
    count(*) || ' duplicate claim events (same provider + patient + code + date billed >1 time)' AS evidence,
    CAST(sum(first_c) AS DOUBLE) / 100.0 AS estimated_exposure
  FROM dup_events JOIN names USING (provider_id) GROUP BY provider_id, provider_name, specialty),
bundle_events AS (
  SELECT {_BK}, CAST(sum(c) AS DOUBLE) / 100.0 AS total FROM claims WHERE fee_code IN ('Brand#1', 'Brand#2')
  GROUP BY {_BK} HAVING count(DISTINCT fee_code) = 2),
unbundled AS (
  SELECT provider_id, provider_name, specialty, 'unbundling' AS rule,
    'Billed ' || count(*) || ' patient-dates with component codes Brand#1+Brand#2 instead of bundle Brand#3 (Combined service)' AS evidence,
    CAST(sum(CAST(round(greatest(total - 60000.0, 0) * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS estimated_exposure
  FROM bundle_events JOIN names USING (provider_id) GROUP BY provider_id, provider_name, specialty),
rule_flags AS (SELECT * FROM impossible UNION ALL SELECT * FROM dups UNION ALL SELECT * FROM unbundled)"""

_E = PARAMS.kl_epsilon
DRIFT_CTES = f"""freq AS (
  SELECT provider_id, fee_code, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY provider_id) AS p
  FROM claims GROUP BY provider_id, fee_code),
all_codes AS (SELECT DISTINCT fee_code FROM claims),
dense AS (
  SELECT m.provider_id, m.cohort_key, a.fee_code, coalesce(f.p, 0.0) AS p
  FROM metrics m CROSS JOIN all_codes a LEFT JOIN freq f ON f.provider_id = m.provider_id AND f.fee_code = a.fee_code),
both_sides AS (SELECT *, median(p) OVER (PARTITION BY cohort_key, fee_code) AS q FROM dense),
smooth AS (
  SELECT *, (p + {_E}) / sum(p + {_E}) OVER (PARTITION BY provider_id) AS sp,
    (q + {_E}) / sum(q + {_E}) OVER (PARTITION BY provider_id) AS sq FROM both_sides),
drift_raw AS (
  SELECT provider_id, sum(sp * ln(sp / sq)) AS kl,
    CASE WHEN sum(p) = 0 OR sum(q) = 0 THEN 1.0 ELSE 1 - sum(p * q) / sqrt(sum(p * p) * sum(q * q)) END AS cosine,
    sum(q) = 0 AS ref_is_zero
  FROM smooth GROUP BY provider_id),
drift AS (
  SELECT provider_id, provider_name, specialty, cohort_key, practice_setting, {rnd('kl', 6)} AS kl_divergence,
    {rnd('cosine', 6)} AS cosine_distance, kl > {PARAMS.kl_above} OR cosine > {PARAMS.cosine_above} AS drift_flag,
    ref_is_zero, total_billed AS estimated_exposure
  FROM drift_raw JOIN metrics USING (provider_id))"""

TEMPORAL_CTES = f"""months AS (
  SELECT provider_id, min(provider_name) AS provider_name, min(specialty) AS specialty, service_month AS month,
    count(*) AS n, CAST(sum(c) AS DOUBLE) / 100.0 AS billed
  FROM claims GROUP BY provider_id, service_month),
changes AS (
  SELECT *, (n - lag(n) OVER w) / CAST(lag(n) OVER w AS DOUBLE) AS change,
    row_number() OVER w AS k FROM months WINDOW w AS (PARTITION BY provider_id ORDER BY month)),
series AS (
  SELECT provider_id, min(provider_name) AS provider_name, min(specialty) AS specialty, count(*) AS n_active_months,
    max(n) AS peak, median(CAST(n AS DOUBLE)) AS med, list(coalesce(change, 0.0) ORDER BY month) AS l,
    CAST(sum(CAST(round(billed * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS estimated_exposure
  FROM changes GROUP BY provider_id HAVING count(*) >= 3),
temporal AS (
  SELECT provider_id, provider_name, specialty, n_active_months, {rnd('top', 4)} AS cusum_score,
    {rnd('top', 9)} >= {PARAMS.cusum_at} AS cusum_flag, {rnd('peak / greatest(med, 1.0)', 4)} AS spike_ratio,
    peak / greatest(med, 1.0) >= {PARAMS.spike_at} AS spike_flag,
    {rnd('top', 9)} >= {PARAMS.cusum_at} OR peak / greatest(med, 1.0) >= {PARAMS.spike_at} AS temporal_flag,
    estimated_exposure
  FROM (SELECT * EXCLUDE (l), list_max(list_reduce(
      list_prepend([0.0], list_transform(l, lambda v: [v])),
      lambda acc, v: list_append(acc, greatest(0.0, acc[-1] + v[1])))) AS top FROM series))"""

SCORE_CTES = f"""rules_part AS (
  SELECT provider_id, least(sum(CASE rule WHEN 'impossible_day' THEN 40.0 WHEN 'duplicate_billing' THEN 35.0 WHEN 'unbundling' THEN 30.0 ELSE 25.0 END), 50.0)::DOUBLE AS rules_score,
    CAST(sum(CAST(round(estimated_exposure * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS rules_exposure,
    string_agg(DISTINCT rule, '; ' ORDER BY rule) AS rules_reasons FROM rule_flags GROUP BY provider_id),
peer_part AS (
  SELECT provider_id, least(sum({rnd('least((abs(z_score) - 3.5) * 2.0 + 5.0, 10.0)', 6)}), 25.0)::DOUBLE AS peer_score,
    CAST(sum(CAST(round(estimated_exposure * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS peer_exposure,
    string_agg(DISTINCT metric, '; ' ORDER BY metric) AS peer_reasons FROM peer_flags GROUP BY provider_id),
fused AS (
  SELECT m.provider_id, m.provider_name, m.specialty, m.clinic_id, m.practice_setting, m.total_billed,
    coalesce(rules_score, 0.0) AS rules_score, coalesce(peer_score, 0.0) AS peer_score, 0.0::DOUBLE AS ml_score, 0 AS ml_is_anomaly,
    coalesce({rnd('least(kl_divergence, 1.0) * 10.0', 2)}, 0.0) AS codemix_score, coalesce(CAST(drift_flag AS INTEGER), 0) AS codemix_flag,
    coalesce(kl_divergence, 0.0) AS kl_divergence, coalesce(cosine_distance, 0.0) AS cosine_distance,
    coalesce({rnd('least(' + rnd('least(cusum_score, 6.0) / 6.0 * 5.0', 2) + ' + CAST(CAST(spike_flag AS INTEGER) AS DOUBLE), 5.0)', 2)}, 0.0) AS temporal_score,
    coalesce(CAST(temporal_flag AS INTEGER), 0) AS temporal_flag, 0.0::DOUBLE AS feedback_score, 0 AS feedback_label,
    coalesce(rules_exposure, peer_exposure, {rnd('m.total_billed * 0.1', 6)}, 0.0) AS estimated_exposure,
    rules_reasons, peer_reasons
  FROM metrics m LEFT JOIN rules_part USING (provider_id) LEFT JOIN peer_part USING (provider_id)
  LEFT JOIN drift USING (provider_id) LEFT JOIN temporal USING (provider_id)),
scores AS (
  SELECT *, {rnd("least(" + rnd("rules_score + peer_score + codemix_score + temporal_score", 6) + ", 100.0)", 1)} AS risk_score,
    CASE WHEN rules_score > 0 THEN 'HIGH' WHEN CAST(peer_score > 0 AS INTEGER) + codemix_flag + temporal_flag >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
    {rnd("estimated_exposure * CASE WHEN rules_score > 0 THEN 0.7 WHEN CAST(peer_score > 0 AS INTEGER) + codemix_flag + temporal_flag >= 2 THEN 0.4 ELSE 0.15 END", 2)} AS expected_recovery,
    coalesce(nullif(concat_ws(' | ', 'Rule: ' || rules_reasons, 'Peer z>3: ' || peer_reasons,
      CASE WHEN codemix_flag = 1 THEN 'Code-mix drift KL=' || {fixed('kl_divergence', 3)} END,
      CASE WHEN temporal_flag = 1 THEN 'Temporal change-point' END), ''), 'no flags') AS top_reason
  FROM fused),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY {rnd("risk_score * ln(1 + expected_recovery / 1000.0)", 6)} DESC, provider_id) AS rank
  FROM scores WHERE risk_score >= {PARAMS.worklist_from})"""

BASE = f"{CLAIMS},\n{DAYS}"
METRICS_ALL = f"{BASE},\n{METRIC_CTES}"
PEERS_ALL = f"{METRICS_ALL},\n{Z_CTES}"
RULES_ALL = f"{BASE},\n{RULE_CTES}"
DRIFT_ALL = f"{METRICS_ALL},\n{DRIFT_CTES}"
SCORES_ALL = f"{PEERS_ALL},\n{RULE_CTES},\n{DRIFT_CTES},\n{TEMPORAL_CTES},\n{SCORE_CTES}"
WORKLIST = (
    "provider_id, provider_name, specialty, risk_score, confidence, estimated_exposure, expected_recovery, "
    "rules_score, peer_score, ml_score, ml_is_anomaly, codemix_score, codemix_flag, kl_divergence, "
    "cosine_distance, temporal_score, temporal_flag, feedback_score, feedback_label, top_reason"
)
