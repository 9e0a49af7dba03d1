"""Case state, clinical reviews, letters, the event chain and the streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import cases, chain, chain_store, reviews
from auditlake.session import materialize, shared_dir
from auditlake.sources import sinks
from auditlake.streaming import streams
from verification import tables
from verification.batch_queries import FINDINGS, _findings, t5_recovery_summary
from verification.catalog import once, register
from verification.tables import PARAMS

CASE_SQL = """ev AS (
  SELECT user_id AS provider_id, event_id AS seq, CAST(ts AS DATE) AS event_date,
    CASE event_type WHEN 'signup' THEN 'Initial Action' WHEN 'view' THEN 'Full Audit Review' WHEN 'purchase' THEN 'Board Hearing' WHEN 'error' THEN 'Closed' END AS stage,
    CASE WHEN event_type = 'click' THEN CASE WHEN value < 15 THEN 'ack_received_date' WHEN value < 20 THEN 'ack_due_date' WHEN value < 24 THEN 'records_requested_date' ELSE 'findings_date' END END AS field
  FROM events),
firsts AS (
  SELECT provider_id, min(seq) FILTER (stage = 'Full Audit Review') AS rs, min(seq) FILTER (stage = 'Board Hearing') AS hs,
    min(seq) FILTER (field = 'records_requested_date') AS qs FROM ev GROUP BY provider_id),
eff AS (
  SELECT ev.*, CASE WHEN stage = 'Full Audit Review' AND seq = rs AND (qs IS NULL OR rs < qs) THEN TRUE ELSE FALSE END AS opens,
    CASE WHEN stage = 'Board Hearing' AND seq = hs THEN TRUE ELSE FALSE END AS first_hearing FROM ev JOIN firsts USING (provider_id)),
cases AS (
  SELECT provider_id, coalesce(arg_max(stage, seq) FILTER (stage IS NOT NULL), 'Initial Action') AS stage,
    coalesce(arg_max(CASE stage WHEN 'Initial Action' THEN 'preliminary_review' WHEN 'Full Audit Review' THEN 'records_requested' WHEN 'Board Hearing' THEN 'hsarb_referred' WHEN 'Closed' THEN 'closed' END, seq)
      FILTER (stage <> 'Full Audit Review' OR opens), 'preliminary_review') AS status,
    CAST(NULL AS DATE) AS review_request_date,
    arg_max(event_date, seq) FILTER (field = 'records_requested_date' OR opens) AS records_requested_date,
    arg_max(CASE WHEN opens THEN event_date + 14 ELSE event_date END, seq) FILTER (field = 'ack_due_date' OR opens) AS ack_due_date,
    arg_max(event_date, seq) FILTER (field = 'ack_received_date') AS ack_received_date,
    arg_max(event_date, seq) FILTER (field = 'findings_date') AS findings_date,
    min(event_date) FILTER (first_hearing) AS gm_opinion_date,
    max(event_date) AS updated_date
  FROM eff GROUP BY provider_id)"""


def _states(spark: SparkSession, sf: str) -> DataFrame:
    return cases.case_states(cases.checked_events(tables.case_events(spark, sf)), PARAMS)


@register("c1_case_states", f"WITH {CASE_SQL} SELECT * FROM cases")
def c1_case_states(spark: SparkSession, sf: str) -> DataFrame:
    return _states(spark, sf)


@register("c1_default_cases", f"""WITH {CASE_SQL}
SELECT c_custkey AS provider_id, coalesce(stage, 'Initial Action') AS stage, coalesce(status, 'preliminary_review') AS status FROM customer LEFT JOIN cases ON c_custkey = provider_id""")
def c1_default_cases(spark: SparkSession, sf: str) -> DataFrame:
    people = spark.read.schema("c_custkey long").parquet(f"{sf}/customer.parquet").withColumnRenamed("c_custkey", "provider_id")
    return cases.with_default_cases(people, _states(spark, sf)).select("provider_id", "stage", "status")


@register("c4_overdue_cases", f"""WITH {CASE_SQL}
SELECT provider_id, stage, ack_due_date FROM cases WHERE ack_received_date IS NULL AND ack_due_date < DATE '2024-02-20'""")
def c4_overdue_cases(spark: SparkSession, sf: str) -> DataFrame:
    late = cases.overdue_cases(_states(spark, sf), F.to_date(F.lit("2024-02-20")))
    return late.select("provider_id", "stage", "ack_due_date")


@register("c3_correspondence", "SELECT event_id AS seq, user_id AS provider_id, event_type AS kind FROM events WHERE user_id = 8 ORDER BY event_id DESC")
def c3_correspondence(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("provider_id"), F.col("event_type").alias("kind")
    )
    return cases.correspondence(log, 8)


@register("c8_letters")
def c8_letters(spark: SparkSession, sf: str) -> DataFrame:
    states, recovery = _states(spark, sf), t5_recovery_summary(spark, sf)
    as_of = F.to_date(F.lit("2024-02-20"))
    out = None
    for kind in cases.LETTER_KINDS:
        made = cases.letters(states, recovery, kind, as_of, PARAMS)
        out = made if out is None else out.unionByName(made)
    return out


# ---------------------------------------------------------------- clinical reviews

OPINION_SQL = """op AS (SELECT event_id AS seq, user_id AS provider_id,
  CASE WHEN value < 8 THEN 'Upcoding (E/M complexity inflation)' WHEN value < 16 THEN 'Psychotherapy time inflation'
    WHEN value < 30 THEN 'Unit / dosage inflation' ELSE 'Phantom / excessive claim volume' END AS concern,
  CASE event_type WHEN 'view' THEN 'supports_necessity' WHEN 'click' THEN 'not_medically_necessary' ELSE 'insufficient_info' END AS opinion,
  'Dr ' || event_type AS consultant FROM events WHERE event_type IN ('view', 'click', 'error'))"""


@register("w10_latest_opinions", f"""WITH {OPINION_SQL}
SELECT provider_id, concern, arg_max(opinion, seq) AS opinion, arg_max(consultant, seq) AS consultant FROM op GROUP BY provider_id, concern""")
def w10_latest_opinions(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.latest_opinions(reviews.checked_opinions(tables.opinions(spark, sf)))


@register("c5_pending_reviews", f"""WITH {FINDINGS}, {OPINION_SQL}
SELECT provider_id, scheme AS concern FROM findings f WHERE scheme NOT IN ('Impossible day (>24h billed)', 'Duplicate claim resubmission',
  'Unbundling component codes', 'Weekend / closed-office billing')
  AND NOT EXISTS (SELECT 1 FROM op WHERE op.provider_id = f.provider_id AND op.concern = f.scheme)""")
def c5_pending_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.pending_reviews(_findings(spark, sf), tables.opinions(spark, sf))


@register("a23_opinion_summary", f"""WITH {OPINION_SQL}
SELECT count(*) AS total, count(DISTINCT (provider_id, concern)) AS reviewed, count(*) FILTER (opinion = 'supports_necessity') AS supports,
  count(*) FILTER (opinion = 'not_medically_necessary') AS not_necessary, count(*) FILTER (opinion = 'insufficient_info') AS insufficient FROM op""")
def a23_opinion_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.opinion_summary(tables.opinions(spark, sf))


# ---------------------------------------------------------------- event chain

_FIELDS = ("event_type", "provider_id", "reasoning")
CHAIN_SQL = """log AS (SELECT event_id AS seq, event_id // 256 AS segment, event_type, user_id AS provider_id, props AS reasoning,
  to_json({'event_type': event_type, 'provider_id': user_id, 'reasoning': props})::VARCHAR AS t FROM events),
seg AS (SELECT segment, list(seq ORDER BY seq) AS seqs, list(t ORDER BY seq) AS ts FROM log GROUP BY segment),
hashed AS (SELECT segment, seqs, list_reduce(list_prepend([repeat('0', 64)], list_transform(ts, lambda t: [t])),
  lambda acc, t: list_append(acc, sha256(acc[-1] || t[1]))) AS h FROM seg),
flat AS (SELECT segment, unnest(seqs) AS seq, unnest(h[1:len(seqs)]) AS prev_hash, unnest(h[2:]) AS row_hash FROM hashed)"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), "event_type", F.col("user_id").alias("provider_id"), F.col("props").alias("reasoning")
    )


@once
def _log(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(chain.chained(_events(spark, sf), _FIELDS))


@register("c6_chain", f"WITH {CHAIN_SQL} SELECT seq, event_type, provider_id, reasoning, segment, prev_hash, row_hash FROM log JOIN flat USING (seq, segment)")
def c6_chain(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf)


@register("c6_appended_chain", f"WITH {CHAIN_SQL} SELECT seq, event_type, provider_id, reasoning, segment, prev_hash, row_hash FROM log JOIN flat USING (seq, segment)")
def c6_appended_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The whole log, appended in three batches that cut segments, one of them tried twice: the hashes are those of one pass."""
    base = f"{shared_dir(spark)}/chain-{uuid.uuid4().hex}"
    events = _events(spark, sf)
    last = events.agg(F.max("seq")).first()[0]
    for upto in (last // 3, last // 3 * 2, last // 3 * 2, last):
        chain_store.append(spark, base, events.where(F.col("seq") <= upto), _FIELDS)
    return chain_store.read_log(spark, base)


@register("c6_verify_intact", "SELECT TRUE AS ok, count(*) AS total_rows, CAST(NULL AS BIGINT) AS first_bad_id, 'intact' AS verdict FROM events")
def c6_verify_intact(spark: SparkSession, sf: str) -> DataFrame:
    return chain.verify(_log(spark, sf), _FIELDS)


@register("w15_verify_tampered", """SELECT FALSE AS ok, count(*) AS total_rows, min(event_id) FILTER (value > 60) AS first_bad_id, 'tampered' AS verdict FROM events""")
def w15_verify_tampered(spark: SparkSession, sf: str) -> DataFrame:
    touched = tables.table(spark, sf, "events").where(F.col("value") > 60).select(F.col("event_id").alias("seq"), F.lit(True).alias("hit"))
    altered = _log(spark, sf).join(touched, "seq", "left").withColumn(
        "reasoning", F.when(F.col("hit"), "rewritten").otherwise(F.col("reasoning"))
    ).drop("hit")
    return chain.verify(altered, _FIELDS)


@once
def _seals(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(chain.seal_segments(_log(spark, sf)))


@register("w15_verify_removed", """WITH gone AS (SELECT event_id, event_id // 256 AS segment FROM events WHERE value > 60),
kept AS (SELECT event_id, event_id // 256 AS segment FROM events WHERE NOT coalesce(value > 60, false)),
bad AS (SELECT coalesce(min(k.event_id) FILTER (k.event_id > g.event_id), max(k.event_id) + 1, g.segment * 256) AS id,
  CASE WHEN min(k.event_id) FILTER (k.event_id > g.event_id) IS NULL THEN 'removed' ELSE 'break' END AS problem
  FROM gone g LEFT JOIN kept k ON k.segment = g.segment GROUP BY g.event_id, g.segment)
SELECT FALSE AS ok, (SELECT count(*) FROM kept) AS total_rows, min(id) AS first_bad_id, arg_min(problem, id) AS verdict FROM bad""")
def w15_verify_removed(spark: SparkSession, sf: str) -> DataFrame:
    removed = tables.table(spark, sf, "events").where(F.col("value") > 60).select(F.col("event_id").alias("seq"))
    return chain.verify(_log(spark, sf).join(removed, "seq", "left_anti"), _FIELDS, seals=_seals(spark, sf))


@register("w15_verify_cut", """SELECT FALSE AS ok, count(*) FILTER (event_id % 256 <> 255 AND event_id // 256 <> 1) AS total_rows,
  255 AS first_bad_id, 'removed' AS verdict FROM events""")
def w15_verify_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Last rows of segments and a whole segment are gone: the rows left are linked without a fault."""
    left = _log(spark, sf).where("seq % 256 <> 255 and segment <> 1")
    return chain.verify(left, _FIELDS, seals=_seals(spark, sf))


@register("c6_broken_seals", "SELECT DISTINCT event_id // 256 AS segment FROM events WHERE value > 90")
def c6_broken_seals(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    whole = tables.table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / chain.SEGMENT).alias("segment")).agg(
        F.max("value").alias("top")
    )
    # rewriting a segment with consistent hashes fools the row check but not the seals
    forged = log.join(whole, "segment").withColumn(
        "row_hash", F.when(F.col("top") > 90, F.sha2(F.concat("row_hash", F.lit("x")).cast("binary"), 256)).otherwise(F.col("row_hash"))
    ).drop("top")
    return chain.verify_seals(forged, _seals(spark, sf))


@register("o4_newest_entries", "SELECT event_id AS seq, event_type, user_id AS provider_id, props AS reasoning FROM events ORDER BY event_id DESC LIMIT 100")
def o4_newest_entries(spark: SparkSession, sf: str) -> DataFrame:
    return chain.newest(_log(spark, sf), 100)


@register("s13_log_export", f"WITH {CHAIN_SQL} SELECT CAST(seq AS VARCHAR) AS seq, event_type, row_hash FROM log JOIN flat USING (seq, segment)")
def s13_log_export(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/log-csv-{uuid.uuid4().hex}"
    sinks.export_csv(_log(spark, sf).select("seq", "event_type", "row_hash"), path, order_by="seq")
    return spark.read.option("header", True).schema("seq string, event_type string, row_hash string").csv(path)


@register("s8_appended_dispositions", """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN event_type = 'purchase' THEN 'confirmed' ELSE 'cleared' END AS outcome
  FROM events WHERE event_type IN ('purchase', 'error') UNION ALL SELECT 'cleared' FROM events WHERE event_type = 'error') GROUP BY outcome""")
def s8_appended_dispositions(spark: SparkSession, sf: str) -> DataFrame:
    from auditlake.operators.feedback import checked_dispositions

    path = f"{shared_dir(spark)}/dispositions-{uuid.uuid4().hex}"
    rows = tables.dispositions(spark, sf)
    sinks.append_table(checked_dispositions(rows), path)
    sinks.append_table(checked_dispositions(rows.where(F.col("outcome") == "cleared")), path)
    return spark.read.schema("seq long, provider_id long, outcome string").parquet(path).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n")
    )


# ---------------------------------------------------------------- streaming

def _stream(spark: SparkSession, sf: str) -> DataFrame:
    # the stream source wants a folder or pattern, so the one file is named by a pattern
    events = streams.read_table_stream(spark, f"{sf}/events.parque[t]", tables.SCHEMAS["events"])
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


@register("st1_daily_alerts", """SELECT CAST(ts AS DATE) AS day, user_id, CAST(sum(CAST(round_even(value * 100, 0) AS BIGINT)) AS DOUBLE) / 100.0 AS total, count(*) AS n_events
FROM events GROUP BY 1, 2 HAVING sum(CAST(round_even(value * 100, 0) AS BIGINT)) > 6000
  AND CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def st1_daily_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return streams.run_once(streams.daily_alerts(_stream(spark, sf), 60.0))


@register("st2_first_arrivals", "SELECT DISTINCT user_id, event_type, props FROM events")
def st2_first_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    return streams.run_once(streams.first_arrivals(_stream(spark, sf), ["user_id", "event_type", "props"]))


@register("st3_latest_states", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, arg_max(event_id, (ts, event_id)) AS last_event_id, count(*) AS n_events FROM events GROUP BY user_id")
def st3_latest_states(spark: SparkSession, sf: str) -> DataFrame:
    states = streams.run_once(streams.latest_states(_stream(spark, sf)), mode="update", keys=("user_id",))
    return states.where("not expired").drop("expired")
