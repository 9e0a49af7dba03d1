"""The driver's tables seen as a claims data set, and the parameters that fit them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.params import BundleRule, Params
from auditlake.session import bucket_count, stored, stored_by
from verification.catalog import once

BRANDS = [f"Brand#{i}" for i in range(1, 26)]
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
TOP = {r: tuple(BRANDS[3 * i:3 * i + 3]) for i, r in enumerate(REGIONS)}

PARAMS = Params(
    duplicate_keys=("provider_id", "patient_id", "code_family", "service_month"),
    bundle_keys=("provider_id", "service_month"),
    bundle_rules=(BundleRule(("Brand#1", "Brand#2"), "Brand#3", "Combined service", 60000.0),),
    peer_top_codes=TOP,
    model_top_codes=TOP,
    working_days=1350,
    z_threshold=1.5,
    z_overrides={("ASIA", "claims_per_day"): 2.5},
    kl_above=0.03,
    cosine_above=0.03,
    cusum_at=25.0,
    spike_at=2.2,
    fingerprint_codes=tuple(BRANDS[:15]),
    specialties=REGIONS,
    lof_neighbours=10,
    office_codes=tuple(BRANDS[:9]),
    office_top_codes=tuple(BRANDS[6:9]),
    therapy_codes=tuple(BRANDS[9:12]),
    therapy_long_code="Brand#12",
    therapy_price_gap=40.0,
    imaging_codes=tuple(BRANDS[12:15]),
    imaging_specialty="ASIA",
    unit_codes=tuple(BRANDS[15:20]),
    upcode_share=0.36,
    upcode_delta=0.02,
    therapy_share=0.36,
    therapy_delta=0.03,
    evidence_duplicate_keys=("provider_id", "patient_id", "code_family", "service_month", "units"),
    min_duplicate_events=1,
    volume_multiple=1.02,
    volume_floor=1.0,
    unit_multiple=1.05,
    escalation_rise=0.05,
    escalation_late=0.35,
    high_value=2_000_000.0,
)


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "labels": "doc_id long, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with its declared schema, so no job is spent on inferring it."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("supplier", "nation", "region")}
    return (
        t["supplier"].select("s_suppkey", "s_name", "s_nationkey")
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    )


def _lines(spark: SparkSession, sf_dir: str, buckets: int) -> DataFrame:
    """Lines with their orders and parts, which are looked up by hashes so that no task sorts its lines; dealt by provider."""
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "part")}
    orders = t["orders"].select("o_orderkey", "o_custkey").repartition(buckets, "o_orderkey").hint("shuffle_hash")
    parts = t["part"].select("p_partkey", "p_brand", "p_type").hint("shuffle_hash")
    return (
        # whole days take less room in the shuffles
        t["lineitem"].withColumn("l_shipdate", F.to_date("l_shipdate")).repartition(buckets, "l_orderkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .repartition(buckets, "l_suppkey")
    )


def claims(spark: SparkSession, sf_dir: str, by_provider: bool = False, buckets: int = 0) -> DataFrame:
    """The claims; ``by_provider`` leaves them sorted by provider, by a merge as the last join, ``buckets`` dealt by provider."""
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "part")}
    providers = _providers(spark, sf_dir)
    lines = _lines(spark, sf_dir, buckets) if buckets else (
        t["lineitem"]
        .join(t["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["part"].select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    )
    return (
        lines
        .join(providers.hint("merge") if by_provider else providers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"),
            F.col("l_suppkey").alias("provider_id"),
            F.col("s_name").alias("provider_name"),
            F.col("r_name").alias("specialty"),
            F.col("o_custkey").alias("patient_id"),
            F.to_date("l_shipdate").alias("service_date"),
            F.trunc("l_shipdate", "month").alias("service_month"),
            F.col("p_brand").alias("fee_code"),
            F.col("p_type").alias("code_family"),
            (F.col("l_quantity") * 20).alias("service_minutes"),
            F.col("l_linenumber").alias("units"),
            F.col("l_extendedprice").alias("amount_billed"),
            F.when(F.col("l_returnflag") == "R", "25").otherwise("").alias("modifier"),
            F.col("n_name").alias("clinic_id"),
        )
    )


#: claims of one provider that a single task may still read
PROVIDER_ROWS = 4_000_000


@once
def claim_buckets(spark: SparkSession, sf_dir: str) -> int:
    """Buckets for the claims; 0 if a provider has too many of them for one task."""
    lines = table(spark, sf_dir, "lineitem")
    most = lines.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most")).first()["most"]
    return 0 if (most or 0) > PROVIDER_ROWS else bucket_count(spark, lines.count())


def stored_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims joined once and kept in buckets by provider, so later groupings by provider need no shuffle.

    If a provider has very many claims they are kept as plain Parquet sorted by provider instead: adaptive execution splits
    that provider's partition, and later groupings combine within their tasks before a shuffle.
    """
    buckets = claim_buckets(spark, sf_dir)
    if buckets:
        return stored_by(claims(spark, sf_dir, buckets=buckets), "claims", "provider_id", buckets)
    return stored(claims(spark, sf_dir, by_provider=True), "claims")


def raw_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as text with the defects that real files have."""
    q = F.col("service_minutes")
    return claims(spark, sf_dir).select(
        F.col("claim_id").cast("string").alias("claim_id"),
        F.when(q == 140, F.lit(None)).when(q == 160, "  ").otherwise(F.col("provider_id").cast("string")).alias("provider_id"),
        "provider_name",
        F.when(q == 180, "").otherwise(F.col("specialty")).alias("specialty"),
        F.when(q == 200, F.lit(None)).otherwise(F.col("patient_id").cast("string")).alias("patient_id"),
        F.when(q == 220, "2020-13-45").when(q == 240, F.lit(None))
        .otherwise(F.col("service_date").cast("string")).alias("service_date"),
        F.when(q == 260, F.lit(None)).otherwise(F.col("fee_code")).alias("fee_code"),
        F.when(q == 280, "n/a").when(q == 300, "-5").when(q == 320, "0").when(q == 340, F.lit(None))
        .otherwise(q.cast("string")).alias("service_minutes"),
        F.when(q == 360, "free").when(q == 380, F.concat(F.lit("-"), F.col("amount_billed").cast("string")))
        .otherwise(F.format_string("%.2f", "amount_billed")).alias("amount_billed"),
        F.when(F.col("modifier") == "25", F.when(F.col("units") > 3, "25.0").otherwise("25")).otherwise(
            F.when(F.col("units") == 1, "nan")
        ).alias("modifier"),
        F.col("units").cast("string").alias("units"),
        "clinic_id",
    )


def fee_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fee schedule from the parts: one row per code."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("fee_code")).agg(
        F.concat(F.lit("Service "), F.min("p_type")).alias("fee_description"),
        F.min("p_retailprice").alias("standard_amount"),
    )


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auditor dispositions from the event log."""
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error")).select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("provider_id"),
        F.when(F.col("event_type") == "purchase", "confirmed").otherwise("cleared").alias("outcome"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted labels: providers in debt are bad actors, very rich ones clean traps."""
    balance = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").where((balance < 1000) | (balance > 9000)).select(
        F.col("s_suppkey").alias("provider_id"), F.when(balance < 1000, 1).otherwise(0).alias("label")
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjudicated outcomes with recovered amounts."""
    balance = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").where(balance > 0).select(
        F.col("s_suppkey").alias("provider_id"),
        F.when(balance > 5000, "Confirmed").otherwise("cleared").alias("outcome"),
        (balance * 100.0).alias("recovered_amount"),
    )


def case_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case events: stage changes and acknowledgement marks from the event log."""
    kind = F.col("event_type")
    stage = (
        F.when(kind == "signup", "Initial Action").when(kind == "view", "Full Audit Review")
        .when(kind == "purchase", "Board Hearing").when(kind == "error", "Closed")
    )
    field = F.when(F.col("value") < 15, "ack_received_date").when(F.col("value") < 20, "ack_due_date").otherwise(
        F.when(F.col("value") < 24, "records_requested_date").otherwise("findings_date")
    )
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("provider_id"), F.col("event_id").alias("seq"), day.alias("event_date"),
        F.when(stage.isNull(), "mark").otherwise("stage").alias("kind"), stage.alias("stage"),
        F.when(stage.isNull(), field).alias("field"), F.when(stage.isNull(), day).alias("value"),
    )


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clinical opinions from the event log; the concern follows the event's value."""
    v = F.col("value")
    concern = (
        F.when(v < 8, "Upcoding (E/M complexity inflation)").when(v < 16, "Psychotherapy time inflation")
        .when(v < 30, "Unit / dosage inflation").otherwise("Phantom / excessive claim volume")
    )
    kind = F.col("event_type")
    opinion = (
        F.when(kind == "view", "supports_necessity").when(kind == "click", "not_medically_necessary")
        .otherwise("insufficient_info")
    )
    return table(spark, sf_dir, "events").where(kind.isin("view", "click", "error")).select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("provider_id"), concern.alias("concern"),
        opinion.alias("opinion"), F.concat(F.lit("Dr "), F.col("event_type")).alias("consultant"),
    )
