"""Star-schema mart: tables built from results, and its twelve analyst queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions.numbers import money_sum, rounded
from auditlake.operators import rollups
from auditlake.params import Params
from auditlake.sources import sinks


@dataclass(frozen=True)
class Mart:
    """The mart's tables; result tables that were not produced stay None."""

    claims: DataFrame
    fee_schedule: DataFrame
    providers: DataFrame
    clinics: DataFrame
    bundle_rules: DataFrame
    top_codes: DataFrame
    rule_flags: DataFrame | None = None
    peer_flags: DataFrame | None = None
    provider_metrics: DataFrame | None = None
    ml_scores: DataFrame | None = None
    risk_scores: DataFrame | None = None
    explanations: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {name: t for name, t in vars(self).items() if t is not None}


def clinic_dim(claims: DataFrame) -> DataFrame:
    return claims.select("clinic_id").distinct().withColumn("clinic_name", F.concat(F.lit("Clinic "), "clinic_id"))


def bundle_table(spark: SparkSession, params: Params) -> DataFrame:
    """Pairs of components per bundle; small by construction."""
    rows = [
        (a, b, rule.bundle_code, rule.bundle_desc)
        for rule in params.bundle_rules
        for i, a in enumerate(sorted(rule.components))
        for b in sorted(rule.components)[i + 1:]
    ]
    return spark.createDataFrame(rows, "component_1 string, component_2 string, bundle_code string, bundle_description string")


def build(claims: DataFrame, fee_schedule: DataFrame, params: Params, **results: DataFrame) -> Mart:
    spark = claims.sparkSession
    return Mart(
        claims=claims, fee_schedule=fee_schedule, providers=rollups.provider_dim(claims), clinics=clinic_dim(claims),
        bundle_rules=bundle_table(spark, params), top_codes=rollups.top_code_table(claims, params.model_top_codes),
        **results,
    )


def save(mart: Mart, base: str) -> None:
    """Write every table; claims get the month and provider layout."""
    for name, table in mart.tables().items():
        if name == "claims":
            sinks.save_claims_layout(table, f"{base}/claims")
        else:
            sinks.write_table(table, f"{base}/{name}")


def row_counts(mart: Mart) -> DataFrame:
    counted = [
        t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, t in mart.tables().items()
    ]
    out = counted[0]
    for part in counted[1:]:
        out = out.unionByName(part)
    return out


def worklist(mart: Mart, n: int = 20) -> DataFrame:
    """Q01: providers by risk times the logarithm of exposure."""
    weight = F.col("risk_score") * F.log10(1.0 + F.col("estimated_exposure") / 1000.0)
    return (
        mart.risk_scores.orderBy(weight.desc(), "provider_id")
        .limit(n)
        .select(
            "provider_id", "provider_name", "specialty", "risk_score", "estimated_exposure", "rules_score",
            "peer_score", rounded("ml_score", 1).alias("ml_score"), "top_reason",
        )
    )


def _daily(mart: Mart) -> DataFrame:
    days = mart.claims.groupBy("provider_id", "service_date").agg(
        F.sum("service_minutes").alias("total_minutes"),
        F.count(F.lit(1)).alias("n_claims"),
        money_sum("amount_billed").alias("total_billed"),
    )
    return days


def impossible_days(mart: Mart, params: Params) -> DataFrame:
    """Q02: provider days over the minute ceiling, longest first."""
    over = _daily(mart).where(F.col("total_minutes") > params.max_day_minutes)
    return over.join(mart.providers, "provider_id").select(
        "provider_id", "provider_name", "specialty", "service_date", "total_minutes", "n_claims", "total_billed"
    ).orderBy(F.col("total_minutes").desc(), "provider_id", "service_date")


def duplicate_claims(mart: Mart, params: Params) -> DataFrame:
    """Q03: claims submitted more than once, with the code's description.

    The keys determine the code unless a caller groups by something else; then its lowest is shown.
    """
    keys = list(params.duplicate_keys)
    repeated = mart.claims.groupBy(*keys).agg(
        F.min("fee_code").alias("_code"),
        F.count(F.lit(1)).alias("n_submissions"),
        money_sum("amount_billed").alias("total_billed"),
        F.min("amount_billed").alias("unit_amount"),
    ).where(F.col("n_submissions") > 1)
    described = mart.fee_schedule.select(F.col("fee_code").alias("_code"), "fee_description")
    return (
        repeated.join(described, "_code")
        .join(mart.providers.select("provider_id", "provider_name", "specialty"), "provider_id")
        .drop("_code")
        .orderBy(F.col("n_submissions").desc(), F.col("total_billed").desc(), "provider_id")
    )


def unbundled_pairs(mart: Mart, params: Params) -> DataFrame:
    """Q04: component pairs billed at the same event instead of the bundle.

    Codes are narrowed to components first and equal amounts are counted before the join, so pairs
    of repeated claims come back once with their number instead of once each.
    """
    keys = list(params.bundle_keys)

    def side(n: int) -> DataFrame:
        listed = mart.bundle_rules.select(
            F.col(f"component_{n}").alias("fee_code"), "component_1", "component_2", "bundle_code"
        )
        return (
            mart.claims.join(F.broadcast(listed), "fee_code")
            .groupBy(*keys, "component_1", "component_2", "bundle_code", F.col("amount_billed").alias(f"amount_{n}"))
            .agg(F.count(F.lit(1)).alias(f"n_{n}"))
        )

    priced = mart.fee_schedule.select(F.col("fee_code").alias("bundle_code"), F.col("standard_amount").alias("bundle_price"))
    pairs = side(1).join(side(2), [*keys, "component_1", "component_2", "bundle_code"])
    billed = F.col("amount_1") + F.col("amount_2")
    return (
        pairs.join(priced, "bundle_code")
        .join(mart.providers.select("provider_id", "provider_name", "specialty"), "provider_id")
        .select(
            *keys, "provider_name", "specialty", "component_1", "component_2", "bundle_code",
            rounded(billed, 2).alias("billed_as_components"), "bundle_price",
            rounded(billed - F.col("bundle_price"), 2).alias("overcharge"),
            (F.col("n_1") * F.col("n_2")).alias("n_pairs"),
        )
        .orderBy(F.col("overcharge").desc(), "provider_id")
    )


def top_tier_share(mart: Mart, over: float = 1.5) -> DataFrame:
    """Q05: providers whose top-code share is half again above their specialty's mean share."""
    top = F.broadcast(mart.top_codes.withColumn("is_top", F.lit(1)))
    per_code = mart.claims.groupBy("provider_id", "fee_code").agg(F.count(F.lit(1)).alias("n"))
    shares = (
        per_code.join(mart.providers, "provider_id")
        .join(top, ["specialty", "fee_code"], "left")
        .groupBy("provider_id", "specialty", "provider_name")
        .agg(rounded(F.sum(F.when(F.col("is_top") == 1, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("share"))
    )
    # shares have four decimals, so whole ten-thousandths add up exactly in any order
    means = shares.groupBy("specialty").agg(
        (F.sum(F.rint(F.col("share") * 10000.0).cast("long")) / F.count("share") / 10000.0).alias("mean_share")
    )
    return (
        shares.join(means, "specialty")
        .where(F.col("share") > F.col("mean_share") * over)
        .select(
            "provider_id", "provider_name", "specialty",
            rounded(F.col("share") * 100.0, 1).alias("pct_top_tier"),
            rounded(F.col("mean_share") * 100.0, 1).alias("specialty_avg_pct"),
            rounded((F.col("share") - F.col("mean_share")) * 100.0, 1).alias("pct_above_avg"),
        )
        .orderBy(F.col("pct_above_avg").desc(), "provider_id")
    )


def busiest_days(mart: Mart, n: int = 30) -> DataFrame:
    """Q06: the provider days with most claims; the top rows are found before any join."""
    top = _daily(mart).orderBy(F.col("n_claims").desc(), "provider_id", "service_date").limit(n)
    return top.join(mart.providers.select("provider_id", "provider_name", "specialty"), "provider_id").withColumnRenamed(
        "total_billed", "daily_billed"
    )


def provider_summary(mart: Mart) -> DataFrame:
    """Q07: billing behaviour per provider."""
    return mart.provider_metrics.select(
        "provider_id", "provider_name", "specialty", "total_claims", "total_billed",
        rounded("avg_billed", 2).alias("avg_per_claim"),
        rounded("claims_per_day", 2).alias("claims_per_day"), "unique_patients",
        rounded("services_per_patient", 2).alias("svc_per_patient"),
        rounded(F.col("top_tier_share") * 100.0, 1).alias("top_tier_pct"), "max_daily_minutes",
    ).orderBy(F.col("total_billed").desc(), "provider_id")


def model_and_peer_overlap(mart: Mart) -> DataFrame:
    """Q08: providers flagged by the ensemble and by peers."""
    per = mart.peer_flags.groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("n_peer_flags"),
        F.concat_ws(" | ", F.array_sort(F.collect_list("metric"))).alias("flagged_metrics"),
    )
    return (
        mart.ml_scores.where(F.col("ml_is_anomaly") == 1)
        .join(per, "provider_id")
        .join(mart.provider_metrics.select("provider_id", "total_billed"), "provider_id")
        .select(
            "provider_id", "provider_name", "specialty", rounded("ml_score", 1).alias("ml_score"),
            "n_peer_flags", "flagged_metrics", "total_billed",
        )
        .orderBy(F.col("ml_score").desc(), "provider_id")
    )


def monthly_trend(mart: Mart) -> DataFrame:
    """Q09: monthly claims, providers and amounts per specialty, over (provider, month) partials."""
    per = mart.claims.groupBy("provider_id", F.date_format("service_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), money_sum("amount_billed").alias("billed"),
        F.count("amount_billed").alias("n_amounts"),
    )
    return (
        per.join(mart.providers.select("provider_id", "specialty"), "provider_id")
        .groupBy("month", "specialty")
        .agg(
            F.sum("n").alias("n_claims"),
            F.count(F.lit(1)).alias("active_providers"),
            money_sum("billed").alias("total_billed"),
            rounded(F.try_divide(money_sum("billed"), F.sum("n_amounts")), 2).alias("avg_billed"),
        )
        .orderBy("month", "specialty")
    )


def code_utilisation(mart: Mart) -> DataFrame:
    """Q10: share of each code within its specialty; the window runs over the aggregated rows."""
    counted = (
        mart.claims.groupBy("provider_id", "fee_code").agg(F.count(F.lit(1)).alias("n"))
        .join(mart.providers.select("provider_id", "specialty"), "provider_id")
        .groupBy("fee_code", "specialty")
        .agg(F.sum("n").alias("n_claims"))
        .join(mart.fee_schedule.select("fee_code", "fee_description", "standard_amount"), "fee_code")
    )
    total = F.sum("n_claims").over(Window.partitionBy("specialty"))
    return counted.withColumn("pct_of_specialty", rounded(F.col("n_claims") * 100.0 / total, 2)).orderBy(
        "specialty", F.col("pct_of_specialty").desc(), "fee_code"
    )


def rule_summary(mart: Mart) -> DataFrame:
    """Q11: flag events per rule and provider."""
    return mart.rule_flags.groupBy("rule", "provider_id").agg(
        F.min("provider_name").alias("provider_name"),
        F.min("specialty").alias("specialty"),
        F.count(F.lit(1)).alias("n_flag_events"),
        money_sum("estimated_exposure").alias("total_exposure"),
        F.min("evidence").alias("evidence"),
    ).orderBy("rule", F.col("total_exposure").desc(), "provider_id")


def review_outcomes(mart: Mart, reviews: DataFrame) -> DataFrame:
    """Q12: what reviewers concluded, and the exposure they looked at."""
    exposure = mart.risk_scores.select("provider_id", "estimated_exposure")
    per = reviews.groupBy("outcome", "provider_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per.join(exposure, "provider_id", "left")
        .groupBy("outcome")
        .agg(
            F.sum("n").alias("n_reviews"),
            F.count(F.lit(1)).alias("n_providers"),
            money_sum(F.col("estimated_exposure") * F.col("n")).alias("total_exposure_reviewed"),
        )
        .orderBy(F.col("n_reviews").desc(), "outcome")
    )


def reviewed_providers(reviews: DataFrame) -> DataFrame:
    """Q12 detail: the providers behind each outcome, as rows rather than one long text."""
    return reviews.groupBy("outcome", "provider_id").agg(F.count(F.lit(1)).alias("n_reviews"))
