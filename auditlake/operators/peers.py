"""Provider metrics, robust z-scores inside peer cohorts, peer flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numbers import at_least, rounded
from auditlake.functions.quantiles import group_quantiles, robust_stats
from auditlake.operators import rollups
from auditlake.params import PEER_METRICS, Params
from auditlake.session import materialize

_MAD_SCALE = 0.6745


def with_practice_setting(df: DataFrame, params: Params) -> DataFrame:
    """Part-time or full-time by the share of working days billed, and the cohort key."""
    fraction = F.col("billed_days") / F.lit(params.working_days)
    setting = F.when(fraction < params.part_time_below, "part_time").otherwise("full_time")
    return (
        df.withColumn("active_day_fraction", fraction)
        .withColumn("practice_setting", setting)
        .withColumn("cohort_key", F.concat_ws(" | ", "specialty", "practice_setting"))
    )


def provider_metrics(
    claims: DataFrame, days: DataFrame, codes: DataFrame, people: DataFrame, params: Params
) -> DataFrame:
    """One row per provider with its billing behaviour."""
    top = rollups.top_code_table(claims, params.peer_top_codes)
    joined = (
        people.drop("clinic_id")
        .join(rollups.provider_totals(days), "provider_id")
        .join(rollups.patients_per_provider(claims), "provider_id", "left")
        .join(rollups.codes_per_provider(codes, people, top), "provider_id", "left")
        .fillna(0, subset=["unique_patients", "unique_codes", "top_tier_share"])
    )
    derived = joined.withColumns({
        "claims_per_day": F.col("total_claims") / at_least("billed_days", 1),
        "services_per_patient": F.col("total_claims") / at_least("unique_patients", 1),
    })
    return with_practice_setting(derived, params).select(
        "provider_id", "provider_name", "specialty", "total_claims", "total_billed", "avg_billed",
        "avg_minutes", "unique_patients", "unique_codes", "billed_days", "claims_per_day",
        "services_per_patient", "top_tier_share", "active_day_fraction", "practice_setting",
        "cohort_key", "max_daily_minutes",
    )


def _long(metrics: DataFrame) -> DataFrame:
    """Each metric twice, once in its cohort and once in its specialty."""
    cells = [
        F.struct(F.lit(level).alias("level"), F.col(group).alias("peer_group"), F.lit(m).alias("metric"),
                 F.col(m).cast("double").alias("x"))
        for level, group in (("cohort", "cohort_key"), ("specialty", "specialty"))
        for m in PEER_METRICS
    ]
    return metrics.select("provider_id", F.explode(F.array(*cells)).alias("c")).select("provider_id", "c.*")


def peer_group_stats(metrics: DataFrame) -> DataFrame:
    """Median, MAD, mean and deviation per (level, peer_group, metric)."""
    return robust_stats(_long(metrics), ["level", "peer_group", "metric"], "x")


def _by_group(stats: DataFrame, level: str, key: str) -> DataFrame:
    """One row per peer group with its statistics as a map from metric to struct."""
    entry = F.struct("metric", F.struct("median", "mad", "mean", "deviation"))
    return stats.where(F.col("level") == level).groupBy(F.col("peer_group").alias(key)).agg(
        F.map_from_entries(F.collect_list(entry)).alias(f"{level}_stats"), F.max("group_size").alias(f"{level}_size")
    )


def _z(level: str, metric: str) -> Column:
    s = f"{level}_stats['{metric}']"
    return F.expr(
        f"if({s}.mad = 0, coalesce(try_divide({metric} - {s}.mean, {s}.deviation), 0D), "
        f"{_MAD_SCALE}D * ({metric} - {s}.median) / {s}.mad)"
    )


def cohort_z_scores(metrics: DataFrame, params: Params) -> DataFrame:
    """Metrics with ``z_*`` columns; small cohorts fall back to their whole specialty."""
    stats = materialize(peer_group_stats(metrics))
    wide = metrics.join(_by_group(stats, "cohort", "cohort_key"), "cohort_key").join(
        _by_group(stats, "specialty", "specialty"), "specialty"
    )
    small = F.col("cohort_size") < params.min_cohort
    zs = [
        F.when(small, _z("specialty", m)).otherwise(_z("cohort", m)).alias(f"z_{m}") for m in PEER_METRICS
    ]
    medians = [
        F.expr(f"{level}_stats['{m}'].median").alias(f"{level}_median_{m}")
        for level in ("cohort", "specialty") for m in PEER_METRICS
    ]
    return wide.select(*metrics.columns, "cohort_size", small.alias("cohort_fallback"), *zs, *medians)


def peer_flags(scored: DataFrame, params: Params) -> DataFrame:
    """One row per (provider, metric) above its threshold; deviations below the peers never flag."""
    cells = [
        F.struct(
            F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.col(f"z_{m}").alias("z"),
            F.col(f"cohort_median_{m}").alias("median"), F.col(f"specialty_median_{m}").alias("spec_median"),
        )
        for m in PEER_METRICS
    ]
    limit = F.lit(params.z_threshold)
    for (specialty, metric), raised in params.z_overrides.items():
        limit = F.when(
            (F.col("specialty") == specialty) & (F.col("c.metric") == metric), F.lit(raised)
        ).otherwise(limit)
    return (
        scored.withColumn("c", F.explode(F.array(*cells)))
        .where(F.col("c.z") > limit)
        .select(
            "provider_id", "provider_name", "specialty", "cohort_key", "practice_setting", "c.metric",
            rounded("c.value", 4).alias("provider_value"), rounded("c.median", 4).alias("peer_median"),
            rounded("c.spec_median", 4).alias("specialty_median"), rounded("c.z", 2).alias("z_score"),
            rounded("total_billed", 2).alias("estimated_exposure"), "cohort_size", "cohort_fallback",
        )
    )


def peer_ratios(metrics: DataFrame) -> DataFrame:
    """Each metric as a ratio to its specialty median, banded for display."""
    long = _long(metrics).where(F.col("level") == "specialty").withColumnRenamed("peer_group", "specialty")
    medians = group_quantiles(long, ["specialty", "metric"], "x", {"peer_median": 0.5}).drop("group_size")
    ratio = F.when(F.col("peer_median") > 0, F.col("x") / F.col("peer_median")).otherwise(1.0)
    return (
        long.join(medians, ["specialty", "metric"])
        .withColumn("ratio", ratio)
        .withColumn("band", F.when(ratio > 1.5, "high").when(ratio > 1.0, "above").otherwise("normal"))
        .select("provider_id", "specialty", "metric", F.col("x").alias("provider_value"), "peer_median", "ratio", "band")
    )
