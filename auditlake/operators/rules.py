"""Deterministic billing rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numbers import cents, grouped, money_sum, rounded
from auditlake.operators import rollups
from auditlake.params import BundleRule, Params

FLAG_COLUMNS = ("provider_id", "provider_name", "specialty", "rule", "evidence", "estimated_exposure")

# ---- fixed values: evidence formats (shared with stored flag tables) ----
IMPOSSIBLE_DAY_TEXT = "Billed %s service-minutes on %s across %s claims (max 1 440 per day)"
DUPLICATE_TEXT = "%s duplicate claim events (same provider + patient + code + date billed >1 time)"
UNBUNDLING_TEXT = "Billed %s patient-dates with component codes %s instead of bundle %s (%s)"
# ---- end of fixed values ----


def impossible_days(days: DataFrame, people: DataFrame, params: Params) -> DataFrame:
    """Provider days above the minute ceiling, from the daily rollup."""
    return (
        days.where(F.col("minutes") > params.max_day_minutes)
        .join(people.drop("clinic_id"), "provider_id")
        .withColumn("rule", F.lit("impossible_day"))
        .withColumn("estimated_exposure", F.coalesce("billed_cents", F.lit(0)) / 100.0)
        .withColumn(
            "evidence",
            F.format_string(
                IMPOSSIBLE_DAY_TEXT, grouped("minutes"), F.col("service_date").cast("string"),
                F.col("n_claims").cast("string"),
            ),
        )
    )


def duplicate_flags(claims: DataFrame, people: DataFrame, params: Params) -> DataFrame:
    """Per provider: number of duplicate events and one unit amount per event."""
    per_provider = rollups.duplicate_events(claims, params.duplicate_keys).groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("n_events"), money_sum("unit_billed").alias("estimated_exposure")
    )
    return (
        per_provider.join(people.drop("clinic_id"), "provider_id")
        .withColumn("rule", F.lit("duplicate_billing"))
        .withColumn("evidence", F.format_string(DUPLICATE_TEXT, F.col("n_events").cast("string")))
    )


def unbundled_events(claims: DataFrame, rule: BundleRule, keys: tuple[str, ...]) -> DataFrame:
    """Events on ``keys`` where every component of the bundle was billed on its own.

    The codes are filtered before the shuffle; one conditional count per component replaces a set.
    """
    parts = claims.where(F.col("fee_code").isin(*rule.components))
    for key in keys:
        parts = parts.where(F.col(key).isNotNull())
    seen = [F.count_if(F.col("fee_code") == code) for code in rule.components]
    complete = reduce(lambda a, b: a & b, [F.col(f"seen_{i}") > 0 for i in range(len(seen))])
    return (
        parts.groupBy(*keys)
        .agg(money_sum("amount_billed").alias("component_total"), *[s.alias(f"seen_{i}") for i, s in enumerate(seen)])
        .where(complete)
        .select(*keys, "component_total")
    )


def unbundling_flags(claims: DataFrame, people: DataFrame, params: Params) -> DataFrame:
    flags = []
    for rule in params.bundle_rules:
        over = F.greatest(F.col("component_total") - F.lit(rule.bundle_amt), F.lit(0.0))
        flags.append(
            unbundled_events(claims, rule, params.bundle_keys)
            .groupBy("provider_id")
            .agg(F.count(F.lit(1)).alias("n_events"), (F.sum(cents(over)) / 100.0).alias("estimated_exposure"))
            .withColumn("rule", F.lit("unbundling"))
            .withColumn(
                "evidence",
                F.format_string(
                    UNBUNDLING_TEXT, F.col("n_events").cast("string"), F.lit("+".join(rule.components)),
                    F.lit(rule.bundle_code), F.lit(rule.bundle_desc),
                ),
            )
        )
    return reduce(DataFrame.unionByName, flags).join(people.drop("clinic_id"), "provider_id")


def rule_flags(claims: DataFrame, days: DataFrame, people: DataFrame, params: Params) -> DataFrame:
    """All rule flags in one table."""
    found = [
        impossible_days(days, people, params),
        duplicate_flags(claims, people, params),
        unbundling_flags(claims, people, params),
    ]
    return reduce(DataFrame.unionByName, [f.select(*FLAG_COLUMNS) for f in found])


def rule_summary(flags: DataFrame) -> DataFrame:
    return flags.groupBy("rule").agg(
        F.count(F.lit(1)).alias("n_flags"),
        F.count_distinct("provider_id").alias("n_providers"),
        rounded(money_sum("estimated_exposure"), 2).alias("total_exposure"),
    )
