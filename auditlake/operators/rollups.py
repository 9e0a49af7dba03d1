"""Claim rollups: the only operators that read claims at full size.

Everything at provider grain is computed from these.  Each one groups by a key with map-side
combining, so a provider holding a third of all claims costs its tasks no more than the others;
distinct counts go through a grouped (provider, value) table instead of sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.numbers import cents, money_sum
from auditlake.session import materialize, stored, stored_by


def provider_dim(claims: DataFrame) -> DataFrame:
    """One row per provider with its attributes.

    Kept apart from the number rollups: a text value in an aggregate's buffer would turn its hash
    aggregation of all claims into a sort, while the distinct combinations below are few.
    """
    attributes = ("provider_id", "provider_name", "specialty", "clinic_id")
    # the filter keeps the optimizer from folding both steps into one aggregate over all claims
    named = claims.groupBy(*attributes).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
    return named.groupBy("provider_id").agg(
        F.min("provider_name").alias("provider_name"),
        F.min("specialty").alias("specialty"),
        F.min("clinic_id").alias("clinic_id"),
    )


def provider_day(claims: DataFrame) -> DataFrame:
    """One row per provider and service date."""
    return claims.where(F.col("provider_id").isNotNull() & F.col("service_date").isNotNull()).groupBy(
        "provider_id", "service_date"
    ).agg(
        F.count("claim_id").alias("n_claims"),
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum("service_minutes"), F.lit(0.0)).alias("minutes"),
        F.count("service_minutes").alias("n_minutes"),
        F.sum(cents("amount_billed")).alias("billed_cents"),
        F.count("amount_billed").alias("n_amounts"),
        F.max("amount_billed").alias("max_billed"),
        F.avg("amount_billed").alias("billed_mean"),
        (F.var_pop("amount_billed") * F.count("amount_billed")).alias("billed_spread"),
    )


def kept_days(days: DataFrame, buckets: int = 0) -> DataFrame:
    """The daily rollup computed once, in the ``buckets`` of the claims if they have any; a provider has a bounded number of days."""
    return stored_by(days, "days", "provider_id", buckets) if buckets else materialize(days)


def provider_month(days: DataFrame) -> DataFrame:
    """Monthly series from the daily rollup."""
    return days.groupBy("provider_id", F.trunc("service_date", "month").alias("month")).agg(
        F.sum("n_claims").alias("n_claims"),
        (F.coalesce(F.sum("billed_cents"), F.lit(0)) / 100.0).alias("total_billed"),
    )


def claims_per_month(claims: DataFrame) -> DataFrame:
    """The same series straight from claims, where no daily rollup is at hand."""
    return claims.where(F.col("provider_id").isNotNull() & F.col("service_date").isNotNull()).groupBy(
        "provider_id", F.trunc("service_date", "month").alias("month")
    ).agg(F.count("claim_id").alias("n_claims"), money_sum("amount_billed").alias("total_billed"))


def provider_totals(days: DataFrame) -> DataFrame:
    """Amount, minute and day aggregates of each provider, from the daily rollup."""
    n, total = F.col("n_amounts"), F.col("total_billed")
    # squared distances from the provider's mean, day by day: sums of squares would cancel for large, nearly equal amounts
    whole = Window.partitionBy("provider_id")  # one row per day
    mean = F.sum(F.col("billed_mean") * F.col("n_amounts")).over(whole) / F.sum("n_amounts").over(whole)
    gap = F.col("billed_mean") - mean
    days = days.withColumn("spread", F.col("billed_spread") + F.col("n_amounts") * gap * gap)
    return days.groupBy("provider_id").agg(
        F.sum("n_claims").alias("total_claims"),
        (F.coalesce(F.sum("billed_cents"), F.lit(0)) / 100.0).alias("total_billed"),
        F.sum("n_amounts").alias("n_amounts"),
        F.max("max_billed").alias("max_billed"),
        F.sum("spread").alias("spread"),
        F.try_divide(F.sum("minutes"), F.sum("n_minutes")).alias("avg_minutes"),
        F.count(F.lit(1)).alias("billed_days"),
        F.max("minutes").alias("max_daily_minutes"),
    ).withColumns({
        "avg_billed": F.try_divide(total, n),
        "std_billed": F.when(n > 1, F.sqrt(F.col("spread") / (n - 1))),
    }).drop("n_amounts", "spread")


def provider_code(claims: DataFrame) -> DataFrame:
    """Claim counts per provider and code."""
    return claims.where(F.col("fee_code").isNotNull()).groupBy("provider_id", "fee_code").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("amount_billed").alias("n_amounts"),
        money_sum("amount_billed").alias("billed"),
    )


def patients_per_provider(claims: DataFrame) -> DataFrame:
    pairs = claims.where(F.col("patient_id").isNotNull()).select("provider_id", "patient_id").distinct()
    return pairs.groupBy("provider_id").agg(F.count(F.lit(1)).alias("unique_patients"))


def codes_per_provider(codes: DataFrame, people: DataFrame, top_codes: DataFrame) -> DataFrame:
    """Distinct codes and the share of claims on the specialty's own top codes."""
    marked = codes.join(people.select("provider_id", "specialty"), "provider_id").join(
        F.broadcast(top_codes.withColumn("is_top", F.lit(1))), ["specialty", "fee_code"], "left"
    )
    return marked.groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("unique_codes"),
        (F.sum(F.when(F.col("is_top") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("top_tier_share"),
    )


def top_code_table(claims: DataFrame, top_codes: dict[str, tuple[str, ...]]) -> DataFrame:
    """(specialty, fee_code) rows of a parameter; small by construction, hence broadcast."""
    rows = [(s, c) for s, listed in sorted(top_codes.items()) for c in sorted(listed)]
    return claims.sparkSession.createDataFrame(rows, "specialty string, fee_code string")


def duplicate_events(claims: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys billed more than once, with the claim count and the first claim's amount."""
    whole = claims
    for key in keys:
        whole = whole.where(F.col(key).isNotNull())
    # text in the buffer would sort all claims: count first, and look up amounts of the few repeated keys only
    # kept, so the look-up knows how few they are and need not shuffle the claims again
    repeated = stored(whole.groupBy(*keys).agg(F.count("claim_id").alias("n")).where(F.col("n") > 1), "repeated")
    first = F.min(F.struct(F.col("claim_id"), cents("amount_billed").alias("c")))
    amounts = whole.join(repeated, list(keys), "left_semi").groupBy(*keys).agg((first["c"] / 100.0).alias("unit_billed"))
    return repeated.join(amounts, list(keys))
