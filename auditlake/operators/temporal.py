"""Change points in each provider's monthly claim series.

A window here holds one provider's months, which the calendar bounds, never its claims.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.numbers import rounded
from auditlake.params import Params


def monthly_changes(months: DataFrame) -> DataFrame:
    """Relative change against the previous active month; the first month has none."""
    order = Window.partitionBy("provider_id").orderBy("month")
    before = F.lag("n_claims").over(order)
    change = F.when(before > 0, (F.col("n_claims") - before) / before).when(before.isNotNull(), 0.0)
    return months.withColumn("change", change)


def cusum(changes: DataFrame) -> DataFrame:
    """Running one-sided sum that restarts at zero: prefix sum minus its running minimum."""
    upto = Window.partitionBy("provider_id").orderBy("month").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    prefixed = changes.withColumn("prefix", F.coalesce(F.sum("change").over(upto), F.lit(0.0)))
    lowest = F.least(F.lit(0.0), F.min("prefix").over(upto))
    return prefixed.withColumn("cusum", F.col("prefix") - lowest)


def temporal_scores(months: DataFrame, people: DataFrame, params: Params) -> DataFrame:
    """CUSUM and spike score per provider with enough active months."""
    per = cusum(monthly_changes(months)).groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("n_active_months"),
        F.max("cusum").alias("cusum_raw"),
        (F.max("n_claims") / F.greatest(F.median("n_claims"), F.lit(1.0))).alias("spike_raw"),
        F.sum(F.rint(F.col("total_billed") * 100.0).cast("long")).alias("billed_cents"),
    ).where(F.col("n_active_months") >= params.min_active_months)
    # prefix differences carry rounding dust: a value that rounds onto the limit has reached it
    change_point = rounded("cusum_raw", 9) >= params.cusum_at
    spike = F.col("spike_raw") >= params.spike_at
    return per.join(people, "provider_id").select(
        "provider_id", "provider_name", "specialty", "n_active_months",
        rounded("cusum_raw", 4).alias("cusum_score"), change_point.alias("cusum_flag"),
        rounded("spike_raw", 4).alias("spike_ratio"), spike.alias("spike_flag"),
        (change_point | spike).alias("temporal_flag"),
        (F.col("billed_cents") / 100.0).alias("estimated_exposure"),
    )


def temporal_flags(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("temporal_flag"))
