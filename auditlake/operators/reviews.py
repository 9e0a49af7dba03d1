"""Clinical review of findings that need a medical opinion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.statutory import classify

# ---- fixed values ----
OPINIONS = ("supports_necessity", "not_medically_necessary", "insufficient_info")
# ---- end of fixed values ----


def checked_opinions(rows: DataFrame) -> DataFrame:
    """Rows ready to append; an opinion outside the vocabulary fails the write."""
    failure = F.raise_error(F.concat(F.lit("unknown opinion: "), F.coalesce("opinion", F.lit("null"))))
    known = F.col("opinion").isin(*OPINIONS)
    return rows.withColumn("opinion", F.when(known, F.col("opinion")).otherwise(failure.cast("string")))


def latest_opinions(log: DataFrame) -> DataFrame:
    """The last opinion of each (provider, concern)."""
    return log.groupBy("provider_id", "concern").agg(
        F.max_by("opinion", "seq").alias("opinion"), F.max_by("consultant", "seq").alias("consultant")
    )


def pending_reviews(found: DataFrame, log: DataFrame) -> DataFrame:
    """Findings that need a medical consultant and have no opinion yet."""
    needing = classify(found).where("needs_medical_consult").select("provider_id", F.col("scheme").alias("concern"))
    return needing.join(log.select("provider_id", "concern"), ["provider_id", "concern"], "left_anti")


def opinion_summary(log: DataFrame) -> DataFrame:
    """One row of counts."""
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(F.struct("provider_id", "concern")).alias("reviewed"),
        *[F.count_if(F.col("opinion") == o).alias(n)
          for o, n in zip(OPINIONS, ("supports", "not_necessary", "insufficient"), strict=True)],
    )
