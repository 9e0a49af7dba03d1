"""The aggregates behind the audit views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numbers import money_sum
from auditlake.params import Params


def kpis(scores: DataFrame, params: Params) -> DataFrame:
    """Totals of the flagged providers; proactive ones were found without any rule."""
    flagged = scores.where(F.col("risk_score") >= params.worklist_from)
    proactive = (F.col("rules_score") == 0) & ((F.col("peer_score") > 0) | (F.col("ml_is_anomaly") == 1))
    return flagged.agg(
        money_sum("estimated_exposure").alias("total_exposure"),
        F.count(F.lit(1)).alias("n_flagged"),
        F.count_if(proactive).alias("n_proactive"),
        F.max("estimated_exposure").alias("top_exposure"),
    )


def exposure_by_specialty(listed: DataFrame, n: int = 8) -> DataFrame:
    per = listed.groupBy("specialty").agg(money_sum("estimated_exposure").alias("estimated_exposure"))
    return per.orderBy(F.col("estimated_exposure").desc(), "specialty").limit(n)


def tier_counts(listed: DataFrame) -> DataFrame:
    """Providers per confidence tier, empty tiers included."""
    tiers = listed.sparkSession.createDataFrame([("HIGH",), ("MEDIUM",), ("LOW",)], "confidence string")
    counted = listed.groupBy("confidence").agg(F.count(F.lit(1)).alias("n_providers"))
    return F.broadcast(tiers).join(counted, "confidence", "left").fillna(0, subset=["n_providers"])


def score_histogram(listed: DataFrame, bins: int = 20) -> DataFrame:
    """Providers per equal-width score bin over 0..100."""
    number = F.least(F.floor(F.col("risk_score") / (100.0 / bins)) + 1, F.lit(bins)).cast("int")
    return listed.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n_providers"))


def layer_coverage(listed: DataFrame) -> DataFrame:
    """How many listed providers each layer hit."""
    hits = {
        "Rules": F.col("rules_score") > 0,
        "Peer Stats": F.col("peer_score") > 0,
        "ML Ensemble": F.col("ml_is_anomaly") == 1,
        "Code-Mix": F.col("codemix_flag") == 1,
        "Temporal": F.col("temporal_flag") == 1,
        "Feedback": F.col("feedback_score") > 0,
    }
    wide = listed.agg(*[F.count_if(hit).alias(name) for name, hit in hits.items()])
    return wide.unpivot([], list(hits), "layer", "providers_hit")
