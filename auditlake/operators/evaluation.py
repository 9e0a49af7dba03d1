"""How good were the flags? Labels, confusion counts, calibration, rank scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numbers import rounded
from auditlake.operators.feedback import latest_dispositions
from auditlake.params import Params

BASES = ("ADJUDICATED_OUTCOMES", "AUDITOR_DISPOSITIONS", "SYNTHETIC", "NONE")


def resolve_labels(
    spark,
    outcomes: DataFrame | None = None,
    dispositions: DataFrame | None = None,
    trusted: bool = False,
    planted: DataFrame | None = None,
    universe: DataFrame | None = None,
) -> DataFrame:
    """(provider_id, label, recovered_amount, basis) from the most authoritative source given."""
    amount = F.lit(None).cast("double").alias("recovered_amount")
    if outcomes is not None:
        given = F.col("recovered_amount").cast("double") if "recovered_amount" in outcomes.columns else amount
        return outcomes.select(
            "provider_id", (F.lower("outcome") == "confirmed").cast("int").alias("label"),
            given.alias("recovered_amount"), F.lit(BASES[0]).alias("basis"),
        )
    if trusted and dispositions is not None:
        return latest_dispositions(dispositions).select("provider_id", "label", amount, F.lit(BASES[1]).alias("basis"))
    if planted is not None:
        bad = planted.select("provider_id").distinct().withColumn("label", F.lit(1))
        known = bad if universe is None else universe.select("provider_id").join(bad, "provider_id", "left")
        return known.select(
            "provider_id", F.coalesce("label", F.lit(0)).alias("label"), amount, F.lit(BASES[2]).alias("basis")
        )
    return spark.createDataFrame([], "provider_id string, label int, recovered_amount double, basis string")


def is_validated(basis: str, trusted: bool = False) -> bool:
    return basis == BASES[0] or trusted


def flagged_providers(scores: DataFrame, params: Params) -> DataFrame:
    return scores.where(F.col("risk_score") >= params.worklist_from).select("provider_id").distinct()


def confusion(labels: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row: counts, precision, recall, specificity and F1 (null where undefined)."""
    called = flagged.select("provider_id").distinct().withColumn("called", F.lit(1))
    joined = labels.join(called, "provider_id", "left")
    hit, actual = F.col("called").isNotNull(), F.col("label") == 1
    counts = joined.agg(
        F.count(F.lit(1)).alias("n_labelled"),
        F.count_if(hit & actual).alias("tp"),
        F.count_if(hit & ~actual).alias("fp"),
        F.count_if(~hit & actual).alias("fn"),
        F.count_if(~hit & ~actual).alias("tn"),
    )
    precision = F.try_divide("tp", F.col("tp") + F.col("fp"))
    recall = F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.when((precision > 0) & (recall > 0), F.try_divide(2.0 * precision * recall, precision + recall))
    return counts.select(
        "*",
        rounded(precision, 3).alias("precision"),
        rounded(recall, 3).alias("recall"),
        rounded(F.try_divide("tn", F.col("tn") + F.col("fp")), 3).alias("specificity"),
        rounded(f1, 3).alias("f1"),
    )


def calibration(labels: DataFrame, recovery: DataFrame) -> DataFrame:
    """One row: estimated against actually recovered amounts."""
    both = labels.where(F.col("recovered_amount") > 0).join(
        recovery.select("provider_id", "statutory_recoverable"), "provider_id"
    )
    ratio = F.try_divide("statutory_recoverable", "recovered_amount")
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.avg(ratio), 3).alias("mean_estimate_to_actual_ratio"),
        rounded(F.avg(F.abs(F.col("statutory_recoverable") - F.col("recovered_amount"))), 2).alias("mae"),
    )


def scorecard_rows(ranked: DataFrame, labels: DataFrame, params: Params) -> DataFrame:
    """Rank and score of every labelled provider."""
    joined = labels.select("provider_id", "label").join(
        ranked.select("provider_id", "rank", "risk_score", "estimated_exposure"), "provider_id", "left"
    )
    status = (
        F.when(F.col("rank").isNull(), "not scored")
        .when(F.col("rank") <= 10, "top 10")
        .when(F.col("rank") <= 20, "top 20")
        .otherwise("below top 20")
    )
    false_alarm = (F.col("label") == 0) & (F.col("risk_score") >= params.worklist_from)
    return joined.withColumn("status", status).withColumn(
        "false_positive", F.coalesce(false_alarm, F.lit(False))
    ).fillna(0.0, subset=["risk_score", "estimated_exposure"])


def scorecard(ranked: DataFrame, labels: DataFrame, params: Params) -> DataFrame:
    """One row: detection rate in the top 10 and 20, mean rank, trap false positives."""
    rows = scorecard_rows(ranked, labels, params)
    bad, trap = F.col("label") == 1, F.col("label") == 0
    counts = rows.agg(
        F.count_if(bad).alias("n_total"),
        F.count_if(bad & (F.col("rank") <= 10)).alias("n_caught_10"),
        F.count_if(bad & (F.col("rank") <= 20)).alias("n_caught_20"),
        rounded(F.coalesce(F.avg(F.when(bad, F.col("rank"))), F.lit(9999.0)), 1).alias("avg_rank"),
        F.count_if(trap & F.col("false_positive")).alias("n_fp"),
        F.count_if(trap).alias("n_traps"),
    )
    return counts.select(
        "*",
        rounded(F.try_divide("n_caught_10", "n_total") * 100.0, 1).alias("det_rate_10"),
        rounded(F.try_divide("n_caught_20", "n_total") * 100.0, 1).alias("det_rate_20"),
        F.coalesce(rounded(F.try_divide("n_fp", "n_traps") * 100.0, 1), F.lit(0.0)).alias("fp_rate"),
    )


def unregistered(ranked: DataFrame, labels: DataFrame, top: int = 20) -> DataFrame:
    """Providers near the top that no label covers."""
    return ranked.where(F.col("rank") <= top).select("provider_id").join(
        labels.select("provider_id"), "provider_id", "left_anti"
    )


def scorecard_change(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, baseline, now, delta) of two one-row scorecards."""
    metrics = ["det_rate_10", "det_rate_20", "avg_rank", "fp_rate", "n_fp"]

    def long(card: DataFrame, name: str) -> DataFrame:
        return card.select([F.col(m).cast("double") for m in metrics]).unpivot([], metrics, "metric", name)

    return long(baseline, "baseline").join(long(now, "now"), "metric").withColumn(
        "delta", rounded(F.col("now") - F.col("baseline"), 1)
    )
