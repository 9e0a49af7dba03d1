"""Fusion of all layers into a 0-100 risk score, tier, expected recovery and worklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numbers import at_most, fixed, money_sum, rounded, whole
from auditlake.functions.ranking import global_rank
from auditlake.params import Params

WORKLIST_COLUMNS = (
    "provider_id", "provider_name", "specialty", "risk_score", "confidence", "estimated_exposure",
    "expected_recovery", "rules_score", "peer_score", "ml_score", "ml_is_anomaly", "codemix_score",
    "codemix_flag", "kl_divergence", "cosine_distance", "temporal_score", "temporal_flag",
    "feedback_score", "feedback_label", "top_reason",
)


def _points(name: Column, table: dict[str, float], other: float) -> Column:
    picked = F.lit(other)
    for key, value in table.items():
        picked = F.when(name == key, F.lit(value)).otherwise(picked)
    return picked


def rules_component(flags: DataFrame, params: Params) -> DataFrame:
    """Capped points, exposure and reasons from rule flags; reasons are at most one per rule."""
    points = _points(F.col("rule"), params.rule_points, params.rule_points_other)
    return flags.groupBy("provider_id").agg(
        at_most(F.sum(points), params.rules_cap).alias("rules_score"),
        money_sum("estimated_exposure").alias("rules_exposure"),
        F.concat_ws("; ", F.array_sort(F.collect_set("rule"))).alias("rules_reasons"),
    )


def peer_component(flags: DataFrame, params: Params) -> DataFrame:
    """Capped points per breached metric.

    ``peer_exposure`` counts a provider's billings once per breached metric, as the published score
    does; ``peer_exposure_max`` counts them once.
    """
    points = at_most((F.abs(F.col("z_score")) - 3.5) * 2.0 + 5.0, 10.0)
    return flags.groupBy("provider_id").agg(
        at_most(F.sum(rounded(points, 6)), params.peer_cap).alias("peer_score"),
        money_sum("estimated_exposure").alias("peer_exposure"),
        F.max("estimated_exposure").alias("peer_exposure_max"),
        F.concat_ws("; ", F.array_sort(F.collect_set("metric"))).alias("peer_reasons"),
    )


def ml_component(scores: DataFrame, params: Params) -> DataFrame:
    return scores.select(
        "provider_id", "ml_score", "ml_is_anomaly",
        rounded(F.col("ml_score") / 100.0 * params.ml_cap, 2).alias("ml_points"),
    )


def codemix_component(scores: DataFrame, params: Params) -> DataFrame:
    return scores.select(
        "provider_id", "kl_divergence", "cosine_distance",
        rounded(at_most("kl_divergence", 1.0) * params.codemix_cap, 2).alias("codemix_score"),
        F.col("drift_flag").cast("int").alias("codemix_flag"),
    )


def temporal_component(scores: DataFrame, params: Params) -> DataFrame:
    base = rounded(at_most("cusum_score", 6.0) / 6.0 * params.temporal_cap, 2)
    points = at_most(base + F.col("spike_flag").cast("double"), params.temporal_cap)
    return scores.select(
        "provider_id", rounded(points, 2).alias("temporal_score"),
        F.col("temporal_flag").cast("int").alias("temporal_flag"),
    )


def _zero(spark, names: str) -> DataFrame:
    return spark.createDataFrame([], names)


def confidence_tier() -> Column:
    """HIGH on any rule; MEDIUM on two statistical signals or one plus the ensemble; else LOW."""
    signals = (F.col("peer_score") > 0).cast("int") + F.col("codemix_flag") + F.col("temporal_flag")
    medium = (signals >= 2) | ((signals == 1) & (F.col("ml_is_anomaly") == 1))
    return F.when(F.col("rules_score") > 0, "HIGH").when(medium, "MEDIUM").otherwise("LOW")


def with_tier_and_recovery(scored: DataFrame, params: Params) -> DataFrame:
    """Confidence and the exposure weighted by how likely a case of that tier is to recover."""
    rate = _points(F.col("confidence"), params.likelihood, params.likelihood["LOW"])
    return scored.withColumn("confidence", confidence_tier()).withColumn(
        "expected_recovery", rounded(F.col("estimated_exposure") * rate, 2)
    )


def top_reason() -> Column:
    """The layers that fired, joined by bars."""
    def given(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) != ""

    text = F.concat_ws(
        " | ",
        F.when(given("rules_reasons"), F.concat(F.lit("Rule: "), "rules_reasons")),
        F.when(given("peer_reasons"), F.concat(F.lit("Peer z>3: "), "peer_reasons")),
        F.when(F.col("ml_is_anomaly") == 1, F.concat(F.lit("ML anomaly score "), whole("ml_score"), F.lit("/100"))),
        F.when(F.col("codemix_flag") == 1, F.concat(F.lit("Code-mix drift KL="), fixed("kl_divergence", 3))),
        F.when(F.col("temporal_flag") == 1, F.lit("Temporal change-point")),
        F.when(F.col("feedback_label") == 1, F.lit("Feedback model confirmed")),
    )
    return F.when(text == "", "no flags").otherwise(text)


def provider_spine(days: DataFrame, people: DataFrame) -> DataFrame:
    """Every provider with its total billings."""
    billed = days.groupBy("provider_id").agg(
        (F.coalesce(F.sum("billed_cents"), F.lit(0)) / 100.0).alias("total_billed"),
    )
    return people.drop("clinic_id").join(billed, "provider_id")


def risk_scores(
    spine: DataFrame,
    flags: DataFrame,
    peers: DataFrame,
    params: Params,
    ml: DataFrame | None = None,
    codemix: DataFrame | None = None,
    temporal: DataFrame | None = None,
    feedback: DataFrame | None = None,
) -> DataFrame:
    """Scores of all providers; a layer that was not run adds nothing.

    All inputs are keyed by provider, so the joins share one partitioning on it.
    """
    spark = spine.sparkSession
    id_type = dict(spine.dtypes)["provider_id"]
    parts = [rules_component(flags, params), peer_component(peers, params)]
    parts.append(
        ml_component(ml, params) if ml is not None
        else _zero(spark, f"provider_id {id_type}, ml_score double, ml_is_anomaly int, ml_points double")
    )
    parts.append(
        codemix_component(codemix, params) if codemix is not None
        else _zero(spark, f"provider_id {id_type}, kl_divergence double, cosine_distance double, "
                          "codemix_score double, codemix_flag int")
    )
    parts.append(
        temporal_component(temporal, params) if temporal is not None
        else _zero(spark, f"provider_id {id_type}, temporal_score double, temporal_flag int")
    )
    parts.append(
        feedback.select("provider_id", "feedback_score", "feedback_label") if feedback is not None
        else _zero(spark, f"provider_id {id_type}, feedback_score double, feedback_label int")
    )
    fused = spine
    for part in parts:
        fused = fused.join(part, "provider_id", "left")
    fused = fused.fillna(0, subset=[
        "rules_score", "peer_score", "ml_points", "ml_score", "ml_is_anomaly", "codemix_score", "codemix_flag",
        "kl_divergence", "cosine_distance", "temporal_score", "temporal_flag", "feedback_score", "feedback_label",
    ])
    total = (
        F.col("rules_score") + F.col("peer_score") + F.col("ml_points") + F.col("codemix_score")
        + F.col("temporal_score") + F.col("feedback_score")
    )
    exposure = F.coalesce(
        "rules_exposure", "peer_exposure", rounded(F.col("total_billed") * params.fallback_exposure_share, 6), F.lit(0.0)
    )
    scored = fused.withColumns({
        "risk_score": rounded(at_most(rounded(total, 6), 100.0), 1),
        "estimated_exposure": exposure,
        "top_reason": top_reason(),
    })
    return with_tier_and_recovery(scored, params)


def rank_weight() -> Column:
    """Risk weighted by the logarithm of the expected recovery in thousands."""
    return F.col("risk_score") * F.log1p(F.col("expected_recovery") / 1000.0)


def worklist(scores: DataFrame, params: Params) -> DataFrame:
    """Providers at or above the threshold, strongest first."""
    listed = scores.where(F.col("risk_score") >= params.worklist_from)
    return listed.orderBy(rank_weight().desc(), "provider_id").select(*WORKLIST_COLUMNS)


def ranked_worklist(scores: DataFrame, params: Params) -> DataFrame:
    """The worklist with its ``rank``; pass materialized scores."""
    listed = scores.where(F.col("risk_score") >= params.worklist_from).withColumn(
        "rank_weight", rounded(rank_weight(), 6)
    )
    return global_rank(listed, "rank_weight", "provider_id").select("rank", *WORKLIST_COLUMNS)


def filter_worklist(
    scores: DataFrame, specialty: str | None = None, confidence: str | None = None, min_score: float = 0.0
) -> DataFrame:
    kept = scores.where(F.col("risk_score") >= min_score)
    if specialty is not None:
        kept = kept.where(F.col("specialty") == specialty)
    if confidence is not None:
        kept = kept.where(F.col("confidence") == confidence)
    return kept


def provider_slice(table: DataFrame, provider_id: object) -> DataFrame:
    """All rows of one provider; the filter reaches the scan."""
    return table.where(F.col("provider_id") == F.lit(provider_id))


def flag_events(listed: DataFrame, model_version: str | None = None) -> DataFrame:
    """One ``flag_generated`` audit event per listed provider, with the signals shown."""
    signals = F.array_compact(F.array(
        F.when(F.col("rules_score") > 0, F.coalesce(F.regexp_extract("top_reason", r"Rule: ([^|]*?)(?: \||$)", 1), F.lit("rules"))),
        F.when(F.col("peer_score") > 0, F.lit("peer_stats")),
        F.when(F.col("ml_is_anomaly") == 1, F.concat(F.lit("ml_ensemble:"), whole("ml_score"))),
        F.when(F.col("codemix_flag") == 1, F.lit("codemix_drift")),
        F.when(F.col("temporal_flag") == 1, F.lit("temporal_change_point")),
    ))
    return listed.select(
        F.lit("flag_generated").alias("event_type"),
        F.lit("system").alias("user"),
        "provider_id",
        F.lit(model_version).cast("string").alias("model_version"),
        F.to_json(signals).alias("signals_shown"),
        F.lit(None).cast("string").alias("action_taken"),
        F.col("top_reason").alias("reasoning"),
    )
