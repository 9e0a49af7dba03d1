"""Claims to ranked risk worklist, as one set of frames over shared rollups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from auditlake.operators import (
    codemix, ensemble, explain, feedback, peers, quality, rollups, rules, scoring, temporal,
)
from auditlake.params import Params
from auditlake.session import concurrently, materialize


@dataclass(frozen=True)
class Shared:
    """Validated claims, the provider attributes and the two rollups most layers start from."""

    claims: DataFrame
    days: DataFrame
    codes: DataFrame
    people: DataFrame


@dataclass(frozen=True)
class RiskRun:
    shared: Shared
    flags: DataFrame
    metrics: DataFrame
    peer_flags: DataFrame
    drift: DataFrame
    temporal: DataFrame
    ml: DataFrame | None
    feedback: DataFrame | None
    scores: DataFrame


def share(claims: DataFrame, buckets: int = 0) -> Shared:
    """Validate once and keep the daily and the code rollup.

    ``buckets`` is their number if the claims are a table in buckets by provider: the daily rollup is kept likewise.
    """
    valid = quality.validate_claims(claims)
    numbers = quality.for_statistics(valid)
    rolled = concurrently(
        claims.sparkSession,
        lambda: rollups.kept_days(rollups.provider_day(numbers), buckets),
        lambda: materialize(rollups.provider_code(numbers)),
        lambda: materialize(rollups.provider_dim(valid)),
    )
    return Shared(valid, *rolled)


def scored_metrics(shared: Shared, params: Params) -> DataFrame:
    numbers = quality.for_statistics(shared.claims)
    metrics = materialize(peers.provider_metrics(numbers, shared.days, shared.codes, shared.people, params))
    return materialize(peers.cohort_z_scores(metrics, params))


def all_rule_flags(shared: Shared, params: Params) -> DataFrame:
    """Rules exclude claims without minutes, so they use their own daily rollup."""
    usable = quality.for_rules(shared.claims)
    return rules.rule_flags(usable, rollups.provider_day(usable), shared.people, params)


def run(
    claims: DataFrame,
    params: Params,
    with_ml: bool = True,
    funnel: bool = False,
    dispositions: DataFrame | None = None,
    feedback_kind: str = "boosted",
    buckets: int = 0,
) -> RiskRun:
    """All layers and the fused scores.

    ``funnel`` limits the ensemble to providers that rules and peers already put forward; ``buckets`` as in :func:`share`.
    """
    spark = claims.sparkSession
    shared = share(claims, buckets)
    flags, metrics, changes = concurrently(
        spark,
        lambda: materialize(all_rule_flags(shared, params)),
        lambda: scored_metrics(shared, params),
        lambda: materialize(temporal.temporal_scores(rollups.provider_month(shared.days), shared.people, params)),
    )
    found, drift = concurrently(
        spark,
        lambda: materialize(peers.peer_flags(metrics, params)),
        lambda: materialize(codemix.drift_scores(shared.codes, metrics, params)),
    )
    ml = None
    if with_ml:
        candidates = None
        if funnel:
            candidates = materialize(ensemble.funnel_candidates(
                scoring.rules_component(flags, params), scoring.peer_component(found, params), params
            ))
        numbers = quality.for_statistics(shared.claims)
        ml = materialize(ensemble.anomaly_scores(
            numbers, shared.days, shared.codes, shared.people, params, candidates
        ))
    learnt = None
    if dispositions is not None:
        features = materialize(feedback.provider_features(metrics, drift, ml, changes))
        training = materialize(feedback.training_set(dispositions, features))
        model = feedback.fit_feedback(training, params, feedback_kind)
        learnt = None if model is None else feedback.feedback_scores(model, features, params)
    scores = materialize(scoring.risk_scores(
        scoring.provider_spine(shared.days, shared.people), flags, found, params, ml, drift, changes, learnt
    ))
    return RiskRun(shared, flags, metrics, found, drift, changes, ml, learnt, scores)


def explained(result: RiskRun, params: Params, top: int = 20, attributions: DataFrame | None = None) -> DataFrame:
    """Summaries of the ``top`` worklist entries."""
    listed = materialize(scoring.worklist(result.scores, params).limit(top))
    return explain.explanations(listed, result.flags, result.peer_flags, result.ml, attributions)
