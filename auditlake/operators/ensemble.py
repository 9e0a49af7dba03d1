"""Three-detector anomaly ensemble: normalised scores, majority vote, funnel mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numbers import rounded
from auditlake.functions.quantiles import global_quantiles
from auditlake.operators import features as feats
from auditlake.operators import isolation_forest, lof, ocsvm
from auditlake.params import Params
from auditlake.session import concurrently, materialize

SCORE_COLUMNS = (
    "ml_score", "ml_is_anomaly", "vote_count", "if_score", "if_flag", "lof_score", "lof_flag",
    "ocsvm_score", "ocsvm_flag",
)


def normalised(df: DataFrame, raw: str) -> Column:
    """Raw scores, where lower means stranger, turned into 0..100 with 100 the strangest."""
    inverted = -F.col(raw)
    ends = df.agg(F.min(inverted).alias("lo"), F.max(inverted).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    return (inverted - lo) / (hi - lo + 1e-9) * 100.0


def consensus(
    raw: DataFrame, contamination: float, params: Params
) -> DataFrame:
    """From if_raw, lof_raw and ocsvm_raw (lower is stranger) to weighted score and vote.

    The forest and the factor flag the lowest ``contamination`` share, the SVM its negative side.
    ``raw`` is read several times: pass a materialized frame.
    """
    def cut(name: str) -> Column:
        return global_quantiles(raw, name, {"q": contamination}).select("q").scalar()

    flags = {
        "if_flag": F.col("if_raw") < cut("if_raw"),
        "lof_flag": F.col("lof_raw") < cut("lof_raw"),
        "ocsvm_flag": F.col("ocsvm_raw") < 0,
    }
    parts = {f"{d}_part": normalised(raw, f"{d}_raw") for d in ("if", "lof", "ocsvm")}
    voted = raw.withColumns({k: v.cast("int") for k, v in flags.items()}).withColumns(parts)
    votes = F.col("if_flag") + F.col("lof_flag") + F.col("ocsvm_flag")
    total = (
        params.weight_forest * F.col("if_part")
        + params.weight_lof * F.col("lof_part")
        + params.weight_svm * F.col("ocsvm_part")
    )
    return voted.select(
        "provider_id",
        rounded(total, 2).alias("ml_score"),
        (votes >= params.votes_needed).cast("int").alias("ml_is_anomaly"),
        votes.alias("vote_count"),
        *[
            c
            for d in ("if", "lof", "ocsvm")
            for c in (rounded(f"{d}_part", 2).alias(f"{d}_score"), F.col(f"{d}_flag"))
        ],
    )


def fit_ensemble(matrix: DataFrame, params: Params, contamination: float) -> DataFrame:
    """Scores of all three detectors for every row of a materialized feature matrix."""
    names = feats.feature_names(params)
    share = min(max(contamination, 0.01), 0.49)
    n_rows = matrix.count()
    if n_rows == 0:
        return matrix.sparkSession.createDataFrame(
            [], "provider_id " + dict(matrix.dtypes)["provider_id"] + ", " + ", ".join(
                f"{c} {'double' if c.endswith('score') else 'int'}" for c in SCORE_COLUMNS
            )
        )
    vectors = materialize(feats.scaled_vectors(matrix, names))

    def forest_part() -> DataFrame:
        trees = isolation_forest.fit_forest(vectors, n_rows, params)
        return isolation_forest.forest_scores(vectors, trees, n_rows, params)

    def svm_part() -> DataFrame:
        weights = ocsvm.fit_svm(vectors, n_rows, len(names), share, params)
        return ocsvm.svm_scores(vectors, weights, len(names), share, params)

    forest, factors, margins = concurrently(
        matrix.sparkSession,
        forest_part,
        lambda: lof.local_outlier_factor(vectors, n_rows, params.lof_neighbours, params.seed),
        svm_part,
    )
    raw = materialize(
        forest.withColumnRenamed("score_samples", "if_raw")
        .join(factors.select("provider_id", (-F.col("lof")).alias("lof_raw")), "provider_id", "left")
        .join(margins.withColumnRenamed("decision", "ocsvm_raw"), "provider_id")
        .fillna(-1.0, subset=["lof_raw"])
    )
    return consensus(raw, share, params)


def funnel_candidates(rule_points: DataFrame, peer_points: DataFrame, params: Params) -> DataFrame:
    """Providers whose capped rule and peer points reach the funnel threshold."""
    both = rule_points.select("provider_id", "rules_score").join(
        peer_points.select("provider_id", "peer_score"), "provider_id", "full_outer"
    ).fillna(0.0)
    return both.where(F.col("rules_score") + F.col("peer_score") >= params.funnel_points).select("provider_id")


def anomaly_scores(
    claims: DataFrame,
    days: DataFrame,
    codes: DataFrame,
    people: DataFrame,
    params: Params,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """Ensemble scores with provider attributes; in funnel mode all other providers score zero."""
    params = feats.with_specialties(people, params)
    matrix = materialize(feats.feature_matrix(claims, days, codes, people, params, candidates))
    everyone = people.drop("clinic_id")
    share = params.contamination
    if candidates is not None:
        share = candidates.select("provider_id").distinct().count() / max(everyone.count(), 1)
    scores = fit_ensemble(matrix, params, share)
    named = everyone.join(scores, "provider_id", "inner" if candidates is None else "left")
    return named.fillna(0, subset=list(SCORE_COLUMNS)).select(
        "provider_id", "provider_name", "specialty", *SCORE_COLUMNS
    )
