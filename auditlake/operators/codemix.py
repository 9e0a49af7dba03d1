"""Code-mix drift: how far a provider's code distribution is from its cohort's median mix.

Frequencies are kept sparse (a row only where the provider billed the code).  Codes that neither
side uses enter the smoothed divergence in closed form, so there is no provider x code grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.numbers import rounded
from auditlake.functions.quantiles import group_quantiles
from auditlake.params import Params
from auditlake.session import materialize

_META = ("provider_id", "provider_name", "specialty", "cohort_key", "practice_setting", "total_billed")


def code_frequencies(codes: DataFrame) -> DataFrame:
    """(provider_id, fee_code, freq); a provider's codes are bounded by the code list."""
    total = F.sum("n").over(Window.partitionBy("provider_id"))
    return codes.select("provider_id", "fee_code", (F.col("n") / total).alias("freq"))


def with_cohort(freq: DataFrame, metrics: DataFrame) -> DataFrame:
    """Adds each provider's cohort and the number of providers in it."""
    meta = metrics.select("provider_id", "cohort_key")
    sizes = meta.groupBy("cohort_key").agg(F.count(F.lit(1)).alias("cohort_n"))
    return freq.join(meta.join(sizes, "cohort_key"), "provider_id")


def cohort_reference(freq: DataFrame) -> DataFrame:
    """Median frequency per (cohort, code), counting the providers that never billed the code.

    Only positive medians are kept; ``freq`` must carry cohort_key and cohort_n.
    """
    medians = group_quantiles(freq, ["cohort_key", "fee_code"], "freq", {"ref": 0.5}, size="cohort_n")
    return medians.where(F.col("ref") > 0).select("cohort_key", "fee_code", "ref")


def drift_scores(codes: DataFrame, metrics: DataFrame, params: Params) -> DataFrame:
    """KL divergence and cosine distance to the cohort's median mix, per provider.

    Only sums over the codes a provider billed are joined with the reference; the codes it did not
    bill enter through sums of the cohort.  ``codes`` and ``metrics`` are read more than once: pass
    materialized frames.
    """
    eps = params.kl_epsilon
    freq = with_cohort(code_frequencies(codes), metrics)
    reference = materialize(cohort_reference(materialize(freq)))
    cohorts = reference.groupBy("cohort_key").agg(
        F.count(F.lit(1)).alias("ref_codes"),
        F.sum("ref").alias("ref_sum"),
        F.sum(F.col("ref") * F.col("ref")).alias("q_square"),
        F.sum(F.log(F.col("ref") + eps)).alias("ref_log"),
    )
    p, q = F.col("freq"), F.coalesce(F.col("ref"), F.lit(0.0))
    sums = freq.join(reference, ["cohort_key", "fee_code"], "left").groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("own_codes"),
        F.sum(p).alias("p_sum"),
        F.sum(p * p).alias("p_square"),
        F.sum(p * q).alias("dot"),
        F.sum((p + eps) * F.log(p + eps)).alias("own_entropy"),
        F.sum(p * F.log(q + eps)).alias("cross"),
    )
    n_codes = codes.select("fee_code").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = (
        metrics.select(*_META)
        .join(sums, "provider_id")
        .join(cohorts, "cohort_key", "left")
        .fillna(0.0, subset=["ref_sum", "q_square", "ref_log"])
        .fillna(0, subset=["ref_codes"])
        .withColumn("n_codes", n_codes)
        .withColumn("p_mass", F.col("p_sum") + F.col("n_codes") * eps)
        .withColumn("q_mass", F.col("ref_sum") + F.col("n_codes") * eps)
        .withColumn("absent", F.lit(eps) / F.col("p_mass"))
    )
    billed = (
        F.col("own_entropy") - F.log("p_mass") * (F.col("p_sum") + F.col("own_codes") * eps)
        - F.col("cross") + F.log("q_mass") * F.col("p_sum")
    ) / F.col("p_mass")
    unbilled = F.col("absent") * (
        (F.col("n_codes") - F.col("own_codes")) * F.log("absent") + F.col("n_codes") * F.log("q_mass")
        - F.col("ref_log") - (F.col("n_codes") - F.col("ref_codes")) * F.log(F.lit(eps))
    )
    zero = F.col("q_square") == 0
    norm = F.sqrt(F.col("p_square") * F.when(zero, F.lit(1.0)).otherwise(F.col("q_square")))
    measured = rows.withColumn("kl", billed + unbilled).withColumn(
        "cosine", F.when(zero, F.lit(1.0)).otherwise(1.0 - F.col("dot") / norm)
    )
    flagged = (F.col("kl") > params.kl_above) | (F.col("cosine") > params.cosine_above)
    return measured.select(
        "provider_id", "provider_name", "specialty", "cohort_key", "practice_setting",
        rounded("kl", 6).alias("kl_divergence"), rounded("cosine", 6).alias("cosine_distance"),
        flagged.alias("drift_flag"), zero.alias("ref_is_zero"), F.col("total_billed").alias("estimated_exposure"),
    )


def drift_flags(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("drift_flag"))
