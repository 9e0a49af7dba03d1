"""Laplace display noise for explanation values. Demonstration-grade: no budget is tracked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.hashing import uniform
from auditlake.functions.numbers import col, rounded
from auditlake.functions.quantiles import global_quantiles
from auditlake.params import Params


def sensitivity(values: DataFrame, column: str, params: Params) -> DataFrame:
    """One row: the 95th percentile of absolute values, floored; 1.0 if there are no values."""
    usable = values.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))).select(
        F.abs(column).alias("size")
    )
    found = global_quantiles(usable, "size", {"p95": 0.95}).select("p95").scalar()
    one = values.sparkSession.range(1)
    return one.select(
        F.when(found.isNull(), F.lit(1.0)).otherwise(F.greatest(found, F.lit(params.min_sensitivity))).alias("sensitivity")
    )


def laplace(u: Column, scale: Column) -> Column:
    """Inverse Laplace distribution function at ``u`` in (0, 1)."""
    centred = u - 0.5
    return -scale * F.signum(centred) * F.log(1.0 - 2.0 * F.abs(centred))


def with_noise(
    values: DataFrame, column: str, keys: list[str], params: Params, scale_from: Column | None = None
) -> DataFrame:
    """Adds ``noisy`` and the stamps ``epsilon`` and ``sensitivity`` to long-form values.

    The draw depends on ``keys`` and the seed only, so a re-run shows the same numbers.  Pass a
    materialized frame, or a fixed sensitivity in ``scale_from``.
    """
    level = scale_from if scale_from is not None else sensitivity(values, column, params).scalar()
    u = uniform(*[F.col(k) for k in keys], F.lit(params.seed))
    return (
        values.withColumn("sensitivity", level)
        .withColumn("epsilon", F.lit(params.epsilon))
        .withColumn("noisy", col(column) + laplace(u, F.col("sensitivity") / F.col("epsilon")))
        .withColumn("sensitivity", rounded("sensitivity", 6))
    )
