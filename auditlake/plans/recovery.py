"""Claims to recoverable amounts per provider."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.numbers import dollars, whole
from auditlake.operators import evidence, quality, rollups, statutory
from auditlake.params import Params
from auditlake.session import materialize


@dataclass(frozen=True)
class RecoveryRun:
    findings: DataFrame
    summary: DataFrame


def run(
    claims: DataFrame, params: Params, meta: DataFrame, requested: str | None = None, validated: bool = False
) -> RecoveryRun:
    """Mine all schemes, then turn them into recoverable amounts with their provenance."""
    valid = quality.validate_claims(claims)
    days = materialize(rollups.provider_day(valid))
    codes = materialize(rollups.provider_code(valid))
    people = materialize(rollups.provider_dim(valid))
    found = materialize(evidence.findings(evidence.Inputs(valid, days, codes, people), params))
    recovery = statutory.statutory_recovery(found, days, params, statutory.request_date(days, requested))
    summary = statutory.recovery_summary(recovery, statutory.provenance(meta, validated), params)
    return RecoveryRun(found, materialize(summary))


def casebook_lines(result: RecoveryRun, top: int = 25) -> DataFrame:
    """The casebook as (line_no, line) rows, ready for a text sink."""
    listed = statutory.top_cases(result.summary, top)
    line = F.concat(
        F.lit("| "), F.col("provider_id").cast("string"), F.lit(" | "), F.col("specialty"), F.lit(" | "),
        dollars("statutory_recoverable", 0), F.lit(" | "), dollars("estimated_exposure", 0), F.lit(" | "),
        whole("n_concerns"), F.lit(" | "), F.col("recommended_next_step"), F.lit(" |"),
    )
    # ranks only the requested top rows
    place = F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy(F.col("statutory_recoverable").desc(), F.col("provider_id"))
    )
    totals = statutory.portfolio(result.summary).select(
        F.lit(0).alias("line_no"),
        F.concat(
            F.lit("Providers with a concern: "), whole("n_providers"), F.lit("; exposure "), dollars("exposure", 0),
            F.lit("; recoverable "), dollars("recoverable", 0), F.lit("; barred "), dollars("barred", 0),
        ).alias("line"),
    )
    return totals.unionByName(listed.select(place.alias("line_no"), line.alias("line")))
