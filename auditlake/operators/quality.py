"""Claim validation: required columns, coercion, key checks, counters, null policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_COLUMNS = ("provider_id", "fee_code", "specialty")
NUMERIC_COLUMNS = ("service_minutes", "amount_billed")
RULE_COLUMNS = (
    "claim_id", "provider_id", "provider_name", "patient_id", "fee_code", "service_date",
    "service_minutes", "amount_billed", "specialty",
)
CODEMIX_COLUMNS = ("claim_id", "provider_id", "fee_code", "amount_billed")
TEMPORAL_COLUMNS = (
    "claim_id", "provider_id", "provider_name", "specialty", "service_date", "amount_billed",
)


def require_columns(df: DataFrame, required: Sequence[str], caller: str = "") -> None:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"{'[' + caller + '] ' if caller else ''}Missing columns: {missing}")


def _number(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] == "string":
        return F.trim(F.col(name)).try_cast("double")
    return F.col(name).cast("double")


def _date(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] == "string":
        return F.trim(F.col(name)).try_cast("date")
    return F.col(name).cast("date")


def _present(df: DataFrame, name: str) -> Column:
    known = F.col(name).isNotNull()
    return known & (F.trim(name) != "") if dict(df.dtypes)[name] == "string" else known


def coerce_claims(df: DataFrame) -> DataFrame:
    """Numbers and dates typed; a value that does not parse becomes null."""
    changes = {c: _number(df, c) for c in NUMERIC_COLUMNS if c in df.columns}
    if "service_date" in df.columns:
        changes["service_date"] = _date(df, "service_date")
    return df.withColumns(changes) if changes else df


def validate_claims(df: DataFrame, required: Sequence[str] = RULE_COLUMNS, caller: str = "") -> DataFrame:
    """Typed claims without rows that lack a usable date, provider, code or specialty.

    Zero or negative minutes and negative amounts are kept; see ``quality_counts``.
    """
    require_columns(df, required, caller)
    kept = coerce_claims(df)
    if "service_date" in df.columns:
        kept = kept.where(F.col("service_date").isNotNull())
    for name in KEY_COLUMNS:
        if name in df.columns:
            kept = kept.where(_present(df, name))
    return kept


def quality_counts(df: DataFrame) -> DataFrame:
    """One row of counters over the raw claims, in one pass."""
    counters = [F.count(F.lit(1)).alias("n_rows")]
    for name in NUMERIC_COLUMNS:
        value = _number(df, name)
        counters.append(F.count_if(F.col(name).isNotNull() & value.isNull()).alias(f"non_numeric_{name}"))
    counters += [
        F.count_if(_number(df, "service_minutes") <= 0).alias("non_positive_minutes"),
        F.count_if(_number(df, "amount_billed") < 0).alias("negative_amounts"),
        F.count_if(_date(df, "service_date").isNull()).alias("bad_dates"),
    ]
    counters += [F.count_if(~_present(df, name)).alias(f"blank_{name}") for name in KEY_COLUMNS]
    return df.agg(*counters)


def for_rules(claims: DataFrame) -> DataFrame:
    """Rules drop claims without minutes: filled with zero they could hide an impossible day."""
    return claims.where(F.col("service_minutes").isNotNull())


def for_statistics(claims: DataFrame) -> DataFrame:
    """Peer and model layers count a claim without a number as zero."""
    return claims.fillna(0.0, subset=list(NUMERIC_COLUMNS))


def for_temporal(claims: DataFrame) -> DataFrame:
    return claims.fillna(0.0, subset=["amount_billed"])


def validate_risk_scores(scores: DataFrame) -> DataFrame:
    """Risk scores without gaps, inside 0..100."""
    require_columns(scores, ["risk_score"], "risk_scores")
    value = F.coalesce(F.nanvl(F.col("risk_score").try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return scores.withColumn("risk_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))


def risk_score_counts(scores: DataFrame) -> DataFrame:
    raw = F.col("risk_score")
    value = raw.try_cast("double")
    return scores.agg(
        F.count_if(value.isNull() | F.isnan(value)).alias("n_missing"),
        F.count_if(~F.isnan(value) & (value < 0)).alias("n_negative"),
        F.count_if(~F.isnan(value) & (value > 100)).alias("n_over"),
    )
