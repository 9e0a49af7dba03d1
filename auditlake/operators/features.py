"""Provider feature matrix for the anomaly ensemble, and its robust scaling."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numbers import at_least
from auditlake.functions.quantiles import group_quantiles
from auditlake.operators import rollups
from auditlake.params import Params

CORE = (
    "total_claims", "total_billed", "avg_billed", "std_billed", "avg_minutes", "unique_patients",
    "unique_codes", "max_billed", "billed_days", "claims_per_day", "services_per_patient", "billed_cv",
    "max_daily_minutes", "dup_rate", "top_tier_share", "code_entropy",
)


def pct_name(code: str) -> str:
    return f"pct_{code}"


def spec_name(specialty: str) -> str:
    return f"spec_{specialty}"


OTHER = spec_name("other")


def with_specialties(people: DataFrame, params: Params) -> Params:
    """``params`` with the specialties of the data, if it names none: the most frequent ones, in the order of their names.

    At most ``max_specialties`` rows come to the driver; providers of the others are counted by :data:`OTHER`.
    """
    if params.specialties is not None:
        return params
    most = people.where("specialty is not null").groupBy("specialty").agg(F.count(F.lit(1)).alias("n"))
    most = most.orderBy(F.col("n").desc(), "specialty").limit(params.max_specialties)
    return replace(params, specialties=tuple(sorted(r["specialty"] for r in most.collect())))


def feature_names(params: Params) -> list[str]:
    """Names of the model's columns; the specialties must be settled (:func:`with_specialties`)."""
    if params.specialties is None:
        raise ValueError("the specialties are not settled: see with_specialties")
    return [*CORE, *map(pct_name, params.fingerprint_codes), *map(spec_name, params.specialties), OTHER]


def code_fractions(codes: DataFrame, params: Params) -> DataFrame:
    """Share of each listed code and the entropy over those shares, one row per provider."""
    listed = list(params.fingerprint_codes)
    total = F.sum("n")
    shares = [
        (F.sum(F.when(F.col("fee_code") == code, F.col("n")).otherwise(0)) / total).alias(pct_name(code))
        for code in listed
    ]
    wide = codes.groupBy("provider_id").agg(*shares)
    terms = F.array(*[F.col(f"`{pct_name(code)}`") for code in listed])
    entropy = F.aggregate(
        terms, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    )
    return wide.withColumn("code_entropy", entropy)


def duplicate_group_counts(claims: DataFrame) -> DataFrame:
    """How many (patient, code, date) groups of each provider hold more than one claim."""
    groups = claims.groupBy("provider_id", "patient_id", "fee_code", "service_date").agg(
        F.count(F.lit(1)).alias("n")
    )
    return groups.where(F.col("n") > 1).groupBy("provider_id").agg(F.count(F.lit(1)).alias("dup_groups"))


def core_features(
    claims: DataFrame, days: DataFrame, codes: DataFrame, people: DataFrame, params: Params
) -> DataFrame:
    """Amount, volume and repetition features per provider."""
    top = rollups.top_code_table(claims, params.model_top_codes)
    joined = (
        people.drop("clinic_id")
        .join(rollups.provider_totals(days), "provider_id")
        .join(rollups.patients_per_provider(claims), "provider_id", "left")
        .join(rollups.codes_per_provider(codes, people, top), "provider_id", "left")
        .join(duplicate_group_counts(claims), "provider_id", "left")
        .fillna(0, subset=["unique_patients", "unique_codes", "dup_groups"])
    )
    return joined.withColumns({
        "claims_per_day": F.col("total_claims") / at_least("billed_days", 1),
        "services_per_patient": F.col("total_claims") / at_least("unique_patients", 1),
        "billed_cv": F.col("std_billed") / at_least("avg_billed", 0.01),
        "dup_rate": F.try_divide("dup_groups", "total_claims"),
    })


def feature_matrix(
    claims: DataFrame,
    days: DataFrame,
    codes: DataFrame,
    people: DataFrame,
    params: Params,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """provider_id, provider_name, specialty and every feature as a non-null double.

    ``candidates`` narrows the model to some providers by a semi join on claims and rollups.
    """
    if candidates is not None:
        ids = candidates.select("provider_id").distinct()
        claims, days, codes = (t.join(ids, "provider_id", "left_semi") for t in (claims, days, codes))
        people = people.join(ids, "provider_id", "left_semi")
    params = with_specialties(people, params)
    one_hot = {
        spec_name(s): F.when(F.col("specialty") == s, 1.0).otherwise(0.0) for s in params.specialties
    }
    one_hot[OTHER] = F.when(F.col("specialty").isin(*params.specialties), 0.0).otherwise(1.0)
    joined = core_features(claims, days, codes, people, params).join(
        code_fractions(codes, params), "provider_id", "left"
    ).withColumns(one_hot)
    features = [
        F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0)).alias(name) for name in feature_names(params)
    ]
    return joined.select("provider_id", "provider_name", "specialty", *features)


def scaling(matrix: DataFrame, names: list[str]) -> DataFrame:
    """(feature, centre, scale) by exact median and interquartile range; a zero range scales by 1."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("x")) for n in names
    ]))
    long = matrix.select(cells.alias("c")).select("c.*")
    found = group_quantiles(long, ["feature"], "x", {"q1": 0.25, "centre": 0.5, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    # spreads at the level of rounding dust count as zero
    return found.select(
        "feature", "centre", F.when(spread < 1e-14, F.lit(1.0)).otherwise(spread).alias("scale")
    )


def scaled_vectors(matrix: DataFrame, names: list[str]) -> DataFrame:
    """provider_id and ``x``: the robustly scaled features in the order of ``names``.

    The scaling table has one row per feature, so reading it on the driver is bounded by ``names``.
    """
    table = {r["feature"]: (r["centre"], r["scale"]) for r in scaling(matrix, names).collect()}
    scaled = [
        (F.col(f"`{n}`") - F.lit(table[n][0])) / F.lit(table[n][1]) if n in table else F.lit(0.0) for n in names
    ]
    return matrix.select("provider_id", F.array(*scaled).alias("x"))
