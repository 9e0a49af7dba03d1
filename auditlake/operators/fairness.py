"""Do some provider groups get flagged more than the rest?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numbers import rounded
from auditlake.operators.peers import with_practice_setting
from auditlake.params import Params


def roster(days: DataFrame, people: DataFrame, params: Params) -> DataFrame:
    """One row per provider with the three group attributes."""
    per = days.groupBy("provider_id").agg(
        F.sum("n_claims").alias("n_claims"), F.count("service_date").alias("billed_days")
    )
    named = people.select("provider_id", "specialty", "clinic_id").join(per, "provider_id")
    return with_practice_setting(named, params).drop("cohort_key")


# ---- fixed values: complementary error function, rational approximation 7.1.26 of Abramowitz and Stegun (1964) ----
_ERFC_P = 0.3275911
_ERFC_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# ---- end of fixed values ----


def chi2_p_value(statistic: Column | str) -> Column:
    """Upper tail of the chi-square distribution with one degree of freedom, with an error of at most 1.5e-7."""
    half = (F.col(statistic) if isinstance(statistic, str) else statistic) / 2.0
    t = F.lit(1.0) / (F.lit(1.0) + F.sqrt(half) * _ERFC_P)
    terms = F.lit(0.0)
    for a in reversed(_ERFC_A):
        terms = (terms + a) * t
    return terms * F.exp(-half)


def chi2_yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Continuity-corrected statistic of the table [[a, b], [c, d]]; 0 if a margin is empty."""
    n = a + b + c + d
    shifted = F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2.0)
    margins = (a + b).cast("double") * (c + d) * (a + c) * (b + d)
    return F.when(margins == 0, F.lit(0.0)).otherwise(F.try_divide(n * shifted * shifted, margins))


def group_stats(people: DataFrame, scores: DataFrame, labels: DataFrame, params: Params) -> DataFrame:
    """Flag rate, mean risk, confirmed share and chi-square of every large enough group.

    The three dimensions are counted in one pass over the roster.
    """
    listed = scores.select("provider_id", "risk_score", F.lit(1).alias("flagged"))
    bad = labels.where(F.col("label") == 1).select("provider_id").distinct().withColumn("bad", F.lit(1))
    joined = people.join(listed, "provider_id", "left").join(bad, "provider_id", "left").fillna(
        0, subset=["risk_score", "flagged", "bad"]
    )
    dimensions = ("specialty", "clinic_id", "practice_setting")
    cells = F.explode(F.array(
        F.struct(F.lit("(all)").alias("dimension"), F.lit("(all)").alias("group")),
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("group")) for d in dimensions],
    ))
    counted = joined.withColumn("g", cells).groupBy("g.dimension", "g.group").agg(
        F.count(F.lit(1)).alias("n_providers"),
        F.sum("flagged").alias("n_flagged"),
        F.sum(F.rint(F.col("risk_score") * 10.0).cast("long")).alias("risk_tenths"),
        F.sum(F.col("flagged") * F.col("bad")).alias("n_confirmed_bad"),
    )
    everyone = joined.agg(F.count(F.lit(1)).alias("n"), F.sum("flagged").alias("f"))
    n_all, f_all = everyone.select("n").scalar(), everyone.select("f").scalar()
    sized = counted.where((F.col("dimension") != "(all)") & (F.col("n_providers") >= params.min_group)).withColumns(
        {"n_all": n_all, "f_all": f_all}
    )
    a, b = F.col("n_flagged"), F.col("n_providers") - F.col("n_flagged")
    c = F.col("f_all") - a
    d = F.col("n_all") - F.col("n_providers") - c
    rate = F.col("n_flagged") / F.col("n_providers")
    return sized.withColumn("chi2", chi2_yates(a, b, c, d)).select(
        "dimension", "group", "n_providers", "n_flagged",
        rounded(rate, 4).alias("flag_rate"),
        rounded(F.col("risk_tenths") / 10.0 / F.col("n_providers"), 2).alias("mean_risk_score"),
        "n_confirmed_bad",
        rounded(F.try_divide("n_confirmed_bad", "n_flagged"), 4).alias("precision_proxy"),
        rounded("chi2", 6).alias("chi2"),
        ((F.col("chi2") > params.alert_chi2) & (rate > F.col("f_all") / F.col("n_all"))).alias("alert"),
    )


def fairness_summary(people: DataFrame, scores: DataFrame, labels: DataFrame, params: Params) -> DataFrame:
    """Group statistics with p-values."""
    return group_stats(people, scores, labels, params).withColumn(
        "chi2_p_value", rounded(chi2_p_value("chi2"), 4)
    )
