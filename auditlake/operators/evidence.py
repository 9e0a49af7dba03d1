"""Revenue-inflation schemes: eleven detectors with one output schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.numbers import (
    at_least, cents, dollars, fixed, grouped, money_sum, percent, rounded, whole,
)
from auditlake.functions.quantiles import counted_quantiles, group_quantiles
from auditlake.operators import rollups
from auditlake.operators.rules import unbundled_events
from auditlake.params import Params
from auditlake.session import materialize

COLUMNS = ("provider_id", "specialty", "scheme", "evidence", "estimated_extra_revenue", "support_claims")

# ---- fixed values: scheme names (they key the concern taxonomy) ----
UPCODING = "Upcoding (E/M complexity inflation)"
THERAPY_TIME = "Psychotherapy time inflation"
UNBUNDLING = "Unbundling component codes"
DUPLICATES = "Duplicate claim resubmission"
IMPOSSIBLE_DAY = "Impossible day (>24h billed)"
VOLUME = "Phantom / excessive claim volume"
SELF_REFERRAL = "Self-referral out-of-specialty imaging"
MODIFIER = "Modifier-25 separate-E/M abuse"
UNITS = "Unit / dosage inflation"
ESCALATION = "Escalating upcoding over time"
WEEKEND = "Weekend / closed-office billing"
# ---- end of fixed values ----


@dataclass(frozen=True)
class Inputs:
    """Claims, the daily and the code rollup and the provider attributes.

    Detectors read claims only for what the rollups lack.
    """

    claims: DataFrame
    days: DataFrame
    codes: DataFrame
    people: DataFrame

    def named(self, per_provider: DataFrame) -> DataFrame:
        """Add the specialty to a provider-grain frame."""
        return per_provider.join(self.people.select("provider_id", "specialty"), "provider_id")


def _finding(df: DataFrame, scheme: str, evidence: Column, extra: Column, support: Column) -> DataFrame:
    return df.select(
        "provider_id", "specialty", F.lit(scheme).alias("scheme"), evidence.alias("evidence"),
        rounded(F.greatest(extra, F.lit(0.0)), 2).alias("estimated_extra_revenue"),
        support.cast("long").alias("support_claims"),
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _with_specialty_medians(inputs: Inputs, per: DataFrame, **medians: str) -> DataFrame:
    """Add the median over the providers of a specialty for each named column."""
    per = materialize(inputs.named(per))
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(v).cast("double").alias("x")) for n, v in medians.items()]))
    found = group_quantiles(per.select("specialty", cells.alias("c")).select("specialty", "c.*"), ["specialty", "name"], "x", {"m": 0.5})
    picks = [F.max(F.when(F.col("name") == n, F.col("m"))).alias(n) for n in medians]
    return per.join(found.groupBy("specialty").agg(*picks), "specialty", "left")


def upcoding(inputs: Inputs, params: Params) -> DataFrame:
    visits = inputs.codes.where(F.col("fee_code").isin(*params.office_codes))
    per = visits.groupBy("provider_id").agg(
        F.sum("n").alias("n"),
        F.try_divide(F.sum(cents("billed")), F.sum("n_amounts") * 100.0).alias("price"),
        _share(F.col("fee_code").isin(*params.office_top_codes)).alias("share"),
    )
    per = _with_specialty_medians(inputs, per, base_share="share", base_price="price")
    hits = per.where(
        (F.col("n") >= params.min_visits)
        & (F.col("share") >= at_least(F.col("base_share") + params.upcode_delta, params.upcode_share))
    )
    extra = F.col("n") * F.greatest(F.lit(0.0), F.col("price") - F.col("base_price"))
    text = _text(
        "Top-tier E/M codes on ", percent("share"), " of ", whole("n"), " office visits vs ",
        F.col("specialty"), " cohort median ", percent("base_share"), "; avg E/M $", whole("price"),
        " vs cohort $", whole("base_price"),
    )
    return _finding(hits, UPCODING, text, extra, F.col("n"))


def therapy_time(inputs: Inputs, params: Params) -> DataFrame:
    sessions = inputs.codes.where(F.col("fee_code").isin(*params.therapy_codes))
    per = sessions.groupBy("provider_id").agg(
        F.sum("n").alias("n"),
        _share(F.col("fee_code") == params.therapy_long_code).alias("share"),
    )
    per = _with_specialty_medians(inputs, per, base_share="share")
    hits = per.where(
        (F.col("n") >= params.min_visits)
        & (F.col("share") >= at_least(F.col("base_share") + params.therapy_delta, params.therapy_share))
    )
    extra = F.col("n") * F.col("share") * F.lit(params.therapy_price_gap)
    text = _text(
        "Billed 60-min psychotherapy (", params.therapy_long_code, ") on ", percent("share"), " of ",
        whole("n"), " sessions vs cohort median ", percent("base_share"),
    )
    return _finding(hits, THERAPY_TIME, text, extra, F.col("n"))


def unbundling(inputs: Inputs, params: Params) -> DataFrame:
    found = []
    for rule in params.bundle_rules:
        per = unbundled_events(inputs.claims, rule, params.bundle_keys).groupBy("provider_id").agg(
            F.count(F.lit(1)).alias("n"), money_sum("component_total").alias("total")
        )
        text = _text(
            whole("n"), " patient-dates billed ", "+".join(sorted(rule.components)),
            " separately instead of bundle ", f"{rule.bundle_code} ({rule.bundle_desc})",
        )
        extra = F.col("total") - F.col("n") * F.lit(rule.bundle_amt)
        found.append(_finding(inputs.named(per), UNBUNDLING, text, extra, F.col("n")))
    return reduce(DataFrame.unionByName, found)


def duplicates(inputs: Inputs, params: Params) -> DataFrame:
    events = rollups.duplicate_events(inputs.claims, params.evidence_duplicate_keys)
    per = inputs.named(
        events.withColumn("extra", (F.col("n") - 1) * F.col("unit_billed"))
        .groupBy("provider_id")
        .agg(F.count(F.lit(1)).alias("events"), money_sum("extra").alias("extra"))
        .where(F.col("events") >= params.min_duplicate_events)
    )
    text = _text(
        whole("events"),
        " claim(s) resubmitted with identical patient, code, date and units (paid more than once)",
    )
    return _finding(per, DUPLICATES, text, F.col("extra"), F.col("events"))


def worst_days(days: DataFrame, params: Params) -> DataFrame:
    """Days over the ceiling per provider, with the longest one (earliest date on a tie)."""
    worst = F.max_by(
        F.struct("service_date", "minutes", "n_claims"),
        F.struct(F.col("minutes"), -F.unix_date("service_date")),
    )
    return days.where(F.col("minutes") > params.max_day_minutes).groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("n_days"),
        (F.coalesce(F.sum("billed_cents"), F.lit(0)) / 100.0).alias("billed"),
        worst.alias("worst"),
    )


def impossible_day(inputs: Inputs, params: Params) -> DataFrame:
    per = inputs.named(worst_days(inputs.days, params))
    text = _text(
        whole("n_days"), f" day(s) over {params.max_day_minutes:.0f} service-minutes; worst: ",
        grouped("worst.minutes"), " min across ", whole("worst.n_claims"), " claims on ",
        F.col("worst.service_date").cast("string"),
    )
    return _finding(per, IMPOSSIBLE_DAY, text, F.col("billed"), F.col("n_days"))


def volume(inputs: Inputs, params: Params) -> DataFrame:
    per = inputs.days.groupBy("provider_id").agg(
        F.sum("n_rows").alias("n"),
        F.count(F.lit(1)).alias("days"),
        F.try_divide(F.sum("billed_cents"), F.sum("n_amounts") * 100.0).alias("price"),
    ).withColumn("per_day", F.col("n") / F.col("days"))
    per = _with_specialty_medians(inputs, per, base="per_day")
    hits = per.where(
        (F.col("per_day") >= F.lit(params.volume_multiple) * F.col("base"))
        & (F.col("per_day") >= params.volume_floor)
    )
    excess = (F.col("per_day") - F.col("base")) * F.col("days")
    text = _text(
        fixed("per_day", 1), " claims/active-day vs ", F.col("specialty"), " cohort median ",
        fixed("base", 1), " (~", grouped(F.floor(excess)), " excess claims)",
    )
    return _finding(hits, VOLUME, text, excess * F.col("price"), F.col("n"))


def _share(condition: Column) -> Column:
    """Share of claims of a provider's codes that satisfy ``condition``."""
    return F.sum(F.when(condition, F.col("n")).otherwise(0)) / F.sum("n")


def self_referral(inputs: Inputs, params: Params) -> DataFrame:
    images = inputs.codes.where(F.col("fee_code").isin(*params.imaging_codes)).groupBy("provider_id").agg(
        F.sum("n").alias("n"), money_sum("billed").alias("billed")
    ).where(F.col("n") >= params.min_imaging)
    per = inputs.named(images).where(F.col("specialty") != params.imaging_specialty)
    text = _text(
        "Billed ", whole("n"), " high-value MRI/CT studies (", dollars("billed", 0), ") under the ",
        F.col("specialty"), " specialty — imaging normally read by ", params.imaging_specialty,
    )
    return _finding(per, SELF_REFERRAL, text, F.col("billed"), F.col("n"))


def modifier_abuse(inputs: Inputs, params: Params) -> DataFrame:
    stacked = inputs.claims.where(
        (F.col("modifier") == params.modifier) & F.col("fee_code").isin(*params.office_codes)
    )
    per = inputs.named(
        stacked.groupBy("provider_id")
        .agg(F.count(F.lit(1)).alias("n"), money_sum("amount_billed").alias("billed"))
        .where(F.col("n") >= params.min_modifier)
    )
    text = _text(
        whole("n"), f" office visits billed with modifier {params.modifier} (separately-payable E/M) "
        "stacked onto same-day procedures (", dollars("billed", 0), ")",
    )
    return _finding(per, MODIFIER, text, F.col("billed"), F.col("n"))


def unit_inflation(inputs: Inputs, params: Params) -> DataFrame:
    """Units far above the code's median; works on (provider, code, units) counts."""
    units = F.coalesce(F.col("units").try_cast("double"), F.lit(1.0))
    cells = materialize(
        inputs.claims.where(F.col("fee_code").isin(*params.unit_codes))
        .withColumn("u", units)
        .groupBy("provider_id", "fee_code", "u")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("amount_billed").alias("n_amounts"),
            F.sum(cents("amount_billed")).alias("c"),
        )
    )
    medians = counted_quantiles(cells, ["fee_code"], "u", "n", {"median": 0.5}).drop("group_size")
    based = cells.join(medians, "fee_code").withColumn("base", at_least("median", 1.0))
    per_code = based.groupBy("provider_id", "fee_code").agg(
        F.max("base").alias("base"),
        F.sum("n").alias("n"),
        (F.sum(F.col("u") * F.col("n")) / F.sum("n")).alias("avg_units"),
        F.sum(F.greatest(F.col("u") - F.col("base"), F.lit(0.0)) * F.col("n")).alias("over"),
        F.try_divide(
            F.sum(F.col("c") / 100.0 / F.greatest(F.col("u"), F.lit(1.0))), F.sum("n_amounts")
        ).alias("unit_price"),
    ).where(
        (F.col("avg_units") >= F.lit(params.unit_multiple) * F.col("base"))
        & (F.col("n") >= params.min_unit_claims)
    )
    label = _text(F.col("fee_code"), "(avg ", fixed("avg_units", 1), "u vs ", whole("base"), ")")
    # the list is bounded by the number of unit-billable codes, a parameter
    per = per_code.groupBy("provider_id").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("over") * F.col("unit_price")).alias("extra"),
        F.concat_ws(", ", F.sort_array(F.collect_list(label))).alias("codes"),
    ).where(F.col("n") >= params.min_unit_claims)
    text = _text("Inflated units on dose-based codes: ", F.col("codes"))
    return _finding(inputs.named(per), UNITS, text, F.col("extra"), F.col("n"))


def escalation(inputs: Inputs, params: Params) -> DataFrame:
    """Top-code share of the early and the late half of the observed dates."""
    visits = inputs.claims.where(F.col("fee_code").isin(*params.office_codes))
    span = visits.agg(F.min("service_date").alias("lo"), F.max("service_date").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    late = 2 * F.date_diff(F.col("service_date"), lo) > F.date_diff(hi, lo)
    top = F.col("fee_code").isin(*params.office_top_codes)

    def avg_of(half: Column) -> Column:
        return F.try_divide(
            F.sum(F.when(half, cents("amount_billed"))), F.count(F.when(half, F.col("amount_billed"))) * 100.0
        )

    per = (
        visits.withColumn("late", late)
        .groupBy("provider_id")
        .agg(
            F.count_if(~F.col("late")).alias("n_early"),
            F.count_if("late").alias("n_late"),
            F.try_divide(F.count_if(~F.col("late") & top), F.count_if(~F.col("late"))).alias("share_early"),
            F.try_divide(F.count_if(F.col("late") & top), F.count_if("late")).alias("share_late"),
            avg_of(~F.col("late")).alias("avg_early"),
            avg_of(F.col("late")).alias("avg_late"),
        )
        .where((F.col("n_early") >= params.min_half_visits) & (F.col("n_late") >= params.min_half_visits))
        .where(
            (F.col("share_late") - F.col("share_early") >= params.escalation_rise)
            & (F.col("share_late") >= params.escalation_late)
        )
    )
    extra = F.col("n_late") * F.greatest(F.lit(0.0), F.col("avg_late") - F.col("avg_early"))
    text = _text(
        "Top-tier E/M share climbed from ", percent("share_early"), " (early) to ", percent("share_late"),
        " (late); avg visit $", whole("avg_early"), " → $", whole("avg_late"),
    )
    return _finding(inputs.named(per), ESCALATION, text, extra, F.col("n_early") + F.col("n_late"))


def weekend(inputs: Inputs, params: Params) -> DataFrame:
    """Claims on Saturdays and Sundays, from the daily rollup."""
    per = (
        inputs.days.where(F.dayofweek("service_date").isin(1, 7))
        .groupBy("provider_id")
        .agg(
            F.sum("n_rows").alias("n"),
            (F.coalesce(F.sum("billed_cents"), F.lit(0)) / 100.0).alias("billed"),
        )
        .where(F.col("n") >= params.min_weekend)
    )
    text = _text(
        whole("n"), " claims (", dollars("billed", 0), ") billed on weekends — unusual for an outpatient ",
        F.col("specialty"), " practice",
    )
    return _finding(inputs.named(per), WEEKEND, text, F.col("billed"), F.col("n"))


Detector = Callable[[Inputs, Params], DataFrame]
DETECTORS: dict[str, Detector] = {
    "upcoding": upcoding,
    "therapy_time": therapy_time,
    "unbundling": unbundling,
    "duplicates": duplicates,
    "impossible_day": impossible_day,
    "volume": volume,
    "self_referral": self_referral,
    "modifier_abuse": modifier_abuse,
    "unit_inflation": unit_inflation,
    "escalation": escalation,
    "weekend": weekend,
}


def findings(inputs: Inputs, params: Params, detectors: dict[str, Detector] | None = None) -> DataFrame:
    """Union of all detectors; pass another registry to add or remove schemes."""
    active = DETECTORS if detectors is None else detectors
    return reduce(DataFrame.unionByName, [d(inputs, params) for d in active.values()])


def provider_evidence(found: DataFrame) -> DataFrame:
    """Total extra revenue and schemes per provider, for the ranked report.

    A provider has at most one row per scheme and bundle rule, so the lists stay short.
    """
    return found.groupBy("provider_id", "specialty").agg(
        money_sum("estimated_extra_revenue").alias("total_extra"),
        F.count_distinct("scheme").alias("n_schemes"),
        F.concat_ws(", ", F.array_sort(F.collect_set("scheme"))).alias("schemes"),
    )


def scheme_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("scheme").agg(
        F.count_distinct("provider_id").alias("providers"),
        money_sum("estimated_extra_revenue").alias("total"),
    )


def top_per_scheme(found: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` largest findings of each scheme."""
    order = Window.partitionBy("scheme").orderBy(F.col("estimated_extra_revenue").desc(), F.col("provider_id"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def truth_check(found: DataFrame, planted: DataFrame) -> DataFrame:
    """Each id as hit, missed or flagged although not planted."""
    seen = found.select("provider_id").distinct().withColumn("detected", F.lit(True))
    known = planted.select("provider_id").distinct().withColumn("planted", F.lit(True))
    both = seen.join(known, "provider_id", "full_outer").fillna(False)
    status = F.when(F.col("detected") & F.col("planted"), "hit").when(F.col("planted"), "missed").otherwise("not_planted")
    return both.select("provider_id", status.alias("status"))
