"""Recoverable amounts under the 24-month window inside the five-year look-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.numbers import money_sum, rounded
from auditlake.operators import evidence as ev
from auditlake.params import Params

# ---- fixed values: concern taxonomy and pathway wording ----
NOT_RENDERED = "Billing for services which were apparently not rendered"
MORE_COMPLEX = "Billing for a more complex service than appears to have been performed"
MULTI_CODE = "Billing multiple codes for a service described by one fee code"
TAXONOMY = (
    # scheme, concern, legal circumstances, evidence basis, needs a medical consultant
    (ev.IMPOSSIBLE_DAY, NOT_RENDERED, ["a", "d"], "documentary", False),
    (ev.DUPLICATES, NOT_RENDERED, ["a"], "documentary", False),
    (ev.VOLUME, NOT_RENDERED, ["a", "d"], "clinical", True),
    (ev.UPCODING, MORE_COMPLEX, ["d", "e"], "clinical", True),
    (ev.THERAPY_TIME, MORE_COMPLEX, ["d"], "clinical", True),
    (ev.ESCALATION, MORE_COMPLEX, ["d"], "clinical", True),
    (ev.UNBUNDLING, MULTI_CODE, ["b", "d"], "documentary", False),
    (ev.MODIFIER, MULTI_CODE, ["b", "d"], "clinical", True),
    (ev.UNITS, MORE_COMPLEX, ["a", "d"], "clinical", True),
    (ev.SELF_REFERRAL, MORE_COMPLEX, ["e", "f"], "clinical", True),
    (ev.WEEKEND, NOT_RENDERED, ["a", "c"], "documentary", False),
)
DEFAULT_CONCERN = ("Potential Billing Concern", ["b"], "clinical", True)
PATHWAYS = {
    # (documentary evidence, high value): next step, potential outcome
    (True, True): (
        "Full Audit Review — issue Request for Records and Information letter",
        "Likely negotiated settlement or HSARB referral (documentary concern, material amount)",
    ),
    (True, False): (
        "Full Audit Review — request records for the flagged dates",
        "Billing education and/or negotiated settlement",
    ),
    (False, True): (
        "Full Audit Review — request records; engage medical consultant on necessity",
        "Billing education; settlement if records do not support claims",
    ),
    (False, False): (
        "Initial Action — billing education letter, then monitor future claims",
        "Education and close (no determination at this stage)",
    ),
}
# ---- end of fixed values ----


def classify(found: DataFrame) -> DataFrame:
    """Findings with concern, legal circumstances, evidence basis and consultation need."""
    schema = (
        "scheme string, concern string, circumstances array<string>, evidence_basis string, "
        "needs_medical_consult boolean"
    )
    taxonomy = found.sparkSession.createDataFrame([tuple(t) for t in TAXONOMY], schema)
    concern, circumstances, basis, consult = DEFAULT_CONCERN
    return found.join(F.broadcast(taxonomy), "scheme", "left").withColumns({
        "concern": F.coalesce("concern", F.lit(concern)),
        "circumstances": F.coalesce("circumstances", F.array(*[F.lit(c) for c in circumstances])),
        "evidence_basis": F.coalesce("evidence_basis", F.lit(basis)),
        "needs_medical_consult": F.coalesce("needs_medical_consult", F.lit(consult)),
    })


def provider_exposure(found: DataFrame) -> DataFrame:
    """Exposure, concerns and legal basis per provider (lists hold one entry per scheme)."""
    return classify(found).groupBy("provider_id").agg(
        F.min("specialty").alias("specialty"),
        money_sum("estimated_extra_revenue").alias("exposure"),
        F.count(F.lit(1)).alias("n_concerns"),
        F.concat_ws("; ", F.array_sort(F.collect_list("scheme"))).alias("concerns"),
        F.concat_ws("; ", F.array_sort(F.array_distinct(F.flatten(F.collect_list("circumstances"))))).alias(
            "hia_circumstances"
        ),
        F.bool_or("needs_medical_consult").alias("needs_medical_consult"),
        F.bool_or(F.col("evidence_basis") == "documentary").alias("has_documentary"),
    )


def inflation_ratios(exposure: DataFrame, days: DataFrame) -> DataFrame:
    billed = days.groupBy("provider_id").agg(
        (F.coalesce(F.sum("billed_cents"), F.lit(0)) / 100.0).alias("total_billed")
    )
    ratio = F.when(
        F.col("total_billed") > 0, F.least(F.lit(1.0), F.try_divide("exposure", "total_billed"))
    ).otherwise(0.0)
    joined = exposure.join(billed, "provider_id", "left").fillna(0.0, subset=["total_billed"])
    return joined.withColumn("inflation_ratio", ratio)


def request_date(days: DataFrame, given: str | None = None) -> Column:
    """The review-request date: given, or the day after the last claim."""
    if given:
        return F.to_date(F.lit(given))
    return F.date_add(days.agg(F.max("service_date").alias("d")).scalar(), 1)


def best_windows(ratios: DataFrame, days: DataFrame, params: Params, requested: Column) -> DataFrame:
    """Best contiguous window of suspect dollars for every provider at once.

    The months of one provider form the window partition (at most the look-back's length).  Empty
    months need no rows: a range frame over the month number skips them, and only the first month
    at which a full window exists is added, because a best window ends there or at an active month.
    """
    span = params.recovery_months
    eligible = days.where(
        (F.col("service_date") >= F.add_months(requested, -12 * params.lookback_years))
        & (F.col("service_date") <= requested)
    )
    month = (F.year("service_date") * 12 + F.month("service_date")).alias("m")
    monthly = (
        eligible.groupBy("provider_id", month)
        .agg((F.coalesce(F.sum("billed_cents"), F.lit(0)) / 100.0).alias("billed"))
        .join(ratios.select("provider_id", "inflation_ratio"), "provider_id")
        .withColumn("suspect", F.col("billed") * F.col("inflation_ratio"))
    )
    by_provider = Window.partitionBy("provider_id")
    spread = monthly.withColumns({
        "first_m": F.min("m").over(by_provider), "last_m": F.max("m").over(by_provider),
    })
    is_first = (F.col("m") == F.col("first_m")) & (F.col("last_m") >= F.col("first_m") + (span - 1))
    points = spread.select(
        "*",
        F.explode(
            F.when(is_first, F.array(F.lit(0), F.lit(span - 1))).otherwise(F.array(F.lit(0)))
        ).alias("shift"),
    ).select(
        "provider_id", "first_m", "last_m", (F.col("m") + F.col("shift")).alias("m"),
        F.when(F.col("shift") == 0, F.col("suspect")).otherwise(0.0).alias("suspect"),
    )
    trailing = by_provider.orderBy("m").rangeBetween(-(span - 1), 0)
    rolled = points.withColumn("windowed", F.sum("suspect").over(trailing))
    full = F.when(F.col("m") >= F.col("first_m") + (span - 1), F.struct("windowed", (-F.col("m")).alias("neg_m")))
    per = rolled.groupBy("provider_id").agg(
        F.min("first_m").alias("first_m"), F.max("last_m").alias("last_m"),
        F.sum("suspect").alias("total"), F.max(full).alias("best"),
    )
    n_months = F.col("last_m") - F.col("first_m") + 1
    short = n_months <= span
    end = F.when(short, F.col("last_m")).otherwise(-F.col("best.neg_m"))
    start = F.when(short, F.col("first_m")).otherwise(end - (span - 1))
    amount = F.when(short, F.col("total")).otherwise(F.col("best.windowed"))

    def first_day(number: Column) -> Column:
        return F.make_date(F.floor((number - 1) / 12).cast("int"), F.pmod(number - 1, F.lit(12)).cast("int") + 1, F.lit(1))

    return per.select(
        "provider_id",
        rounded(amount, 2).alias("recoverable"),
        first_day(start).alias("window_start"),
        first_day(end).alias("window_end"),
        F.least(n_months, F.lit(span)).cast("int").alias("months_in_window"),
        rounded(F.greatest(F.lit(0.0), F.col("total") - amount), 2).alias("outside_window"),
    )


def statutory_recovery(
    found: DataFrame, days: DataFrame, params: Params, requested: Column
) -> DataFrame:
    """One row per provider with a finding: ratio, window, recoverable and barred amounts."""
    ratios = inflation_ratios(provider_exposure(found), days)
    windows = best_windows(ratios, days, params, requested)
    return ratios.join(windows, "provider_id", "left").fillna(
        0, subset=["recoverable", "outside_window", "months_in_window"]
    )


def with_pathway(recovery: DataFrame, params: Params) -> DataFrame:
    """Recommended next step from evidence kind and amount."""
    high = F.col("recoverable") >= params.high_value

    def pick(part: int) -> Column:
        return (
            F.when(F.col("has_documentary") & high, PATHWAYS[True, True][part])
            .when(F.col("has_documentary"), PATHWAYS[True, False][part])
            .when(high, PATHWAYS[False, True][part])
            .otherwise(PATHWAYS[False, False][part])
        )

    return recovery.withColumn("recommended_next_step", pick(0)).withColumn("potential_outcome", pick(1))


def provenance(meta: DataFrame, validated: bool) -> DataFrame:
    """One row: how far the figures may be relied on, and the fee schedule behind them."""
    real = F.coalesce(F.col("authoritative"), F.lit(False))
    dated = F.when(
        F.coalesce(F.col("effective_date"), F.lit("")) != "", F.concat(F.lit(" effective "), F.col("effective_date"))
    ).otherwise("")
    label = F.when(
        real, F.concat(F.coalesce("source", F.lit("Schedule of Benefits")), F.lit(" v"), F.coalesce("version", F.lit("?")), dated)
    ).otherwise(
        F.concat(F.coalesce("source", F.lit("demo")), F.lit(" ("), F.coalesce("version", F.lit("demo")), F.lit(") — NOT authoritative"))
    )
    defensible = real & F.lit(validated)
    return meta.select(
        F.when(defensible, "DEFENSIBLE").otherwise("INDICATIVE").alias("figure_status"),
        label.alias("fee_schedule"),
        real.alias("fee_schedule_authoritative"),
        defensible.alias("recovery_defensible"),
    )


def recovery_summary(recovery: DataFrame, stamp: DataFrame, params: Params) -> DataFrame:
    """The recovery table with its provenance stamped on every row."""
    marks = {
        name: stamp.select(name).scalar()
        for name in ("figure_status", "fee_schedule", "fee_schedule_authoritative", "recovery_defensible")
    }
    return with_pathway(recovery, params).select(
        "provider_id", "specialty", "n_concerns", "concerns",
        rounded("exposure", 2).alias("estimated_exposure"),
        F.col("recoverable").alias("statutory_recoverable"),
        F.col("window_start").alias("recovery_window_start"),
        F.col("window_end").alias("recovery_window_end"),
        F.col("outside_window").alias("barred_by_statute"),
        "hia_circumstances", "needs_medical_consult", "recommended_next_step", "potential_outcome",
        *[value.alias(name) for name, value in marks.items()],
    )


def portfolio(summary: DataFrame) -> DataFrame:
    """Totals over all cases."""
    return summary.agg(
        F.count(F.lit(1)).alias("n_providers"),
        money_sum("estimated_exposure").alias("exposure"),
        money_sum("statutory_recoverable").alias("recoverable"),
        money_sum("barred_by_statute").alias("barred"),
    )


def top_cases(summary: DataFrame, n: int) -> DataFrame:
    return summary.orderBy(F.col("statutory_recoverable").desc(), F.col("provider_id")).limit(n)
