"""Plain-language explanations for all providers at once, and the summary of the top ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.numbers import dollars, fixed, money_sum, whole

# ---- fixed values: display names of features ----
FEATURE_LABELS = {
    "claims_per_day": "unusually high daily claim volume",
    "avg_billed": "above-peer average billed amount",
    "avg_minutes": "above-peer average service duration",
    "top_tier_share": "over-use of top-tier billing codes",
    "services_per_patient": "excessive services per patient",
    "billed_cv": "high billing variability",
    "dup_rate": "elevated duplicate claim rate",
    "max_daily_minutes": "extreme single-day minutes billed",
    "code_entropy": "unusual code diversity",
    "total_claims": "high total claim count",
    "total_billed": "high total amount billed",
}
# ---- end of fixed values ----


def feature_label(name: Column) -> Column:
    label = (
        F.when(F.startswith(name, F.lit("pct_")), F.concat(F.lit("large share of code "), F.substring(name, 5, 1000)))
        .when(name == "spec_other", F.lit("specialty outside the model's list"))
        .when(F.startswith(name, F.lit("spec_")), F.concat(F.lit("membership of specialty "), F.substring(name, 6, 1000)))
        .otherwise(F.replace(name, F.lit("_"), F.lit(" ")))
    )
    for key, text in FEATURE_LABELS.items():
        label = F.when(name == key, text).otherwise(label)
    return label


def rule_sections(flags: DataFrame) -> DataFrame:
    """(provider_id, place, section) with one sentence per rule that fired."""
    per = flags.groupBy("provider_id", "rule").agg(
        F.count(F.lit(1)).alias("n"),
        money_sum("estimated_exposure").alias("exposure"),
        F.max_by("evidence", F.struct("estimated_exposure", "evidence")).alias("worst"),
    )
    amount = dollars("exposure")
    text = (
        F.when(F.col("rule") == "impossible_day", F.concat(
            F.lit("Impossible billing volume on "), whole("n"), F.lit(" day(s). Largest: "), F.col("worst"),
            F.lit(". Billed on those days: "), amount, F.lit(".")))
        .when(F.col("rule") == "duplicate_billing", F.concat(
            F.lit("Duplicate billing: "), F.col("worst"), F.lit(". Estimated excess: "), amount, F.lit(".")))
        .otherwise(F.concat(
            F.lit("Unbundling: "), F.col("worst"), F.lit(". Estimated overcharge: "), amount, F.lit(".")))
    )
    place = F.when(F.col("rule") == "impossible_day", 1).when(F.col("rule") == "duplicate_billing", 2).otherwise(3)
    return per.select("provider_id", place.alias("place"), text.alias("section"))


def top_peer_flags(flags: DataFrame, n: int = 3) -> DataFrame:
    """The n largest deviations of each provider (a provider has at most five)."""
    order = Window.partitionBy("provider_id").orderBy(F.abs("z_score").desc(), "metric")
    return flags.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def peer_sections(flags: DataFrame) -> DataFrame:
    side = F.when(F.col("z_score") > 0, "above").otherwise("below")
    sentence = F.concat(
        F.replace("metric", F.lit("_"), F.lit(" ")), F.lit(" "), fixed("provider_value", 2), F.lit(" is "),
        fixed(F.abs("z_score"), 1), F.lit(" deviations "), side, F.lit(" the peer median "), fixed("peer_median", 2),
    )
    listed = F.sort_array(F.collect_list(F.struct("place", sentence.alias("s"))))
    return top_peer_flags(flags).groupBy("provider_id").agg(
        F.concat(F.lit("Peer outliers: "), F.array_join(F.transform(listed, lambda e: e["s"]), "; "), F.lit(".")).alias("section")
    ).select("provider_id", F.lit(4).alias("place"), "section")


def ml_sections(ml: DataFrame, attributions: DataFrame | None = None) -> DataFrame:
    flagged = ml.where(F.col("ml_is_anomaly") == 1)
    if attributions is None:
        why = F.lit("The combination of billing features is unusual.")
    else:
        flagged = flagged.join(attributions.select("provider_id", "explanation"), "provider_id", "left")
        why = F.coalesce("explanation", F.lit(""))
    text = F.concat_ws(" ", F.concat(F.lit("Anomaly ensemble score "), whole("ml_score"), F.lit("/100.")), why)
    return flagged.select("provider_id", F.lit(5).alias("place"), text.alias("section"))


def explanations(
    top: DataFrame, flags: DataFrame, peers: DataFrame, ml: DataFrame | None = None,
    attributions: DataFrame | None = None,
) -> DataFrame:
    """Summary text per listed provider; sections of other providers never leave their partition."""
    sections = rule_sections(flags).unionByName(peer_sections(peers))
    if ml is not None:
        sections = sections.unionByName(ml_sections(ml, attributions))
    ordered = F.sort_array(F.collect_list(F.struct("place", "section")))
    per = (
        sections.join(top.select("provider_id"), "provider_id", "left_semi")
        .groupBy("provider_id")
        .agg(F.array_join(F.transform(ordered, lambda e: F.concat(F.lit("  - "), e["section"])), "\n").alias("body"))
    )
    head = F.concat(
        F.lit("AUDIT SUMMARY: "), F.col("provider_name"), F.lit(" ("), F.col("provider_id").cast("string"), F.lit("), "),
        F.col("specialty"), F.lit(", risk "), whole("risk_score"), F.lit("/100"),
    )
    body = F.coalesce("body", F.lit("  - No single flag; listed by the combined score."))
    note = F.lit("For human review only; nothing here triggers an automatic action.")
    return top.join(per, "provider_id", "left").select(
        "provider_id", "provider_name", "specialty", "risk_score", "estimated_exposure",
        F.concat_ws("\n", head, F.lit("FINDINGS:"), body, note).alias("explanation"),
    )
