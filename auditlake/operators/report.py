"""The rows behind the evidence report, section by section, and their rendering as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.numbers import money_sum
from auditlake.operators import evidence

#: section, place in it from 1, name, detail, a count and an amount (null where a row has none)
SECTIONS = ("dataset", "providers", "schemes", "examples", "truth")


def _rows(df: DataFrame, section: str, place: Column, name: Column, detail: Column, n: Column, amount: Column) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), place.cast("int").alias("place"), name.cast("string").alias("name"), detail.cast("string").alias("detail"),
        n.cast("long").alias("n"), amount.cast("double").alias("amount"),
    )


def _first(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows with their ``place``; only these are numbered."""
    return df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def report_rows(
    found: DataFrame, days: DataFrame, codes: DataFrame, people: DataFrame, planted: DataFrame | None = None, top: int = 25, examples: int = 6
) -> DataFrame:
    """``(section, place, name, detail, n, amount)`` from findings and rollups.

    ``dataset``: what was analysed; ``providers``: the ``top`` ones by estimated extra revenue; ``schemes``: all, largest first; ``examples``: the
    largest findings of each scheme; ``truth``: findings against planted actors, if given.  ``found`` and the rollups are read more than
    once: pass materialized frames.
    """
    nothing = F.lit(None)
    by_provider = evidence.provider_evidence(found)
    facts = days.agg(F.sum("n_claims").alias("claims"), F.min("service_date").alias("first"), F.max("service_date").alias("last"))
    facts = facts.withColumns({
        "providers": people.agg(F.count(F.lit(1))).scalar(), "specialties": people.agg(F.countDistinct("specialty")).scalar(),
        "codes": codes.agg(F.countDistinct("fee_code")).scalar(), "concerned": by_provider.agg(F.count(F.lit(1))).scalar(),
        "total": found.agg(money_sum("estimated_extra_revenue").alias("x")).scalar(),
    })
    named = [
        ("claims", nothing, F.col("claims"), nothing), ("providers", nothing, F.col("providers"), nothing), ("specialties", nothing, F.col("specialties"), nothing),
        ("billing codes", nothing, F.col("codes"), nothing), ("first day", F.col("first"), nothing, nothing), ("last day", F.col("last"), nothing, nothing),
        ("providers with a finding", nothing, F.col("concerned"), nothing), ("estimated extra revenue", nothing, nothing, F.col("total")),
    ]
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(name).alias("name"), d.cast("string").alias("detail"), n.cast("long").alias("n"), x.cast("double").alias("amount"))
        for i, (name, d, n, x) in enumerate(named, 1)
    ]))
    facts = facts.select(cells.alias("c")).select("c.*")
    out = _rows(facts, "dataset", F.col("place"), F.col("name"), F.col("detail"), F.col("n"), F.col("amount"))
    ranked = _first(by_provider, top, F.col("total_extra").desc(), F.col("provider_id").asc())
    out = out.union(_rows(
        ranked, "providers", F.col("place"), F.col("provider_id"), F.concat_ws(": ", "specialty", "schemes"), F.col("n_schemes"), F.col("total_extra")
    ))
    # schemes are a short fixed vocabulary
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("total").desc(), F.col("scheme").asc())
    schemes = evidence.scheme_summary(found).withColumn("place", F.row_number().over(order))
    out = out.union(_rows(schemes, "schemes", F.col("place"), F.col("scheme"), nothing, F.col("providers"), F.col("total")))
    best = evidence.top_per_scheme(found, examples)
    out = out.union(_rows(
        best, "examples", F.col("place"), F.col("provider_id"), F.concat_ws(": ", "scheme", "evidence"), F.col("support_claims"), F.col("estimated_extra_revenue")
    ))
    if planted is None:
        return out
    told = evidence.truth_check(found, planted).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    place = F.when(F.col("status") == "hit", 1).when(F.col("status") == "missed", 2).otherwise(3)
    return out.union(_rows(told, "truth", place, F.col("status"), nothing, F.col("n"), nothing))


def report_lines(rows: DataFrame) -> DataFrame:
    """``(line_no, line)`` for a text sink: a heading per section, then its rows; examples stand by scheme."""
    section = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    amount = F.when(F.col("amount").isNotNull(), F.concat(F.lit("$"), F.format_number("amount", 0)))
    text = F.concat(F.lit("- "), F.concat_ws("; ", "name", "detail", F.format_number("n", 0), amount))
    body = rows.select(section.alias("s"), F.when(F.col("section") == "examples", F.col("detail")).alias("by"), "place", "name", text.alias("line"))
    heads = rows.select("section").distinct().select(section.alias("s"), F.concat(F.lit("## "), F.initcap("section")).alias("line"))
    heads = heads.select("s", F.lit(None).cast("string").alias("by"), F.lit(0).alias("place"), F.lit("").alias("name"), "line")
    # the rows of a report are few: a fixed number but for the schemes
    order = Window.partitionBy(F.lit(1)).orderBy("s", F.col("place") > 0, F.substring_index("by", ":", 1), "place", "name")
    return body.union(heads).select(F.row_number().over(order).alias("line_no"), "line")
