"""Exact quantiles per group by radix selection, on one path at every size.

A value's bits, put in the order of the numbers, are read in three digits of 22, 21 and 21 bits.  Per round the rows that
share the digits found so far are counted by their next digit, which is combined in the tasks first; the digit that holds the
wanted rank joins the ones before.  After the last digit the value is known.  A round holds at most ``2 ** 22`` counts of a group
whatever its rows, so one group may hold any share of them, and the plan needs no look at the data beforehand.

All functions read their input more than once: pass materialized frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOW_BITS = 21


def _ranks(prob: Column, size: Column, zeros: Column) -> list[Column]:
    position = prob * (size - F.lit(1)).cast("double")
    low = F.floor(position)
    return [
        (low + 1 - zeros).alias("_low_rank"),
        (F.ceil(position) + 1 - zeros).alias("_high_rank"),
        (position - low).alias("_fraction"),
    ]


def _walk(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From (keys, _p, _value, _count, ranks) to the interpolated quantile per (keys, _p)."""
    by_group = Window.partitionBy(*keys, "_p")
    upto = by_group.orderBy(F.col("_value").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    reached = F.sum("_count").over(upto)

    def pick(rank: str) -> Column:
        found = F.min(F.when(F.col("_reached") >= F.col(rank), F.col("_value")))
        return F.when(F.max(rank) <= 0, F.lit(0.0)).otherwise(found)

    picked = (
        cells.withColumn("_reached", reached)
        .groupBy(*keys, "_p")
        .agg(
            pick("_low_rank").alias("_low"),
            pick("_high_rank").alias("_high"),
            F.max("_fraction").alias("_fraction"),
            F.max("_size").alias("_size"),
        )
    )
    value = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_fraction")
    checked = F.when(
        F.col("_low").isNull() | F.col("_high").isNull(),
        F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"),
    ).otherwise(value)
    return picked.withColumn("_q", checked)


def _wide(long: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    picks = [F.max(F.when(F.col("_p") == F.lit(p), F.col("_q"))).alias(name) for name, p in probs.items()]
    return long.groupBy(*keys).agg(*picks, F.max("_size").alias("group_size"))


def _probabilities(probs: dict[str, float]) -> Column:
    return F.explode(F.array(*[F.lit(float(p)) for p in sorted(set(probs.values()))]))


def _digits(value: Column) -> list[Column]:
    """Three whole numbers that compare as ``value`` does, the first one first."""
    # the sum turns -0.0 into 0.0
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    ordered = F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)
    mask = F.lit((1 << _LOW_BITS) - 1)
    return [
        F.shiftright(ordered, 2 * _LOW_BITS).alias("_d1"), F.shiftright(ordered, _LOW_BITS).bitwiseAND(mask).alias("_d2"),
        ordered.bitwiseAND(mask).alias("_d3"),
    ]


def _next_digit(counts: DataFrame, targets: DataFrame, known: Sequence[str], digit: str) -> DataFrame:
    """``targets`` with the digit that holds their rank ``_rank``, which then counts from that digit's first row."""
    upto = Window.partitionBy(*known).orderBy(digit).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_upto", F.sum("_n").over(upto))
    found = targets.join(counts, list(known))
    found = found.where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
    return found.withColumn("_rank", F.col("_rank") - F.col("_upto") + F.col("_n")).drop("_upto", "_n")


def _selected(base: DataFrame, keys: Sequence[str], ranks: DataFrame) -> DataFrame:
    """``(keys, _rank, _found)``: the value of each wanted rank (from 1), for ``base (keys, _value)``."""
    numbers = ranks.select(*keys, F.col("_rank").alias("_wanted"), "_rank").distinct()
    rows = base.select(*keys, "_value", *_digits(F.col("_value")))
    targets, known = numbers, list(keys)
    for digit in ("_d1", "_d2", "_d3"):
        # only rows that share the digits of a target are counted
        here = rows if digit == "_d1" else rows.join(targets.select(*known).distinct(), known)
        last = [F.min("_value").alias("_found")] if digit == "_d3" else []
        counts = here.groupBy(*known, digit).agg(F.count(F.lit(1)).alias("_n"), *last)
        targets = _next_digit(counts, targets, known, digit)
        known = [*known, digit]
    return targets.select(*keys, F.col("_wanted").alias("_rank"), "_found")


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], size: str | None = None
) -> DataFrame:
    """Exact, linearly interpolated quantiles: one row per group, one column per name in ``probs``.

    ``size`` names a column with the full group size where zero values are not stored as rows (all
    stored values must then be positive).
    """
    kept = [*keys, F.col(value).cast("double").alias("_value")]
    base = df.where(F.col(value).isNotNull()).select(*kept, *([F.col(size).alias("_full")] if size else []))
    sizes = base.groupBy(*keys).agg(
        F.count("_value").alias("_stored"), (F.max("_full") if size else F.count("_value")).alias("_size")
    )
    targets = sizes.withColumn("_p", _probabilities(probs)).select(
        "*", *_ranks(F.col("_p"), F.col("_size"), F.col("_size") - F.col("_stored"))
    ).drop("_stored")
    both = targets.withColumn("_rank", F.explode(F.array("_low_rank", "_high_rank")))
    found = _selected(base, keys, both.where(F.col("_rank") > 0))
    ends = both.join(found, [*keys, "_rank"], "left").groupBy(*keys, "_p")

    def pick(rank: str) -> Column:
        # a rank among the unstored zeros
        return F.max(F.when(F.col(rank) <= 0, F.lit(0.0)).when(F.col("_rank") == F.col(rank), F.col("_found")))

    ends = ends.agg(
        pick("_low_rank").alias("_low"), pick("_high_rank").alias("_high"), F.max("_fraction").alias("_fraction"),
        F.max("_size").alias("_size"),
    )
    return _wide(ends.withColumn("_q", F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_fraction")), keys, probs)


def robust_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, MAD (median distance from it), mean, sample deviation and size of every group."""
    base = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value"))
    medians = group_quantiles(base, keys, "_value", {"median": 0.5})
    gaps = base.join(medians, list(keys)).select(*keys, F.abs(F.col("_value") - F.col("median")).alias("_gap"))
    mads = group_quantiles(gaps, keys, "_gap", {"mad": 0.5}).drop("group_size")
    moments = base.groupBy(*keys).agg(F.avg("_value").alias("mean"), F.stddev_samp("_value").alias("deviation"))
    return medians.join(mads, list(keys)).join(moments, list(keys))


def counted_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, count: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles of values given with their counts, for values from a small domain."""
    cells = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.sum(count).alias("_count"))
    )
    sizes = cells.groupBy(*keys).agg(F.sum("_count").alias("_size"))
    targets = sizes.withColumn("_p", _probabilities(probs)).select(
        "*", *_ranks(F.col("_p"), F.col("_size"), F.lit(0))
    )
    return _wide(_walk(cells.join(targets, list(keys)), keys), keys, probs)


def global_quantiles(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of a whole column: one row, none if there are no values."""
    whole = df.select(F.lit(1).alias("_all"), value)
    return group_quantiles(whole, ["_all"], value, probs).drop("_all")
