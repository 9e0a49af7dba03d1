"""Number expressions: exact money sums, half-even rounding, display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int) -> Column:
    """Half-even rounding of the scaled value, as array libraries round; never a negative zero."""
    scale = float(10**digits)
    return F.rint(col(c) * scale) / scale + 0.0


def cents(c: Column | str) -> Column:
    """Money as a whole number of cents (the column is declared with two decimals)."""
    return F.rint(col(c) * 100.0).cast("long")


def money_sum(c: Column | str) -> Column:
    """Order-free sum: adding whole cents gives the same result for every partitioning."""
    return F.coalesce(F.sum(cents(c)), F.lit(0)) / 100.0


def at_least(c: Column | str, floor: float) -> Column:
    return F.greatest(col(c), F.lit(floor))


def at_most(c: Column | str, ceiling: float) -> Column:
    return F.least(col(c), F.lit(ceiling))


def whole(c: Column | str) -> Column:
    return F.rint(col(c)).cast("long").cast("string")


def grouped(c: Column | str) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(F.rint(col(c)).cast("long"), 0)


def dollars(c: Column | str, digits: int = 2) -> Column:
    if digits == 0:
        return F.concat(F.lit("$"), grouped(c))
    return F.concat(F.lit("$"), F.format_number(rounded(c, digits), digits))


def percent(c: Column | str) -> Column:
    return F.concat(whole(col(c) * 100.0), F.lit("%"))


def fixed(c: Column | str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", rounded(c, digits))
