"""Content hashes of rows and tables, and reproducible uniform draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: a digest of the table's rows that does not depend on their order.

    Row hashes are combined by xor and by sum, so repeated rows do not cancel out.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    summed = F.sum(row.cast("decimal(20,0)"))
    parts = df.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.coalesce(summed, F.lit(0)).alias("s")
    )
    return parts.select(
        F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", "x", "s")]), 256).alias("fingerprint")
    )


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) drawn from the text of ``parts``: same input, same draw, anywhere."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
