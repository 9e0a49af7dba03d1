"""Global row ranks without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.session import materialize

def ranged(df: DataFrame, *order: Column, bins: int | None = None) -> DataFrame:
    """``df`` with ``_bin``, which ascends with ``order``: bins of about equal size, as many as shuffle partitions.

    Rows are dealt by ranges of all columns of ``order``, so rows that are equal in the first are split by the next ones.  The result is
    stored, so a retried task cannot deal rows anew.
    """
    count = bins or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(count, *order).withColumn("_bin", F.spark_partition_id()))


def global_rank(df: DataFrame, score: str, *ties: str, name: str = "rank") -> DataFrame:
    """1-based rank by ``score`` descending, nulls last, then ``ties`` ascending.

    A row's rank is the number of rows in the bins before its own plus its place there.
    """
    order = (F.col(score).desc_nulls_last(), *[F.col(t).asc() for t in ties])
    binned = ranged(df, *order)
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # one row per bin
    offsets = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_bin", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    place = F.row_number().over(Window.partitionBy("_bin").orderBy(*order))
    ranked = binned.withColumn("_place", place).join(F.broadcast(offsets), "_bin")
    return ranked.withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_bin", "_place", "_before")
