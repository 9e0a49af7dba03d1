"""Result sinks. Parquet is the table format; CSV, JSON and text are exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.ranking import global_rank


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Overwrite a result table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_missing(df: DataFrame, path: str, key: str) -> None:
    """Append only rows whose key is not in the table yet."""
    spark = df.sparkSession
    try:
        known = spark.read.parquet(path).select(key)
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        append_table(df, path)
        return
    append_table(df.join(known, key, "left_anti"), path)


def export_csv(df: DataFrame, path: str, order_by: str | None = None) -> None:
    """CSV export with a header; ordered by range partitions, so it is written in parallel."""
    (df.orderBy(order_by) if order_by else df).write.mode("overwrite").option("header", True).csv(path)


#: The column that each result is ordered by when it is written, largest first, then by provider id.
ORDERS = {
    "findings": "estimated_extra_revenue", "drift": "kl_divergence", "temporal": "cusum_score",
    "recovery": "statutory_recoverable", "worklist": "risk_score",
}


def write_ordered(df: DataFrame, result: str, path: str, ties: tuple[str, ...] = ()) -> None:
    """Overwrite a table whose files, read by name, hold the rows in the order of ``ORDERS``; ``place`` counts them from 1.

    Rows are dealt to files by ranges of all order columns, so many equal values do not end in one file.
    """
    ranked = global_rank(df, ORDERS[result], "provider_id", *ties, name="place")
    ranked.repartitionByRange("place").sortWithinPartitions("place").write.mode("overwrite").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)


def export_text(lines: DataFrame, path: str) -> None:
    """Report lines ordered by ``line_no``."""
    ordered = lines.repartitionByRange("line_no").sortWithinPartitions("line_no")
    ordered.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def save_claims_layout(claims: DataFrame, path: str) -> None:
    """Claims partitioned by service month and sorted by provider inside each file.

    Month partitions serve the five-year look-back; the sort gives tight per-file provider ranges,
    so a one-provider slice skips almost all files.
    """
    month = F.date_format("service_date", "yyyy-MM")
    (
        claims.withColumn("service_month_key", month)
        .repartitionByRange("service_month_key", "provider_id", "claim_id")
        .sortWithinPartitions("service_month_key", "provider_id")
        .write.mode("overwrite")
        .partitionBy("service_month_key")
        .parquet(path)
    )
