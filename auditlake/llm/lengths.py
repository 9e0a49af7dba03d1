"""Exact length histogram of a corpus: suffix sums answer totals, quantiles and truncated totals for every context limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Lengths in one window; the windows over blocks then see one row per block.
BLOCK = 256


def histogram(lengths: DataFrame) -> DataFrame:
    """``(n_tokens, docs)`` from ``lengths (n_tokens)``; null lengths count as 0."""
    return lengths.groupBy(F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length that occurs, what a context limit of that length means.

    ``docs_at_least`` and ``tokens_at_least``: documents of that length or more and their tokens; ``truncated_tokens``: tokens
    left if every document is cut to the limit; ``share_at_most``: documents up to that length, as a share (quantiles
    are read off it); ``total_docs``, ``total_tokens``. Between two lengths that occur, ``truncated_tokens`` is a straight line, so the table
    answers every limit. No documents: no rows.
    """
    at = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    later = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = at.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        F.col("block").alias("b"), *[F.coalesce(F.sum(x).over(later), F.lit(0)).alias(f"later_{x}") for x in "dt"],
        F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"),
    )
    inside = W.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, 0)
    sums = at.join(blocks, F.col("block") == F.col("b")).select(
        "n_tokens", "docs", (F.sum("docs").over(inside) + F.col("later_d")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("later_t")).alias("tokens_at_least"), "total_docs", "total_tokens",
    )
    truncated = F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    at_most = (F.col("total_docs") - F.col("docs_at_least") + F.col("docs")) / F.col("total_docs")
    return sums.withColumn("truncated_tokens", truncated).withColumn("share_at_most", at_most)


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``(context_limit, docs_cut, truncated_tokens)`` for any limits, from :func:`suffix_sums`; longer than all documents: nothing is cut."""
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    longer = F.col("n_tokens") > F.col("context_limit")
    met = asked.join(sums, longer, "left").groupBy("context_limit").agg(
        F.min_by(F.struct("docs_at_least", "tokens_at_least"), "n_tokens").alias("x")
    )
    total = sums.agg(F.max("total_tokens").alias("total"))
    cut = F.coalesce(F.col("x.docs_at_least"), F.lit(0))
    return met.join(total, F.lit(True)).select(
        "context_limit", cut.alias("docs_cut"),
        (F.coalesce("total", F.lit(0)) - F.coalesce(F.col("x.tokens_at_least"), F.lit(0)) + cut * F.col("context_limit")).alias("truncated_tokens"),
    )
