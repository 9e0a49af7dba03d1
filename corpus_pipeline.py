"""From documents to token ids: toxic documents go, near-duplicates go, sources are mixed, texts are encoded.

Stages keep all columns of their documents, whatever their names. Nulls, empty and blank texts, very long texts, repeated rows and empty tables
have defined results: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import bpe, minhash, mixing, toxicity
from auditlake.llm.queries import codec
from auditlake.llm.stages import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    Null, empty and blank texts get the model's base rate, repeated rows the same score. Without labels of both classes
    the model is the share of toxic ones. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels)
    return docs.where(toxicity.score(model, "text") < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates (five-word shingles, 0.8).

    Null, empty and blank texts, and rows without id, are nobody's duplicates and stay; of rows that repeat an id one stays.
    """
    return minhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is a source; a text without words stays or goes by its draw. Repeated rows are documents of their own.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the ids of each text, and of the text they decode to; a null text is an empty one."""
    return bpe.digests(docs, codec(spark))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("byte_bpe", encode)]

#: Learnt weights, sampled hashes and drawn copies have no SQL form: tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each on what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
