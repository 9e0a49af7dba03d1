"""Versioned feedback models: tables of their terms and an append-only table of versions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.hashing import table_fingerprint
from auditlake.operators import feedback
from auditlake.params import Params

VERSION_COLUMNS = (
    "version_no bigint, version_id string, utc_timestamp timestamp, model_type string, "
    "training_data_hash string, n_total_labels bigint, n_confirmed bigint, n_cleared bigint, "
    "hyperparameters string, method string, val_size bigint, detection_rate double, false_pos_rate double"
)


def list_versions(spark: SparkSession, base: str) -> DataFrame:
    """All registered versions; empty with the declared schema before the first one."""
    try:
        return spark.read.schema(VERSION_COLUMNS).parquet(f"{base}/versions")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], VERSION_COLUMNS)


def current_version(spark: SparkSession, base: str) -> DataFrame:
    """The newest version, as zero or one row."""
    newest = F.max_by(F.struct("*"), "version_no").alias("v")
    return list_versions(spark, base).agg(newest).where(F.col("v").isNotNull()).select("v.*")


def register(
    model: feedback.FeedbackModel, training: DataFrame, params: Params, base: str, kind: str = "boosted"
) -> str:
    """Save the model under the next version and append its row; returns the version id."""
    spark = training.sparkSession
    number = (list_versions(spark, base).agg(F.max("version_no")).first()[0] or 0) + 1
    version = f"v{number:03d}"
    model.table(spark).write.parquet(f"{base}/models/{version}")
    hyper = json.dumps({
        "boosted": {"trees": params.feedback_trees, "max_depth": params.feedback_depth, "learning_rate": params.feedback_rate},
        "logistic": {"max_iter": params.feedback_steps, "ridge": params.feedback_ridge},
    }[kind])
    counts = training.agg(
        F.count(F.lit(1)).alias("n_total_labels"),
        F.count_if(F.col("label") == 1).alias("n_confirmed"),
        F.count_if(F.col("label") == 0).alias("n_cleared"),
    )
    fingerprint = table_fingerprint(training.select("provider_id", "label", *feedback.FEATURES))
    row = (
        feedback.holdout_metrics(training, params, kind)
        .withColumn("one", F.lit(1))
        .join(counts.withColumn("one", F.lit(1)), "one")
        .join(fingerprint.withColumn("one", F.lit(1)), "one")
        .select(
            F.lit(number).cast("bigint").alias("version_no"), F.lit(version).alias("version_id"),
            F.current_timestamp().alias("utc_timestamp"), F.lit(kind).alias("model_type"),
            F.col("fingerprint").alias("training_data_hash"), "n_total_labels", "n_confirmed", "n_cleared",
            F.lit(hyper).alias("hyperparameters"), "method", "val_size", "detection_rate", "false_pos_rate",
        )
    )
    row.write.mode("append").parquet(f"{base}/versions")
    return version


def load_version(spark: SparkSession, base: str, version: str) -> feedback.FeedbackModel:
    """The model of a version, ready to score."""
    return feedback.FeedbackModel.read(spark.read.schema(feedback.MODEL_TABLE).parquet(f"{base}/models/{version}"))
