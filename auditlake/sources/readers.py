"""Typed scans of claims and of the small reference tables."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.sources import schemas


@dataclass(frozen=True)
class Dataset:
    """Where the tables of one named data set live."""

    base: str
    name: str = ""

    def path(self, table: str) -> str:
        suffix = f"_{self.name}" if self.name else ""
        stem, dot, ext = table.rpartition(".")
        return f"{self.base.rstrip('/')}/{stem}{suffix}.{ext}" if dot else f"{self.base.rstrip('/')}/{table}{suffix}"


def read_claims_csv(spark: SparkSession, path: str, corrupt: str | None = None) -> DataFrame:
    """Claims as text columns; ``operators.quality.validate_claims`` types them.

    Columns go by the name in each file's own header, so files may list them in any order. ``corrupt`` names a column
    that keeps lines with too few or too many fields as they were read.
    """
    declared = [f.strip() for f in schemas.RAW_CLAIMS.split(",")]
    known = {f.split(" ")[0]: f for f in declared}
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"), "value",
    )
    headers = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "place").alias("header"))
    parts = []
    # one row per distinct header; the files that share it are read together
    for header, files in headers.groupBy("header").agg(F.sort_array(F.collect_list("file"))).orderBy("header").collect():
        names = [name.strip().strip('"') for name in header.split(",")]
        schema = ", ".join(known.get(name, f"`{name}` string") for name in names) + (f", `{corrupt}` string" if corrupt else "")
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
        if corrupt:
            reader = reader.option("columnNameOfCorruptRecord", corrupt).option("enforceSchema", True)
        parts.append(reader.schema(schema).csv([unquote(file) for file in files]))
    if not parts:
        return with_optional_columns(spark.createDataFrame([], schemas.RAW_CLAIMS + (f", `{corrupt}` string" if corrupt else "")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return with_optional_columns(out)


def read_claims_parquet(spark: SparkSession, path: str) -> DataFrame:
    return with_optional_columns(spark.read.parquet(path))


def with_optional_columns(claims: DataFrame) -> DataFrame:
    """Add ``modifier`` and ``units`` where a narrow claims set lacks them; clean the modifier."""
    if "modifier" not in claims.columns:
        claims = claims.withColumn("modifier", F.lit(""))
    if "units" not in claims.columns:
        claims = claims.withColumn("units", F.lit(1))
    clean = F.regexp_replace(F.coalesce(F.col("modifier").cast("string"), F.lit("")), r"\.0$", "")
    return claims.withColumn("modifier", F.when(clean == "nan", "").otherwise(clean))


def read_fee_schedule(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).schema(schemas.FEE_SCHEDULE).csv(path)
    return raw.fillna({"tier": 0, "minutes": 0}).dropDuplicates(["fee_code"])


def read_fee_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schemas.FEE_META).json(path)


def price_of(claims: DataFrame, schedule: DataFrame) -> DataFrame:
    """Attach the scheduled price; a code that is not in the schedule gets null."""
    prices = schedule.select("fee_code", F.col("amount").alias("scheduled_amount"))
    return claims.join(prices, "fee_code", "left")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schemas.GROUND_TRUTH).json(path)


def truth_labels(truth: DataFrame) -> DataFrame:
    """(provider_id, label): 1 for planted actors, 0 for clean traps."""
    bad = truth.select(F.explode("all_bad_actors").alias("provider_id"), F.lit(1).alias("label"))
    clean = truth.select(F.explode(F.map_keys("clean_providers")).alias("provider_id"), F.lit(0).alias("label"))
    return bad.unionByName(clean)


def truth_schemes(truth: DataFrame) -> DataFrame:
    """(provider_id, scheme) for every planted scheme list."""
    listed = truth.select(F.explode("schemes").alias("scheme", "ids"))
    return listed.select(F.explode("ids").alias("provider_id"), "scheme")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table that was not produced yet: no rows, but its schema."""
    return spark.createDataFrame([], schema)
