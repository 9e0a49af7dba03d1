"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: claims of one bucket: what a task sorts and groups without spilling
BUCKET_ROWS = 250_000
#: Spark's own limit
_MAX_BUCKETS = 100_000


def build_session(master: str | None = None, app: str = "auditlake", **conf: str) -> SparkSession:
    """A session with the settings every operator relies on; the cluster's own values win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # call-site capture costs several round trips to the JVM per column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    return tempfile.mkdtemp(prefix="auditlake-")


def concurrently(spark: SparkSession, *steps: Callable[[], object]) -> list:
    """Run independent steps at once, so the jobs of one fill the gaps of the others."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    with ThreadPoolExecutor(max_workers=len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
        return [step.result() for step in running]


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder.

    Used where a claims-sized aggregate is read by several later steps: without it each reader
    would scan the claims again, and an executor lost late would repeat the whole lineage.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    For tables of the size of the claims: unlike a checkpoint, later readers fetch only the columns they use.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession, rows: int) -> int:
    """Buckets for a table of ``rows`` rows: they grow in number, not in size."""
    return min(_MAX_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS)))


def stored_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like :func:`stored`, as a table in ``buckets`` buckets by ``key``: groupings and joins by it need no shuffle.

    One task reads all rows of a key, so no key may hold a large share of them.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}")
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table, format="parquet")
    return spark.table(table)
