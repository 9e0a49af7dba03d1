"""A stored event log that grows by appending.

An append reads only the head of the log: per level (rows, their segments' seals, the seals' seals and so on) the last entry
with its hashes and how many lie before it in its segment.  It continues the open segment from there and seals anew only the
path from that segment up to the root, so its work depends on what is appended, not on what is stored.

Every append is a batch of its own folders; the head, a single small file, is written last and makes the batch count.
An append that was cut short leaves folders that no reader looks at and that the next try replaces.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from auditlake.operators.chain import SEGMENT, chained, segment_of
from auditlake.session import materialize

_HEAD = "level int, seq long, prev_hash string, row_hash string, before long, total long"
_SEAL = ("seq", "n_rows", "last_hash")


@dataclass(frozen=True)
class Head:
    """The last entry of a level: its hashes, the entries before it in its segment, and all entries of the level."""

    level: int
    seq: int
    prev_hash: str
    row_hash: str
    before: int
    total: int

    @property
    def segment(self) -> int:
        return self.seq // SEGMENT


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def heads(spark: SparkSession, base: str) -> tuple[int, dict[int, Head]]:
    """Number of the last batch that counts (0: none), and its head per level: a handful of rows."""
    stored = _read(spark, f"{base}/heads")
    if stored is None:
        return 0, {}
    rows = stored.where(F.col("batch") == stored.agg(F.max("batch")).scalar()).collect()
    names = [f.split()[0] for f in _HEAD.split(", ")]
    return rows[0]["batch"], {r["level"]: Head(*[r[n] for n in names]) for r in rows}


def _next_head(level: int, rows: DataFrame, seq: str, old: Head | None) -> Head | None:
    """The head after ``rows``, new entries and perhaps one that replaces the old head."""
    last = rows.agg(F.max(F.struct(seq, "segment", "prev_hash", "row_hash")).alias("x"), F.count(F.lit(1)).alias("n")).first()
    if not last["n"]:
        return old
    at = last["x"]
    there = rows.where(F.col("segment") == at["segment"])
    replaced = 0 if old is None else rows.where(F.col(seq) == old.seq).count()
    before = there.count() - 1
    total = last["n"]
    if old is not None:
        total += old.total - replaced
        if old.segment == at["segment"]:
            before += old.before + 1 - replaced
    return Head(level, at[seq], at["prev_hash"], at["row_hash"], before, total)


def append(spark: SparkSession, base: str, events: DataFrame, fields: Sequence[str], seq: str = "seq") -> int:
    """Append ``events`` and return the batch that now counts.

    Events up to the last stored ``seq`` are taken as stored already, so the same append may be tried again.  Without new
    events nothing is written.
    """
    number, known = heads(spark, base)
    old = known.get(0)
    fresh = events if old is None else events.where(F.col(seq) > old.seq)
    start = None if old is None else (old.segment, old.row_hash)
    rows = materialize(chained(fresh, fields, seq, start))
    batch = number + 1
    now = {0: _next_head(0, rows, seq, old)}
    if now[0] is None or now[0] == old:
        return number
    rows.write.mode("overwrite").parquet(f"{base}/log/batch={batch}")
    level, below, by, sealed = 0, rows, seq, None
    while True:
        # digests of the segments that got new or changed entries; the open one has entries from before
        digests = below.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.max_by("row_hash", by).alias("last_hash"))
        was, head = known.get(level), now[level]
        kept = F.lit(0)
        if was is not None:
            replaced = below.where(F.col(by) == was.seq).count()
            kept = F.when(F.col("segment") == was.segment, F.lit(was.before + 1 - replaced)).otherwise(kept)
        inputs = digests.select(F.col("segment").alias("seq"), (F.col("n") + kept).cast("long").alias("n_rows"), "last_hash")
        level += 1
        was = known.get(level)
        start = None
        if was is not None:
            # the seal of the segment that was open is made anew from the one before it
            again = head is not None and not inputs.where(F.col("seq") == was.seq).isEmpty()
            start = (was.segment, was.prev_hash if again else was.row_hash)
        seals = materialize(chained(inputs, _SEAL, "seq", start).withColumn("level", F.lit(level)))
        now[level] = _next_head(level, seals, "seq", was)
        sealed = seals if sealed is None else sealed.unionByName(seals)
        if now[level].total < 2:
            break
        below, by = seals, "seq"
    sealed.write.mode("overwrite").parquet(f"{base}/seals/batch={batch}")
    state = [(h.level, h.seq, h.prev_hash, h.row_hash, h.before, h.total) for h in now.values()]
    spark.createDataFrame(state, _HEAD).coalesce(1).write.mode("overwrite").parquet(f"{base}/heads/batch={batch}")
    return batch


def _counting(spark: SparkSession, base: str, table: str) -> DataFrame:
    """The rows of all batches that count."""
    return spark.read.parquet(f"{base}/{table}").where(F.col("batch") <= heads(spark, base)[0])


def read_log(spark: SparkSession, base: str) -> DataFrame:
    """All events with ``segment``, ``prev_hash`` and ``row_hash``, as chaining the whole log would give them."""
    return _counting(spark, base, "log").drop("batch")


def read_seals(spark: SparkSession, base: str) -> DataFrame:
    """The seals as they stand: of each, the one written last."""
    newest = F.max_by(F.struct("n_rows", "last_hash", "segment", "prev_hash", "row_hash"), "batch").alias("x")
    return _counting(spark, base, "seals").groupBy("level", "seq").agg(newest).select("level", "seq", "x.*")
