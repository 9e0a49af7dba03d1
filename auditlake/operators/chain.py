"""Tamper-evident event log.

Hashing every event onto its predecessor is sequential, so the log is cut into segments of
consecutive ids: rows are chained inside a segment, and the segments' last hashes are themselves
chained (``seal_segments``), again in segments, up to a single root.  Every step handles at most ``SEGMENT`` rows at a
time whatever the size of the log or the skew of its users, and each segment is checked in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.session import materialize

GENESIS = "0" * 64
SEGMENT = 256

# ---- fixed values: event vocabulary and hashed fields ----
EVENT_TYPES = ("flag_generated", "flag_viewed", "action_taken", "model_updated")
CONTENT_FIELDS = (
    "utc_timestamp", "event_type", "user", "provider_id", "model_version", "signals_shown",
    "action_taken", "reasoning",
)
# ---- end of fixed values ----


def checked_events(events: DataFrame) -> DataFrame:
    """Events ready to append; an unknown event type fails the write."""
    failure = F.raise_error(F.concat(F.lit("unknown event type: "), F.coalesce("event_type", F.lit("null"))))
    known = F.col("event_type").isin(*EVENT_TYPES)
    return events.withColumn("event_type", F.when(known, F.col("event_type")).otherwise(failure.cast("string")))


def content(fields: Sequence[str]) -> Column:
    """Canonical text of the protected fields: JSON with sorted names, nulls kept."""
    named = F.struct(*[F.col(f"`{f}`") for f in sorted(fields)])
    return F.to_json(named, {"ignoreNullFields": "false"})


def _link(previous: Column, text: Column) -> Column:
    return F.sha2(F.concat(previous, text).cast("binary"), 256)


def segment_of(seq: str) -> Column:
    return F.floor(F.col(seq) / SEGMENT)


def chained(
    events: DataFrame, fields: Sequence[str], seq: str = "seq", start: tuple[int, str] | None = None
) -> DataFrame:
    """Events with ``segment``, ``prev_hash`` and ``row_hash``.

    ``start`` names a segment that has begun already and the hash that its next row continues from.
    """
    entry = F.struct(F.col(seq), content(fields).alias("text"), F.struct("*").alias("event"))
    segments = events.select(segment_of(seq).alias("segment"), entry.alias("entry")).groupBy("segment").agg(
        F.sort_array(F.collect_list("entry")).alias("entries")
    )
    first = F.lit(GENESIS)
    if start is not None:
        first = F.when(F.col("segment") == start[0], F.lit(start[1])).otherwise(first)
    hashes = F.aggregate(
        "entries",
        F.array(first),
        lambda done, e: F.array_append(done, _link(F.element_at(done, -1), e["text"])),
    )
    return (
        segments.withColumn("hashes", hashes)
        .select("segment", "hashes", F.posexplode("entries").alias("place", "entry"))
        .select(
            "entry.event.*", "segment",
            F.element_at("hashes", F.col("place") + 1).alias("prev_hash"),
            F.element_at("hashes", F.col("place") + 2).alias("row_hash"),
        )
    )


_SEAL_FIELDS = ("seq", "n_rows", "last_hash")


def seal_segments(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Seals of all levels: one row per segment, then one per segment of these seals, until a single root is left.

    ``seq`` is the sealed segment, ``n_rows`` and ``last_hash`` what it held. Whoever keeps the root alone can tell that a row, a
    segment, the log's end or a seal was removed or changed.
    """
    level, out, below, by = 0, None, log, seq
    while True:
        level += 1
        digests = below.groupBy("segment").agg(F.count(F.lit(1)).alias("n_rows"), F.max_by("row_hash", by).alias("last_hash"))
        seals = materialize(chained(digests.withColumnRenamed("segment", "seq"), _SEAL_FIELDS).withColumn("level", F.lit(level)))
        out = seals if out is None else out.unionByName(seals)
        if seals.limit(2).count() < 2:
            return out
        below, by = seals, "seq"


def root(seals: DataFrame) -> DataFrame:
    """One row with the hash that stands for the whole log; none for an empty one."""
    return seals.select(F.max_by("row_hash", "level").alias("root")).where(F.col("root").isNotNull())


def bad_links(log: DataFrame, fields: Sequence[str], seq: str = "seq") -> DataFrame:
    """Rows whose link to the predecessor is broken or whose content was altered."""
    order = Window.partitionBy(segment_of(seq)).orderBy(seq)
    before = F.coalesce(F.lag("row_hash").over(order), F.lit(GENESIS))
    problem = F.when(F.col("prev_hash") != before, "break").when(
        F.col("row_hash") != _link(F.col("prev_hash"), content(fields)), "tampered"
    )
    return log.withColumn("problem", problem).where(F.col("problem").isNotNull())


def verify(log: DataFrame, fields: Sequence[str], seq: str = "seq", seals: DataFrame | None = None) -> DataFrame:
    """One row: is the log intact, and where is the first bad row?

    With stored ``seals`` it also finds what the rows alone cannot show: segments that are missing, cut short or rewritten. Their first bad
    id is the first one that is not there, or the segment's first.
    """
    bad = bad_links(log, fields, seq).select(F.col(seq).cast("long").alias("id"), "problem")
    if seals is not None:
        ends = log.groupBy("segment").agg(F.max(seq).alias("last"), F.count(F.lit(1)).alias("rows_now"))
        cut = broken_seals(log, seals, seq).join(ends, "segment", "left")
        shorter = F.coalesce("rows_now", F.lit(0)) < F.coalesce("n_rows", F.lit(0))
        at = F.when(shorter, F.coalesce(F.col("last") + 1, F.col("segment") * SEGMENT)).otherwise(F.col("segment") * SEGMENT)
        cut = cut.select("segment", at.cast("long").alias("id"), F.when(shorter, "removed").otherwise("rewritten").alias("problem"))
        # a segment whose rows show the fault themselves is reported by its rows
        shown = bad.select(F.floor(F.col("id") / SEGMENT).alias("segment")).distinct()
        bad = bad.unionByName(cut.join(shown, "segment", "left_anti").select("id", "problem"))
    first = bad.agg(F.min(F.struct("id", "problem")).alias("first"))
    total = log.agg(F.count(F.lit(1)).alias("n")).scalar()
    return first.select(
        F.col("first").isNull().alias("ok"),
        total.alias("total_rows"),
        F.col("first.id").alias("first_bad_id"),
        F.coalesce(F.col("first.problem"), F.lit("intact")).alias("verdict"),
    )


def broken_seals(log: DataFrame, seals: DataFrame, seq: str = "seq") -> DataFrame:
    """(segment, n_rows): segments whose stored seal does not match the log (missing, cut short, extended, rewritten)."""
    now = log.groupBy("segment").agg(F.count(F.lit(1)).alias("rows_now"), F.max_by("row_hash", seq).alias("hash_now"))
    stored = seals.where(F.col("level") == 1).select(F.col("seq").alias("segment"), "n_rows", "last_hash")
    both = stored.join(now, "segment", "full_outer")
    same = F.col("n_rows").eqNullSafe(F.col("rows_now")) & F.col("last_hash").eqNullSafe(F.col("hash_now"))
    return both.where(~same).select("segment", "n_rows")


def verify_seals(log: DataFrame, seals: DataFrame, seq: str = "seq") -> DataFrame:
    """The segments that the stored seals do not vouch for."""
    return broken_seals(log, seals, seq).select("segment")


def newest(log: DataFrame, n: int = 100, seq: str = "seq") -> DataFrame:
    """The n latest entries without their hashes."""
    return log.drop("row_hash", "prev_hash", "segment").orderBy(F.col(seq).desc()).limit(n)
