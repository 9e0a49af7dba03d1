"""Structured Streaming forms of three batch answers.

Each takes a streaming (or batch) frame and returns the transformation; ``run_once`` drains what is
available into a Parquet table in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditlake.session import shared_dir

_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def daily_alerts(events: DataFrame, limit: float, lateness: str = "1 day") -> DataFrame:
    """Days on which one entity's total exceeds ``limit``, once the watermark has closed the day."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day").alias("w"), "user_id")
        .agg(F.sum(F.rint(F.col("value") * 100.0).cast("long")).alias("c"), F.count(F.lit(1)).alias("n_events"))
        .where(F.col("c") / 100.0 > limit)
        .select(F.col("w.start").cast("date").alias("day"), "user_id", (F.col("c") / 100.0).alias("total"), "n_events")
    )


def first_arrivals(events: DataFrame, keys: list[str], lateness: str = "60 days") -> DataFrame:
    """Drop repeats of ``keys`` on arrival; state is kept for ``lateness`` only."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys).select(*keys)


_LATEST = "user_id long, state string, last_event_id long, n_events long, expired boolean"


class _Latest(StatefulProcessor):
    """Per entity: its latest event by (ts, event_id), how many it had, and a timer that drops it when it stays idle."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, event_id long, event_type string, n_events long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ts, event, kind, count = self.last.get() if self.last.exists() else (None, None, None, 0)
        for pdf in rows:
            count += len(pdf)
            found = pdf.sort_values(["ts_ms", "event_id"], kind="stable").iloc[-1]
            if ts is None or (found["ts_ms"], found["event_id"]) > (ts, event):
                ts, event, kind = int(found["ts_ms"]), int(found["event_id"]), found["event_type"]
        self.last.update((ts, event, kind, count))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ts + self.idle_ms)
        yield self._row(key, kind, event, count, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, event, kind, count = self.last.get()
        self.last.clear()
        yield self._row(key, kind, event, count, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, kind, event, count, expired) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]], "state": [kind], "last_event_id": [event], "n_events": [count], "expired": [expired]})


def latest_states(events: DataFrame, idle_days: int = 400, lateness: str = "30 days") -> DataFrame:
    """Latest event per entity and its running count, with ``expired`` on the last row of an entity that is forgotten.

    The latest event is the one with the largest (ts, event_id), in whatever order events arrive; those later than
    ``lateness`` are dropped.  An entity without events for ``idle_days`` of event time is dropped from the state, which so holds active
    entities only; if it comes back it counts anew.  Needs a RocksDB state store, which is set for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    rows = events.where("user_id is not null and ts is not null").withWatermark("ts", lateness)
    rows = rows.select(F.col("user_id").cast("long").alias("user_id"), "ts", F.unix_millis("ts").alias("ts_ms"), "event_id", "event_type")
    return rows.groupBy("user_id").transformWithStateInPandas(
        _Latest(idle_days * 86_400_000), outputStructType=_LATEST, outputMode="update", timeMode="eventTime"
    )


def run_once(stream: DataFrame, mode: str = "append", keys: tuple[str, ...] = (), base: str | None = None) -> DataFrame:
    """Process everything available and return the written table.

    A run with the ``base`` of an earlier one goes on from where that one stopped.

    In ``update`` mode each micro-batch appends only the rows it changed, stamped with its number;
    the newest row per key is the current state, and a replayed batch does no harm.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{base}/out").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    writer.outputMode("update").foreachBatch(append).start().awaitTermination()
    changes = spark.read.parquet(f"{base}/out")
    newest = F.max_by(F.struct(*stream.columns), "batch").alias("row")
    return changes.groupBy(*keys).agg(newest).select("row.*")
