"""Rows with a time to live in a stream: state with timers says when a row's time has run out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vecspan.session import importable

#: The state store that timers need.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONF = "spark.sql.streaming.stateStore.providerClass"


class Lifetimes(StatefulProcessor):
    """Per id the time, in milliseconds, at which it ends. An insert sets it anew, a delete ends it at once."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.end = handle.getValueState("end", "end long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: (r.at, r.op))  # of one moment the insert holds
        if self.end.exists():
            self.handle.deleteTimer(self.end.get()[0])
            self.end.clear()
        if last.op == "insert":
            end = last.at + self.ttl_ms
            self.end.update((end,))
            self.handle.registerTimer(end)
        yield Row(id=key[0], op=last.op, at=last.at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.end.exists() and self.end.get()[0] == at:
            self.end.clear()
            yield Row(id=key[0], op="expire", at=at)

    def close(self) -> None:
        pass


def with_expiry(stream: DataFrame, ttl_seconds: float, time_col: str = "ts", id_col: str = "tag", op_col: str | None = "op", late: str = "0 seconds") -> DataFrame:
    """(id, op, at) events: the stream's inserts and deletes, and an expire for each row whose time ran out.

    ``stream`` has an id, an event time and an operation (only inserts without one). A row's
    time is ``ttl_seconds`` from its last insert, by the stream's own clock: its watermark, ``late``
    behind the latest event, so that a replay expires the same rows at the same times. State is
    one number an id, in RocksDB, sharded by id; rows without an id are left out. ``at`` is in milliseconds.
    """
    importable(stream.sparkSession)
    op = F.col(op_col) if op_col else F.lit("insert")
    rows = stream.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), op.alias("op"), F.col(time_col).cast("timestamp").alias("event_time"))
    rows = rows.withWatermark("event_time", late).withColumn("at", F.unix_millis("event_time"))
    return rows.groupBy("id").transformWithState(Lifetimes(int(ttl_seconds * 1000)), "id bigint, op string, at bigint", "append", "eventTime")


def keep_visible(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the events of ``with_expiry`` to a Parquet table until the stream's present end."""
    spark = events.sparkSession
    before = spark.conf.get(_CONF, None)
    spark.conf.set(_CONF, _STORE)
    try:
        return events.writeStream.outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(_CONF)
        else:
            spark.conf.set(_CONF, before)


def visible_ids(events: DataFrame) -> DataFrame:
    """(id, at) of what is visible after all events: ids whose last event, of equal times the insert's, is an insert."""
    last = F.max(F.struct("at", F.when(F.col("op") == "insert", 1).otherwise(0).alias("there")))
    return events.groupBy("id").agg(last.alias("last")).where("last.there = 1").select("id", F.col("last.at").alias("at"))
