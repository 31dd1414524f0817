"""Streams of inserts and deletes into a vector store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecspan.operators.maintain import VectorStore, latest


def apply_batch(store: VectorStore, ops: DataFrame, vectors: DataFrame | None = None) -> None:
    """Apply (op, tag[, batch][, vector]) rows, whatever batches they hold: each tag ends as its last batch leaves it.

    In a batch deletes come first, then inserts (maintain.latest). Without a vector column the
    vectors of inserts are fetched from ``vectors`` by tag. Which of several inserts of a tag in
    its last batch holds isn't defined.
    """
    if "batch" not in ops.columns:
        ops = ops.withColumn("batch", F.lit(0).cast("bigint"))
    last = latest(ops).withColumnRenamed("batch", "last")
    ops = ops.join(last, ["tag", "op"]).where("batch = last").drop("last")
    deletes = ops.where("op = 'delete'").select("tag").distinct()
    inserts = ops.where("op = 'insert'").dropDuplicates(["tag"])
    if not deletes.isEmpty():
        store.delete(deletes)
    if vectors is not None:
        rows = inserts.select(F.col("tag").alias(store.id_col)).join(vectors, store.id_col)
    else:
        rows = inserts.drop("op", "batch").withColumnRenamed("tag", store.id_col)
    if not rows.isEmpty():
        store.insert(rows)


def ingest(stream: DataFrame, store: VectorStore, checkpoint: str, vectors: DataFrame | None = None, once: bool = True) -> StreamingQuery:
    """Feed a stream of operations to the store, a micro-batch at a time, with compaction by size.

    Searches meanwhile read the store's last snapshot, delta and tombstones.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            apply_batch(store, batch, vectors)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_windows(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of an event stream by window and type; late rows beyond the watermark are left out."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
