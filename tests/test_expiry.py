"""Rows whose time runs out, by the stream's own clock."""

from pyspark.sql import functions as F

from vecspan.streaming import expiry


def test_lifetimes(spark, tmp_path):
    """Each step moves the clock; rows end when it passes their time, later where they were inserted again."""
    feed, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    schema = "tag bigint, op string, ts timestamp"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)

    def step(*rows):
        ops = spark.createDataFrame([(t, op, s) for t, op, s in rows], "tag bigint, op string, s bigint").select("tag", "op", F.timestamp_seconds("s").alias("ts"))
        ops.coalesce(1).write.mode("append").parquet(feed)
        query = expiry.keep_visible(expiry.with_expiry(spark.readStream.schema(schema).parquet(feed), 10), out, offsets)
        query.awaitTermination()
        return sorted(r.id for r in expiry.visible_ids(spark.read.parquet(out)).collect())

    assert step((1, "insert", 100), (2, "insert", 105), (None, "insert", 105)) == [1, 2]
    assert step((3, "insert", 109)) == [1, 2, 3]
    assert step((1, "insert", 111), (4, "insert", 111)) == [1, 2, 3, 4]
    assert step((5, "insert", 115)) == [1, 3, 4, 5]
    assert step((4, "delete", 116), (5, "delete", 116), (5, "insert", 116)) == [1, 3, 5]
    assert step((6, "insert", 130)) == [6]
    kinds = {(r.id, r.op, r.at) for r in spark.read.parquet(out).where("op = 'expire'").collect()}
    assert kinds == {(2, "expire", 115_000), (3, "expire", 119_000), (1, "expire", 121_000), (5, "expire", 126_000)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
