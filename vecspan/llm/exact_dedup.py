"""Exact dedup by a heavy-hitter split, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, pick


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", track: int = 4096) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text, so
    null and empty texts form one group. Of equal texts the row with the largest id stays
    (repeated rows with that same id all count as kept; a row without an id only where its whole
    group has none). Texts of any length count by their digest. An empty table gives an empty
    result; other columns, whatever their names, are ignored.

    Method: one pass writes (id, digest). A Misra-Gries summary (the mergeable frequent-items
    sketch behind ``approx_top_k``; ``track`` counters, whatever the input size) names the
    digests that may be frequent. Their true sizes and winners are counted exactly and, being at
    most ``track`` rows, broadcast: rows of frequent digests are settled map-side and never
    shuffled. The groups of all other digests, none larger than about rows / track, are counted
    by an aggregation that combines map-side, and an ordinary join returns them to their rows.
    """
    d = pick(docs, doc_id=id_col, text=text_col)
    d = cut(d.select("doc_id", F.unhex(F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)).alias("digest")))
    key = F.xxhash64("digest")
    sketch = d.select(key.alias("k")).agg(F.expr(f"approx_top_k(k, {track}, {8 * track})").alias("top"))
    likely = sketch.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("k"))
    sizes = (F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = d.withColumn("k", key).join(F.broadcast(likely), "k", "left_semi").groupBy("digest").agg(*sizes)
    winners = cut(winners.where("group_size > 1"))
    frequent = d.join(F.broadcast(winners), "digest")
    rest = d.join(F.broadcast(winners), "digest", "left_anti")
    groups = cut(rest.groupBy("digest").agg(*sizes).where("group_size > 1"))
    rest = rest.join(groups, "digest", "left").select("digest", "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    return frequent.select(rest.columns).unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
