"""Blocks of the exact search and the single precision of its product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspan.functions import distance
from vecspan.operators import topk


def test_no_task_has_two_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BASE_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_CELL", 25)
    rows = spark.range(200).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    both = topk.paired_blocks(rows, rows.withColumnRenamed("id", "qid"))
    tasks = both.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("block").alias("blocks"), F.count("*").alias("n")).collect()
    assert len(tasks) == 4 * 8 and {t.blocks for t in tasks} == {1}
    assert sum(t.n for t in tasks) == 200 * 8 + 200 * 4
    found = topk.merge_topk(topk.block_join(rows, rows.withColumnRenamed("id", "qid"), 3, "l2_sq"), 3, "id")
    assert {(r.qid, r.rank, r.id) for r in found.where("qid = 7").collect()} == {(7, 1, 7), (7, 2, 6), (7, 3, 8)}


@pytest.mark.parametrize(("scale", "offset"), [(1.0, 0.0), (1e-14, 0.0), (1e17, 0.0), (1.0, 1e9), (1e-3, 4096.0)])
def test_single_precision_finds_what_double_does(monkeypatch, scale, offset):
    monkeypatch.setattr(distance, "HEAD", 64)
    rng = np.random.default_rng(3)
    y = (rng.normal(size=(400, 8)) + offset) * scale
    y[200:300] = y[:100]  # ties
    x = np.concatenate([y[:20], (rng.normal(size=(10, 8)) + offset) * scale])
    i, j, d = distance.nearest(x, y, 7, "l2_sq")
    for at in range(len(x)):
        all_ = distance.exact(np.repeat(x[at][None], 400, 0), y, "l2_sq")
        want = np.lexsort((np.arange(400), all_))[:7]
        assert j[i == at].tolist() == want.tolist()
        assert d[i == at].tolist() == all_[want].tolist()


def test_many_probes_are_several_scans_and_no_join(spark, monkeypatch):
    from vecspan.operators import ivf

    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))], "vec_id bigint, embedding array<float>")
    cents = ivf.kmeans(rows, 8, 2)
    lists = ivf.ordered(ivf.assign(rows, cents, keep=["vec_id", "embedding"]).drop("dist"))
    queries = rows.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "qid")
    want = sorted(map(tuple, ivf.search(lists, cents, queries, 5, 6).collect()))
    monkeypatch.setattr(ivf, "MOST_PAIRS", 100)

    def no_join(*_, **__):
        raise AssertionError("a row a query and candidate")

    monkeypatch.setattr(ivf, "candidates", no_join)
    assert sorted(map(tuple, ivf.search(lists, cents, queries, 5, 6).collect())) == want
    assert len(want) == 500


@pytest.mark.parametrize("named", [False, True])
def test_a_task_passes_on_k_codes_of_a_query(spark, named):
    """However many batches and clusters a task reads."""
    from vecspan.operators import pq

    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))], "vec_id bigint, embedding array<float>")
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    if named:
        rows = rows.withColumn("vec_id", F.concat(F.lit("é"), F.lpad(F.col("vec_id").cast("string"), 4, "0")))
    index = pq.IvfPqIndex.build(rows, 5, 4, codes=16, iterations=2)
    asked = [(q.qid, c, [float(x) for x in q.embedding]) for q in queries.collect() for c in range(5)]
    cents = {r.cluster_id for r in index.centroids.collect()}
    block = [a for a in asked if a[1] in cents]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        found = index._scan(index.lists.coalesce(1), block, 7)
        assert found.groupBy("qid").count().agg(F.max("count"), F.count("*")).first()[:] == (7, 20)
        near = sorted(map(tuple, index.search(queries, 7, 5).select("qid", "vec_id", "dist").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, found.select("qid", "vec_id", "dist").collect())) == near
    assert near == sorted(map(tuple, index._routed(index.lists, spark.createDataFrame(block, "qid bigint, cluster_id bigint, q array<double>"), 7).transform(lambda d: pq.merge_topk(d, 7)).select("qid", "vec_id", "dist").collect()))
