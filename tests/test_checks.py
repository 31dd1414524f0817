"""One graph search that ends after several numbers of distances."""

from pyspark.sql import functions as F

from vecspan.operators import graph


def test_one_search_for_several_checks(spark):
    """Each number has the result of a search of its own, also numbers that the first rows exceed or that no query comes to."""
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 200")
    queries = base.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    edges = graph.both_ways(graph.knn_graph(base, 4)).checkpoint()
    found = graph.beam_search(edges, base, queries, 4, 8, checks=[2, 20, 60, 10_000]).checkpoint()
    for checks in (2, 20, 60, 10_000):
        alone = graph.beam_search(edges, base, queries, 4, 8, checks=checks)
        assert sorted(map(tuple, found.where(F.col("checks") == checks).drop("checks").collect())) == sorted(map(tuple, alone.collect()))
    assert found.groupBy("checks").count().count() == 4
