"""Properties of indexes, codebooks and graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspan.functions import vectors
from vecspan.operators import evaluate, factory, graph, ivf, multi, pq, topk, transform
from vecspan.operators.topk import exact_knn
from vecspan.sources import text


@pytest.fixture(scope="module")
def base(spark):
    return spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 200")


@pytest.fixture(scope="module")
def queries(base):
    return base.where("vec_id < 6").select(F.col("vec_id").alias("qid"), "embedding")


def pairs(df):
    return sorted((r.qid, r["rank"], r.vec_id) for r in df.collect())


def test_full_probe_is_exact(base, queries):
    cents = ivf.kmeans(base, 8, 2)
    lists = ivf.assign(base, cents, keep=["vec_id", "embedding"])
    assert pairs(ivf.search(lists, cents, queries, 5, 8)) == pairs(exact_knn(base, queries, 5))
    hits = [len(set(pairs(ivf.search(lists, cents, queries, 5, p))) & set(pairs(exact_knn(base, queries, 5)))) for p in (1, 4, 8)]
    assert hits == sorted(hits) and hits[-1] == 30


def test_kmeans_repeats_and_improves(base):
    def inertia(rounds):
        return ivf.assign(base, ivf.kmeans(base, 8, rounds)).agg(F.sum("dist")).first()[0]

    assert [tuple(r) for r in ivf.kmeans(base, 8, 2).collect()] == [tuple(r) for r in ivf.kmeans(base, 8, 2).collect()]
    found = [inertia(n) for n in (0, 1, 3)]
    assert found[0] >= found[1] >= found[2]


def test_row_order_does_not_matter(base, queries):
    assert pairs(exact_knn(base.orderBy(F.desc("vec_id")).repartition(5), queries, 5)) == pairs(exact_knn(base, queries, 5))


def test_codebook(base, queries):
    book = pq.train_codebook(base, 4, 64, codes=8, iterations=2)
    assert book.count() == 32
    codes = pq.encode(base, book, 4, 64)
    assert codes.count() == 800 and codes.agg(F.max("code")).first()[0] < 8
    assert pq.adc_search(base, book, queries, 5, 64).count() == 30

    def loss(rounds):
        centers = {(r.chunk, r.code): np.array(r.center) for r in pq.train_codebook(base, 4, 64, codes=8, iterations=rounds).collect()}
        found = {(r.vec_id, r.chunk): r.code for r in pq.encode(base, pq.train_codebook(base, 4, 64, codes=8, iterations=rounds), 4, 64).collect()}
        return sum(((np.array(r.embedding[16 * c : 16 * c + 16]) - centers[c, found[r.vec_id, c]]) ** 2).sum() for r in base.collect() for c in range(4))

    assert loss(3) < loss(0)
    with pytest.raises(ValueError):
        pq.chunks(base, 5, 64)


def test_ivf_pq(spark, base, queries, tmp_path):
    """As many codes as rows: distances are exact, so the search is that of the lists."""
    index = factory.build(base, "IVF4,PQ8", codes=200, iterations=2)
    index.save(str(tmp_path / "i"))
    again = pq.IvfPqIndex.load(spark, str(tmp_path / "i"))
    want = pairs(ivf.search(ivf.assign(base, index.centroids, keep=["vec_id", "embedding"]), index.centroids, queries, 3, 2))
    cents = index.centroids
    book = pq.seed_codebook(pq.differences(base, cents), 8, 64, 200)
    exact = pq.IvfPqIndex.build(base, 4, 8, centroids=cents, codebook=book)
    assert pairs(exact.search(queries, 3, 2)) == want
    assert pairs(again.search(queries, 3, 4)) == pairs(index.search(queries, 3, 4)) and again.lists.count() == 200
    some = pq.IvfPqIndex.build(base.where("vec_id < 90"), 4, 8, centroids=cents, codebook=book).add(base.where("vec_id >= 90"))
    assert pairs(some.search(queries, 3, 2)) == want
    assert all(r.vec_id >= 50 for r in again.search(queries, 3, 4, where="vec_id >= 50").collect())
    assert factory.build(base, "PQ4", codes=8, iterations=1).search(queries, 5, 1).count() == 30


def test_sums_are_passed_on_in_pieces(base, monkeypatch):
    want = ivf.kmeans(base, 8, 2).orderBy("cluster_id").collect()
    monkeypatch.setattr(ivf, "MOST_SUMS", 0)
    got = ivf.kmeans(base.repartition(3, "vec_id"), 8, 2).orderBy("cluster_id").collect()
    assert [r.cluster_id for r in got] == [r.cluster_id for r in want]
    assert np.allclose([r.centroid for r in got], [r.centroid for r in want], atol=1e-9)


def test_block_join(base, queries, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 1)
    monkeypatch.setattr(topk, "MOST_BLOCKS", 2)
    want = pairs(exact_knn(base, queries, 5, method="sql"))
    for block in (16, 1000):
        monkeypatch.setattr(topk, "BASE_BLOCK", block)
        assert pairs(exact_knn(base, queries, 5)) == want


@pytest.mark.parametrize("metric", ["l2_sq", "l1", "cosine"])
def test_vectors_without_distances(spark, metric):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [nan, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [inf, 0.0]), (5, [None, 1.0]), (6, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    q = df.select(F.col("vec_id").alias("qid"), "embedding")
    arrow, sql = (pairs(exact_knn(df, q, 5, metric, method=m)) for m in ("arrow", "sql"))
    assert arrow == sql and {x[0] for x in arrow} == {x[2] for x in arrow} == {0, 2, 6} and len(arrow) == 9
    cents = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster_id bigint, centroid array<double>")
    assert sorted(r.vec_id for r in ivf.assign(df, cents, metric).collect()) == [0, 2, 6]


def test_layout_of_a_large_cluster(base):
    rows = base.withColumn("cluster_id", F.when(F.col("vec_id") < 150, 0).otherwise(F.col("vec_id") % 3 + 1).cast("bigint"))
    want = sorted((r.cluster_id, r.vec_id) for r in rows.select("cluster_id", "vec_id").collect())
    got = {(r.cluster_id, r.vec_id): (r.pos, r.new_pos) for r in ivf.layout(rows).collect()}
    first = {c: i for i, (c, _) in reversed(list(enumerate(want)))}
    assert got == {(c, v): (i - first[c], i) for i, (c, v) in enumerate(want)}


def test_evaluation_sweep(base, queries):
    cents = ivf.kmeans(base, 8, 1)
    lists = ivf.assign(base, cents, keep=["vec_id", "embedding"])
    out = evaluate.evaluate_index(lambda q, k, p: ivf.search(lists, cents, q, k, p), queries, exact_knn(base, queries, 1), 10, [1, 8]).collect()
    assert {(r.setting, r.r) for r in out} == {(p, r) for p in (1, 8) for r in (1, 10, 100)} and all(r.milliseconds > 0 for r in out)
    assert all(r.recall == 1.0 for r in out if r.setting == 8)


def test_graph_sweep(base, queries):
    edges = graph.both_ways(graph.knn_graph(base, 6))
    sweep = graph.search_sweep(edges, base, queries, exact_knn(base, queries, 5), 5, [5, 40], centroids=ivf.kmeans(base, 8, 1))
    rows = sorted((r.width, r.recall) for r in sweep.collect())
    assert [w for w, _ in rows] == [5, 40] and rows[0][1] <= rows[1][1] and rows[1][1] >= 0.9
    assert graph.tune_width(sweep, 0.0) == 5 and graph.tune_width(sweep, 1.1) is None


def test_factory_builds(base, queries):
    assert pairs(factory.build(base, "IVF8,Flat", iterations=1).search(queries, 3, 8)) == pairs(exact_knn(base, queries, 3))
    assert factory.build(base, "Flat").count() == 200
    assert vectors.dimension(factory.build(base, "PCA8,Flat").rows) == 8


def test_graphs(base, queries):
    whole = graph.knn_graph(base, 4)
    near = graph.knn_graph(base, 4, centroids=ivf.seed_centroids(base, 8), nprobe=8)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, near.collect()))
    halves = [whole.where("src % 2 = 0"), whole.where("src % 2 = 1")]
    assert sorted(map(tuple, graph.merge_graphs(halves, 4).collect())) == sorted(map(tuple, whole.collect()))
    found = graph.beam_search(whole, base, queries, 3, 16, 2)
    assert found.count() == 18
    with pytest.raises(ValueError):
        graph.beam_search(whole, base, queries, 5, 3)
    some, all_ = (sorted(map(tuple, graph.beam_search(whole, base, queries, 3, 16, checks=c).collect())) for c in (9, 10**6))
    assert len(some) == 18 and all_ == sorted(map(tuple, graph.beam_search(whole, base, queries, 3, 16).collect()))
    assert sum(x[3] for x in some) >= sum(x[3] for x in all_)


def test_sampling(base):
    a, b = (vectors.bernoulli(base, 0.3, seed=2, id_col="vec_id").count() for _ in range(2))
    assert a == b and 20 < a < 110
    assert vectors.synthetic(base.sparkSession, 10, 4).count() == 10


def test_result_files(spark, base, queries, tmp_path):
    text.write_results(exact_knn(base, queries, 2), str(tmp_path / "r"), 2)
    lines = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert sorted(x[0] for x in lines) == [str(i) for i in range(6)] and all(len(x) == 4 and x[1] == "0.0" for x in lines)
    text.write_tags(base.select("vec_id").limit(3), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 3


def test_codes_joined_by_shuffle(base, queries, monkeypatch):
    """Probes beyond the broadcast's bound, blocks of few codes, and filters give the same."""
    index = factory.build(base, "IVF4,PQ8", codes=50, iterations=2)
    want = pairs(index.search(queries, 5, 3))
    some = pairs(index.search(queries, 5, 3, where="vec_id % 2 = 0"))
    monkeypatch.setattr(pq, "MOST_PROBE_VALUES", 1)
    for block in (65_536, 7):
        monkeypatch.setattr(pq, "LIST_BLOCK", block)
        assert pairs(index.search(queries, 5, 3)) == want
        assert pairs(index.search(queries, 5, 3, where="vec_id % 2 = 0")) == some
    assert index.search(queries.limit(0), 5, 3).collect() == []


def test_nothing_to_search(base, queries):
    """No queries, no rows: empty results."""
    none, no_queries = base.limit(0), queries.limit(0)
    for b, q in ((base, no_queries), (none, queries), (none, no_queries)):
        for metric in ("l2_sq", "l1", "cosine"):
            assert exact_knn(b, q, 3, metric).collect() == []
    assert ivf.IvfIndex.build(none, 4, 1).search(queries, 3, 4).collect() == []
    assert ivf.IvfIndex.build(base, 4, 1).search(no_queries, 3, 4).collect() == []


def test_transforms(spark, base, queries, tmp_path):
    """Principal directions against numpy; a transformed index against a search of transformed rows, saved and loaded."""
    x = np.array([r.embedding for r in base.orderBy("vec_id").collect()], float)
    found = transform.pca(base, 5)
    values, directions = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(found.mean, x.mean(0)) and np.allclose(np.abs((found.rows * directions[:, ::-1].T[:5]).sum(1)), 1)
    assert np.allclose(transform.cosines(16, 16).rows @ transform.cosines(16, 16).rows.T, np.eye(16))
    want = pairs(exact_knn(found.apply(base), found.apply(queries), 4))
    for name, nlist in (("flat", None), ("lists", 4)):
        index = transform.TransformedIndex.build(base, found, nlist)
        index.save(str(tmp_path / name))
        for one in (index, transform.TransformedIndex.load(spark, str(tmp_path / name))):
            assert pairs(one.search(queries, 4, nlist)) == want
    assert pairs(factory.build(base, "PCA8,IVF4,Flat", iterations=1).search(queries, 3, 4)) == pairs(factory.build(base, "PCA8,Flat").search(queries, 3))
    odd = spark.createDataFrame([(1, None), (2, [float("nan")] * x.shape[1])], "vec_id long, embedding array<float>")
    assert found.apply(odd).collect() == [] and found.apply(base.limit(0)).collect() == []
    for bad in (lambda: transform.pca(base, 10_000), lambda: transform.pca(base.limit(0), 1), lambda: factory.build(base, "PCA8,PQ4"), lambda: transform.TransformedIndex.load(spark, str(tmp_path / "lists")).search(queries, 3)):
        with pytest.raises(ValueError):
            bad()


def test_multi_sequence():
    """The walk against the sorted product, with ties, and its heap."""
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (5, 3), (20, 30), (0, 3)):
        a, b = rng.integers(0, 6, n).astype(float), rng.integers(0, 6, m).astype(float)
        got = list(multi.nearest_pairs(a, b, 10_000))
        assert [d for d, _, _ in got] == sorted(x + y for x in a for y in b) and len({(i, j) for _, i, j in got}) == n * m
        assert all(d == a[i] + b[j] for d, i, j in got)
        assert list(multi.nearest_pairs(a, b, 4)) == got[:4]
    a, b = rng.random(30), rng.random(30)
    assert [x[1:] for x in multi.nearest_pairs(a, b, 900)] == [(i, j) for _, i, j in sorted((x + y, i, j) for i, x in enumerate(a) for j, y in enumerate(b))]


def test_multi_index(base, queries, monkeypatch):
    """All cells visited find what an exact search finds."""
    index = multi.MultiIndex.build(base, 6, 3)
    assert pairs(index.search(queries, 4, 36)) == pairs(exact_knn(base, queries, 4))
    some = pairs(index.search(queries, 4, 12))
    with monkeypatch.context() as m:
        m.setattr(ivf, "MOST_PAIRS", 1)
        assert pairs(index.search(queries, 4, 12)) == some
    assert index.cells(queries, 5).count() == 5 * queries.count() and index.lists.count() == base.count()
    assert index.search(queries.limit(0), 3, 5).collect() == []


def test_searches_by_join(base, queries, monkeypatch):
    """Beyond the queries that go to every task, and for ids that aren't numbers, lists are joined; the result is the same."""
    cents = ivf.kmeans(base, 6, 2)
    lists = ivf.layout(ivf.assign(base, cents, keep=["vec_id", "embedding"]))
    for metric, cap, where in (("l2_sq", None, None), ("l1", 3, None), ("cosine", None, "vec_id % 3 = 0")):
        want = pairs(ivf.search(lists, cents, queries, 4, 3, metric, cap=cap, where=where))
        with monkeypatch.context() as m:
            m.setattr(ivf, "MOST_QUERIES", 1)
            assert pairs(ivf.search(lists, cents, queries, 4, 3, metric, cap=cap, where=where)) == want
    named = lists.withColumn("vec_id", F.concat(F.lit("r"), F.lpad(F.col("vec_id").cast("string"), 6, "0")))
    want = pairs(ivf.search(lists, cents, queries, 4, 3))
    assert [(q, r, int(v[1:])) for q, r, v in pairs(ivf.search(named, cents, queries, 4, 3))] == want


def test_saving_again(spark, base, queries, tmp_path):
    """An index saved over another: who loaded the first goes on with it, who loads now gets the second."""
    path = str(tmp_path / "index")
    with pytest.raises(ValueError):
        ivf.IvfIndex.load(spark, path)
    ivf.IvfIndex.build(base.where("vec_id < 100"), 4, 1).save(path)
    first = ivf.IvfIndex.load(spark, path)
    ivf.IvfIndex.build(base, 4, 1).save(path)
    assert pairs(first.search(queries, 3, 4)) == pairs(exact_knn(base.where("vec_id < 100"), queries, 3))
    assert pairs(ivf.IvfIndex.load(spark, path).search(queries, 3, 4)) == pairs(exact_knn(base, queries, 3))


def test_sweeps_and_clusters_without_a_row_a_pair(spark, monkeypatch):
    """The join of queries and rows gives the same as the cells, which do without it and keep few rows a task."""
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    queries = base.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    cents = ivf.seed_centroids(base, 8)
    lists = ivf.assign(base, cents, keep=["vec_id", "embedding"]).drop("dist")
    probes = ivf.probe(queries, cents, 5)

    def both():
        sweep = ivf.nprobe_sweep(lists, cents, queries, 7, [4, 1, 8])
        return sorted(map(tuple, sweep.collect())), sorted(map(tuple, ivf.search_clusters(lists, queries, probes, 3).collect()))

    with monkeypatch.context() as m:
        m.setattr(ivf, "MOST_QUERIES", 0)
        want = both()
    monkeypatch.setattr(ivf, "candidates", None)
    assert both() == want and len(want[0]) == 3 * 7 * queries.count()
    monkeypatch.setattr(ivf, "MOST_KEPT", 16)
    assert both() == want
