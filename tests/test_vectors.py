"""Hand-computed cases of distances, vector functions and search."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecspan.functions import distance, vectors
from vecspan.operators import evaluate, factory, ivf, maintain, topk
from vecspan.operators.topk import exact_knn, rank_small

POINTS = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 4.0]), (4, [1.0, 0.0])]


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame(POINTS, "vec_id bigint, embedding array<float>")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(0, [0.0, 0.0])], "qid bigint, embedding array<float>")


def ids(df):
    return [(r.vec_id, r.dist) for r in sorted(df.collect(), key=lambda r: r.rank)]


@pytest.mark.parametrize("method", ["sql", "arrow"])
def test_golden_search(base, queries, method):
    assert ids(exact_knn(base, queries, 2, method=method)) == [(0, 0.0), (1, 1.0)]
    assert ids(exact_knn(base, queries, 10, method=method)) == [(0, 0.0), (1, 1.0), (4, 1.0), (2, 4.0), (3, 25.0)]
    assert ids(exact_knn(base, queries, 2, where="vec_id >= 2", method=method)) == [(4, 1.0), (2, 4.0)]
    assert ids(exact_knn(base, queries, 5, "l1", method=method))[-1] == (3, 7.0)
    assert exact_knn(base.limit(0), queries, 3, method=method).count() == 0


def test_unknown_metric(base, queries):
    with pytest.raises(ValueError):
        exact_knn(base, queries, 1, "hamming")


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(distance.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, None]
    distance.register(spark)
    assert [r[0] for r in rows.selectExpr("cosine_distance(a, b)").collect()] == [1.0, None]
    assert rows.selectExpr("l2_sq(a, b)").first()[0] == 5.0
    assert rows.selectExpr("l2_int(a, b)").first()[0] == 2


def test_scalar_functions(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("x")).first().x

    arr = lambda *v, t="float": F.array(*[F.lit(float(x)).cast(t) for x in v])
    assert value(vectors.cast_int(arr(-1.7, 1.7))) == [-1, 1]
    assert value(vectors.quantize_int8(arr(0.5, 3, -3), 0.0, 2.0)) == [64, 127, -128]
    assert [round(x, 6) for x in value(vectors.normalize(arr(3, 4)))] == [0.6, 0.8]
    assert len(value(vectors.pad(arr(*range(5))))) == 8 and len(value(vectors.pad(arr(*range(8))))) == 8
    assert value(vectors.sparsity(arr(0, 0, 0, 1))) == 75.0
    assert not value(vectors.is_sparse(arr(0, 0, 1, 1)))
    assert value(vectors.wrap_uint8(F.array(F.lit(257), F.lit(-1)))) == [1, 255]
    assert value(distance.l2_int(F.array(F.lit(0), F.lit(0)), F.array(F.lit(1), F.lit(3)))) == 3
    assert vectors.truth_name(200_000_000) == "200M" and vectors.truth_name(1_000_000_000) == "1B"


def test_bounds(base, spark):
    with pytest.raises(ValueError):
        vectors.row_slice(base, 3, 5, total=5)
    other = spark.createDataFrame([(9, [1.0])], "vec_id bigint, embedding array<float>")
    with pytest.raises(ValueError):
        vectors.concat(base, other)
    with pytest.raises(Exception, match="not a vector"):
        base.select(vectors.checked(F.col("embedding"), 3)).collect()


def test_golden_clusters(spark, base, queries):
    cents = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 3.0]), (2, [100.0, 100.0])], "cluster_id bigint, centroid array<double>")
    a = ivf.assign(base, cents, keep=["vec_id", "embedding"])
    nav = {r.cluster_id: (r["size"], r.nav) for r in ivf.cluster_nav(ivf.cluster_sizes(a, cents)).collect()}
    assert nav == {0: (4, 0), 1: (1, 4), 2: (0, 5)}
    laid = ivf.layout(a)
    assert [r.vec_id for r in laid.orderBy("new_pos").collect()] == [0, 1, 2, 4, 3]
    assert ids(ivf.search(laid, cents, queries, 5, 1)) == [(0, 0.0), (1, 1.0), (4, 1.0), (2, 4.0)]
    assert ids(ivf.search(laid, cents, queries, 5, 3)) == ids(exact_knn(base, queries, 5))
    assert [x for x, _ in ids(ivf.search(laid, cents, queries, 5, 1, cap=2))] == [0, 1]


def test_evaluation(spark):
    truth = spark.createDataFrame([(q, r, v, float(r)) for q in range(3) for r, v in enumerate((7, 3, 9, 2), 1)], "qid bigint, rank bigint, vec_id bigint, dist double")
    got = spark.createDataFrame([(0, 1, 7, 0.0), (1, 5, 7, 0.0), (2, 1, 1, 0.0)], "qid bigint, rank bigint, vec_id bigint, dist double")
    recall = {r.r: round(r.recall, 6) for r in evaluate.recall_at(got, truth, (1, 10)).collect()}
    assert recall == {1: round(1 / 3, 6), 10: round(2 / 3, 6)}
    one = truth.where("qid = 0")
    res = spark.createDataFrame([(0, 1, 7, 1.0), (0, 2, 9, 2.0)], "qid bigint, rank bigint, vec_id bigint, dist double")
    gone = spark.createDataFrame([(3,)], "tag bigint")
    assert evaluate.k_recall(res, one, 2, gone).first().recall == 100.0
    ten = spark.createDataFrame([(float(x),) for x in range(1, 11)], "value double")
    assert {r.p: r.value for r in evaluate.nearest_rank(ten, "value", (0.5, 0.9, 0.99)).collect()} == {0.5: 6.0, 0.9: 10.0, 0.99: 10.0}


def test_factory():
    assert factory.parse("IVF512,Flat") == factory.IndexSpec(nlist=512, flat=True)
    assert factory.parse("IVF4096,PQ32").pq == 32 and factory.parse("PCA80,Flat").pca == 80
    for bad in ("IVF512", "HNSW32", "Flat,PQ8", "Flat,Flat"):
        with pytest.raises(ValueError):
            factory.parse(bad)
    assert (ivf.train_rows(4096, True), ivf.train_rows(4096, False), ivf.multi_train_rows(10, 8)) == (25_600, 409_600, 65_536)


def test_store(spark, base, tmp_path):
    store = maintain.VectorStore(spark, str(tmp_path / "s")).create(base)
    one = spark.createDataFrame([(1,)], "tag bigint")
    assert store.delete(one).count() == 0
    assert [r.tag for r in store.delete(one).collect()] == [1]
    store.insert(spark.createDataFrame([(1, [9.0, 9.0]), (8, [5.0, 5.0])], "vec_id bigint, embedding array<float>"))
    before = sorted((r.vec_id, tuple(r.embedding)) for r in store.rows().collect())
    assert (1, (9.0, 9.0)) in before and len(before) == 6
    store.merge()
    assert sorted((r.vec_id, tuple(r.embedding)) for r in store.rows().collect()) == before


def test_search_during_merges(spark, tmp_path):
    base = spark.createDataFrame([(i, [float(i)]) for i in range(20)], "vec_id bigint, embedding array<float>")
    store = maintain.VectorStore(spark, str(tmp_path / "s")).create(base.where("vec_id < 10"))
    q = spark.createDataFrame([(0, [0.0])], "qid bigint, embedding array<float>")
    steps = [("insert", base.where("vec_id >= 10 and vec_id < 15")), ("delete", base.where("vec_id < 5").selectExpr("vec_id AS tag")), ("insert", base.where("vec_id >= 15"))]
    seen: list = []
    for r in maintain.update_while_searching(store, q, 100, steps).orderBy("search", "vec_id").collect():
        seen += [[]] * (r.search + 1 - len(seen))
        seen[r.search] = [*seen[r.search], r.vec_id]
    states = [list(range(10)), list(range(15)), list(range(5, 15)), list(range(5, 20))]
    assert seen and all(s in states for s in seen) and [states.index(s) for s in seen] == sorted(states.index(s) for s in seen)
    assert sorted(r.vec_id for r in store.rows().collect()) == states[-1] and store._version()[0] == 3
    tags = spark.createDataFrame([(0, 70), (1, maintain.INVALID_TAG)], "position bigint, tag bigint")
    found = spark.createDataFrame([(0, 1, 0, 0.5), (0, 2, 1, 0.7)], "qid bigint, rank bigint, vec_id bigint, dist double")
    assert [r.tag for r in maintain.positions_to_tags(found, tags).collect()] == [70]
    assert [r.tag for r in maintain.sorted_tags(tags.select("tag")).collect()] == [70]


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 30), st.integers(1, 6), st.integers(1, 8), st.sampled_from(distance.METRICS), st.integers(0, 10**6))
def test_nearest_is_exact(n, d, k, metric, seed):
    r = np.random.default_rng(seed)
    x, y = r.integers(-2, 3, (4, d)).astype(float), r.integers(-2, 3, (n, d)).astype(float)
    i, j, dist = distance.nearest(x, y, k, metric)
    full = np.array([distance.exact(np.repeat(q[None], n, 0), y, metric) for q in x])
    for q in range(4):
        ok = [(full[q, c], c) for c in range(n) if not np.isnan(full[q, c])]
        assert list(zip(dist[i == q], j[i == q], strict=True)) == sorted(ok)[:k]


def test_rank_small_limit(spark, base):
    with pytest.raises(ValueError):
        rank_small(base, base.select(F.col("vec_id").alias("cluster_id"), F.col("embedding").alias("centroid")), 1, most=2)


def test_index_saved(spark, tmp_path):
    b = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    index = ivf.IvfIndex.build(b, 8, 2)
    index.save(str(tmp_path / "i"))
    again = ivf.IvfIndex.load(spark, str(tmp_path / "i"))
    q = b.where("vec_id < 5").select(F.col("vec_id").alias("qid"), "embedding")
    assert again.lists.count() == b.count()
    assert sorted(map(tuple, again.search(q, 5, 8).collect())) == sorted(map(tuple, exact_knn(b, q, 5).collect()))
    few, more = (again.search(q, 5, p).count() for p in (1, 8))
    assert few <= more == 25


def test_workloads(spark, tmp_path):
    b = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "vec_id bigint, embedding array<float>")
    store = maintain.VectorStore(spark, str(tmp_path / "c")).create(b)
    for low, full in maintain.delete_reinsert_cycles(store, b, 0.3, 2):
        assert low < full == 60
    assert vectors.same_rows(store.rows(), b) and not vectors.same_rows(b, b.limit(3))
    grown = maintain.ramp_up(maintain.VectorStore(spark, str(tmp_path / "r")).create(b.limit(0)), b, 2, 0.5, 0.1)
    assert 0 < grown[0] < grown[1] <= 60
    one, two = (vectors.random_values(b, seed=4).collect() for _ in range(2))
    assert one == two and all(0 <= x < 1 for r in one for x in r.embedding)
    more = ivf.IvfIndex.build(b.where("vec_id < 30"), 4, 1).add(b.where("vec_id >= 30"))
    assert more.lists.count() == 60


def test_nearest_within_a_bound():
    """Rows beyond the first part, ties and a bound: as by brute force."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(7, 4)), rng.normal(size=(2 * distance.HEAD + 5, 4)).round(1)
    for metric in distance.METRICS:
        for k in (1, 12):
            i, j, d = distance.nearest(x, y, k, metric)
            bound = d[i.searchsorted(np.arange(7)) + k - 1]
            for got in ((i, j, d), distance.nearest(x, y, k, metric, bound=bound), distance.nearest(x, y, k, metric, bound=bound + 1)):
                for q in range(7):
                    all_ = distance.exact(np.tile(x[q], (len(y), 1)), y, metric)
                    by = np.lexsort((np.arange(len(y)), all_))[:k]
                    assert got[1][got[0] == q].tolist() == by.tolist() and got[2][got[0] == q].tolist() == all_[by].tolist()


def test_declarative_search_sorts_few_pairs(spark, monkeypatch):
    """Pairs beyond a bound from a sample don't leave the join; odd lengths, nulls, ties, and k beyond the rows."""
    monkeypatch.setattr(topk, "pairs", None)
    base = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") * p % 97).cast("float") for p in (3, 5, 7)]).alias("embedding"))
    odd = spark.createDataFrame([(-1, None), (-2, [1.0, None, 2.0]), (-3, [1.0, 2.0]), (-4, [float("nan")] * 3)], "vec_id long, embedding array<float>")
    rows = base.unionByName(odd)
    queries = rows.where("vec_id < 40").select(F.col("vec_id").alias("qid"), "embedding")
    for metric in ("l2_sq", "l1", "cosine"):
        got = topk.exact_knn(rows, queries.where("qid >= 0"), 5, metric, method="sql").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, topk.exact_knn(base, queries.where("qid >= 0"), 5, metric).collect()))
    assert [tuple(r) for r in topk.exact_knn(rows, queries.where("qid < 0"), 5, method="sql").collect()] == [(-3, 1, -3, 0.0)]
    assert topk.exact_knn(rows.limit(0), queries, 5, method="sql").collect() == []
    assert topk.exact_knn(base.limit(3), queries.where("qid = 1"), 5, method="sql").count() == 3
    as_columns = lambda df, id_, name: df.select(id_, F.col("embedding").cast("array<double>").alias(name))
    left = topk.knn_by_columns(as_columns(base, "vec_id", "v"), as_columns(queries.where("qid >= 0"), "qid", "q"), 5, lambda x, y: distance.totals("l2_sq", x, y))
    assert 200 <= left.count() < 40 * 3000 / 4


def test_block_join_in_two_directions(spark, monkeypatch):
    monkeypatch.setattr(topk, "BASE_BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_CELL", 60)
    rows = spark.range(500).select("id", F.array(*[(F.col("id") * p % 89).cast("float") for p in (3, 5, 11)]).alias("v"))
    queries = rows.withColumnRenamed("id", "qid")
    found = topk.merge_topk(topk.block_join(rows, queries, 4, "l2_sq"), 4, "id")
    want = topk.exact_knn(rows, queries, 4, id_col="id", vec_col="v")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_pairs_are_compiled(spark):
    """No function over arrays computes a distance; odd lengths and nulls have none."""
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [4.0, 6.0]), (3, [1.0]), (4, None), (5, [None, 1.0])], "vec_id long, embedding array<float>")
    found = topk.pairs(rows, rows.withColumnRenamed("vec_id", "qid"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 0.0), (1, 2, 25.0), (2, 1, 25.0), (2, 2, 0.0), (3, 3, 0.0)]
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert topk.pairs(rows, rows.withColumnRenamed("vec_id", "qid").where("qid = 4")).collect() == []
