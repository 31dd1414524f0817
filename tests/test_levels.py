"""The levelled index and its log: states, conflicts, several writers at once."""

import threading

import pytest
from pyspark.sql import functions as F

from vecspan.operators import maintain
from vecspan.operators.levels import LevelledIndex
from vecspan.operators.topk import exact_knn
from vecspan.session import work_dir
from vecspan.sources.commits import CommitLog, Conflict

SF = "/root/testdata/sf0.001"


@pytest.fixture
def base(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


@pytest.fixture
def index(spark, base):
    return LevelledIndex(spark, work_dir(spark, "levels")).create(base.where("vec_id < 200"), nlist=8)


def ids(df):
    return sorted(r.vec_id for r in df.select("vec_id").collect())


def test_states(spark, base, index):
    assert index.insert(base.where("vec_id between 200 and 249")) == 1
    gone = index.delete(base.where("vec_id % 2 = 0 and vec_id < 300").select("vec_id"))
    assert sorted(r.id for r in index.failed(gone).collect()) == list(range(250, 300, 2))
    assert ids(index.rows()) == list(range(1, 250, 2))
    index.insert(base.where("vec_id in (0, 1)").withColumn("label", F.lit(-1)))
    assert ids(index.rows()) == [0, *range(1, 250, 2)]
    assert {r.vec_id for r in index.rows().where("label = -1").collect()} == {0, 1}
    before = sorted(map(tuple, index.rows().select("vec_id", "label").collect()))
    q = base.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    truth = [tuple(r) for r in exact_knn(index.rows(), q, 5).orderBy("qid", "rank").collect()]
    for step in (None, False, True):
        if step is not None:
            index.merge(whole=step)
        assert sorted(map(tuple, index.rows().select("vec_id", "label").collect())) == before
        assert [tuple(r) for r in index.search(q, 5, 8).orderBy("qid", "rank").collect()] == truth
    assert ids(index.rows(0)) == list(range(200)) and ids(index.rows(1)) == list(range(250))
    assert index.merge() is None and index.merge(whole=True) is None
    assert index.vacuum() > 0 and sorted(map(tuple, index.rows().select("vec_id", "label").collect())) == before
    only = index.search(q, 5, 8, where="label = -1")
    assert {r.vec_id for r in only.collect()} == {0, 1}


def test_odd_rows(spark, base, index):
    """Null, non-finite and no rows; ids that aren't there."""
    odd = spark.createDataFrame([(900, None, 1), (901, [float("nan")] * 64, 1)], "vec_id long, embedding array<float>, label int")
    index.insert(odd)
    index.insert(base.limit(0))
    index.delete(spark.createDataFrame([(None,), (12345,)], "vec_id long"))
    assert ids(index.rows()) == list(range(200))
    index.merge(whole=True)
    assert ids(index.rows()) == list(range(200))
    assert index.search(base.limit(0).select(F.col("vec_id").alias("qid"), "embedding"), 3, 2).collect() == []
    with pytest.raises(ValueError):
        LevelledIndex(spark, index.path).create(base, nlist=2)


def test_merges_that_meet(spark, base, index):
    """Of two merges of one folder the later is a conflict and leaves nothing; deletes and inserts beside a merge hold."""
    index.insert(base.where("vec_id between 200 and 219"))
    index.insert(base.where("vec_id between 220 and 239"))
    other = LevelledIndex(spark, index.path)
    real, ran = CommitLog.commit, []

    def late(self, value, read, check, tries=1000):
        if value["kind"] == "merge" and not ran:
            ran.append(1)
            other.delete(base.where("vec_id in (5, 205)").select("vec_id"))
            other.insert(base.where("vec_id in (6, 300)").withColumn("label", F.lit(-6)))
            other.merge()
        return real(self, value, read, check, tries)

    CommitLog.commit = late
    try:
        with pytest.raises(Conflict):
            index.merge()
    finally:
        CommitLog.commit = real
    want = sorted({*range(240), 300} - {5, 205})
    assert ids(index.rows()) == want and {r.vec_id for r in index.rows().where("label = -6").collect()} == {6, 300}
    ran.clear()
    done = []

    def beside(self, value, read, check, tries=1000):
        if value["kind"] == "merge" and not ran:
            ran.append(1)
            done.append(other.delete(base.where("vec_id = 7").select("vec_id")))
            other.insert(base.where("vec_id = 8").withColumn("label", F.lit(-8)))
        return real(self, value, read, check, tries)

    CommitLog.commit = beside
    try:
        assert index.merge(whole=True) is not None
    finally:
        CommitLog.commit = real
    assert ids(index.rows()) == sorted(set(want) - {7}) and ids(index.rows().where("label = -8")) == [8]


def test_writers_at_once(spark, base, index):
    """Two threads insert and one deletes beside one that merges; what is visible is the log replayed."""
    steps, failed = {}, []

    def write(kind, picks):
        try:
            for where in picks:
                part = base.where(where)
                done = index.insert(part.withColumn("label", F.lit(len(where)))) if kind == "insert" else index.delete(part.select("vec_id"))
                steps[done] = (kind, ids(part), len(where))
        except BaseException as e:  # noqa: BLE001 - reported by the test
            failed.append(e)

    def merge():
        try:
            for whole in (False, True, False):
                index.merge(whole)
        except BaseException as e:  # noqa: BLE001 - reported by the test
            failed.append(e)

    threads = [
        threading.Thread(target=write, args=("insert", ["vec_id between 180 and 260", "vec_id % 9 = 1", "vec_id between 300 and 310"])),
        threading.Thread(target=write, args=("insert", ["vec_id between 250 and 320 ", "vec_id % 7 = 2  "])),
        threading.Thread(target=write, args=("delete", ["vec_id % 5 = 0", "vec_id between 190 and 255", "vec_id % 9 = 1"])),
        threading.Thread(target=merge),
    ]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert failed == [] and len(steps) == 8
    state = {i: None for i in range(200)}
    for _, (kind, some, label) in sorted(steps.items()):
        for i in some:
            state.pop(i, None)
            if kind == "insert":
                state[i] = label
    got = {r.vec_id: r.label for r in index.rows().collect()}
    assert set(got) == set(state) and all(label is None or got[i] == label for i, label in state.items())


def test_log(spark, tmp_path):
    """One commit a number, snapshots, and states of earlier commits."""
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.version() == -1 and log.state(lambda s, c, v: s, {"n": []}) == (-1, {"n": []})

    def fold(state, commit, version):
        return {"n": [*state["n"], commit["x"]]}

    def append(start):
        for i in range(12):
            log.commit({"x": start + i}, log.version(), lambda _: None)

    threads = [threading.Thread(target=append, args=(100 * t,)) for t in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    version, state = log.state(fold, {"n": []})
    assert version == 47 and sorted(state["n"]) == sorted(100 * t + i for t in range(4) for i in range(12))
    assert any(p.name.startswith("s") for p in (tmp_path / "log").iterdir()) and not any(p.name.endswith(".tmp") for p in (tmp_path / "log").iterdir())
    assert log.state(fold, {"n": []}) == (version, state) and log.state(fold, {"n": []}, 10)[1]["n"] == state["n"][:11]
    assert not log._put(f"{5:020d}", {"x": 0})


def test_store_survives_a_crashed_merge(spark, base):
    """What a merge that was cut off leaves behind doesn't stop later ones, and one listing is one moment."""
    store = maintain.VectorStore(spark, work_dir(spark, "store")).create(base.where("vec_id < 50"))
    crashed = spark._jvm.org.apache.hadoop.fs.Path(f"{store.path}/v1/base/_temporary/0")
    crashed.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(crashed)
    store.insert(base.where("vec_id between 50 and 59"))
    store.merge()
    assert ids(store.eager_delete(base.where("vec_id in (3, 99)").select("vec_id")).withColumnRenamed("tag", "vec_id")) == [99]
    assert ids(store.rows()) == [i for i in range(60) if i != 3]
    listings, real = [], maintain.VectorStore._parts
    store_type = type(store)

    def once(self, folder=None):
        found = real(self, folder)
        listings.append(found)
        return found

    store_type._parts = once
    try:
        store.rows()
    finally:
        store_type._parts = real
    assert len(listings) == 1
