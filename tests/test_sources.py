"""Round trips of the vector formats, text formats, collections and streams."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspan.sources import formats, text
from vecspan.operators.topk import exact_knn
from vecspan.sources.catalog import Catalog
from vecspan.sources.commits import Conflict
from vecspan.sources.datasets import Dataset, Registry


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(i, [float(i), float(i * 2 % 7), 1.0]) for i in range(50)], "vec_id bigint, embedding array<float>")


def rows(df):
    return sorted((r.vec_id, tuple(r.embedding)) for r in df.collect())


@pytest.mark.parametrize("kind", ["fvecs", "ivecs", "bvecs", "fbin", "ibin", "u8bin", "i8bin", "u32bin"])
def test_round_trip(spark, base, tmp_path, kind):
    formats.write_vectors(base, str(tmp_path / "v"), kind, shards=3)
    back = formats.read_vectors(spark, str(tmp_path / "v"), kind, rows_per_split=7)
    assert rows(back) == rows(base)
    part = formats.read_vectors(spark, str(tmp_path / "v"), kind, start=10, count=5)
    assert [i for i, _ in rows(part)] == [10, 11, 12, 13, 14]


def test_layouts(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(4, 3)
    with open(tmp_path / "a.fvecs", "wb") as f:
        for r in x:
            f.write(struct.pack("<i", 3) + r.tobytes())
    with open(tmp_path / "b.fbin", "wb") as f:
        f.write(struct.pack("<ii", 4, 3) + x.tobytes())
    with open(tmp_path / "c.dat", "wb") as f:
        f.write(x.astype("<i4").tobytes())
    want = [(i, tuple(map(float, r))) for i, r in enumerate(x)]
    for name, more in (("a.fvecs", {}), ("b.fbin", {}), ("c.dat", {"dim": 3})):
        assert rows(formats.read_vectors(spark, str(tmp_path / name), **more)) == want
    reg = Registry(str(tmp_path)).add("x", Dataset("a.fvecs", "b.fbin", rows=2))
    assert reg.load(spark, "x").count() == 2 and reg.load(spark, "x", "queries", as_int=True).count() == 4
    with pytest.raises(KeyError):
        reg.load(spark, "y")


def test_truth_and_trace(spark, tmp_path):
    truth = spark.createDataFrame([(q, r, 10 * q + r, float(r)) for q in range(3) for r in (1, 2)], "qid bigint, rank bigint, vec_id bigint, dist double")
    formats.write_truthset(truth, str(tmp_path / "t"))
    back = formats.register(spark).read.format("truthset").load(str(tmp_path / "t"))
    assert sorted((r.qid, r.rank, r.vec_id, float(r.dist), r.tag) for r in back.collect()) == [(q, r, 10 * q + r, float(r), 10 * q + r) for q in range(3) for r in (1, 2)]
    (tmp_path / "ops").mkdir()
    np.array([2, 5, 6, 7, 8], "<u4").tofile(tmp_path / "ops" / "0.bin")
    ops = spark.read.format("trace").load(str(tmp_path / "ops")).collect()
    assert [(r.op, r.tag) for r in ops] == [("delete", 5), ("delete", 6), ("insert", 7), ("insert", 8)]


def test_text(spark, base, tmp_path):
    lists = spark.createDataFrame([(0, "1,2"), (2, "3")], "cluster_id bigint, ids string")
    text.write_lists(lists, 4, str(tmp_path / "l"))
    assert sorted(map(tuple, text.read_lists(spark, str(tmp_path / "l")).collect())) == [(0, 1), (0, 2), (2, 3)]
    text.write_tsv(base, str(tmp_path / "v"))
    assert text.read_tsv(spark, str(tmp_path / "v"), 3).count() == 50
    with pytest.raises(Exception, match="expected 4"):
        text.read_tsv(spark, str(tmp_path / "v"), 4).collect()
    (tmp_path / "k.txt").write_text("a\tm\t1,2\nb\t3,4\n5,6\n")
    got = [(r.key, r.meta, r.embedding) for r in text.read_keyed_vectors(spark, str(tmp_path / "k.txt"), 2).collect()]
    assert got == [("a", "m", [1.0, 2.0]), ("b", None, [3.0, 4.0]), (None, None, [5.0, 6.0])]
    text.append_log(spark, str(tmp_path / "log"), [("d", 1, "ivf", "cpu", 2.0, 500.0, 1.0, 1.0, 1.0, 3.0)])
    text.append_log(spark, str(tmp_path / "log"), [("d", 2, "ivf", "cpu", 2.0, 500.0, 1.0, 1.0, 1.0, 3.0)])
    doc = text.CsvDocument.load(spark, str(tmp_path / "log"))
    assert doc.df.count() == 2 and doc.names == list(text.LOG_COLUMNS)


def test_csv_document(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a,b\n1,x\n2,y\n")
    doc = text.CsvDocument.load(spark, str(tmp_path / "d.csv"))
    assert doc.cell("b", 1) == "y" and doc.row(0).first().a == "1"
    changed = doc.set_cell("b", 1, "z").remove_row(0).set_column("c", F.lit(5))
    assert [tuple(r) for r in changed.df.select(*changed.names).collect()] == [("2", "z", 5)]
    assert doc.remove_column("a").names == ["b"] and doc.append(doc).df.count() == 4
    assert doc.append(doc).cell("b", 3) == "y" and doc.remove_row(0).cell("b", 0) == "y"
    more = doc.insert_row(1, ("9", "new")).insert_column(1, "c", F.lit(1))
    assert more.names == ["a", "c", "b"] and [more.cell("b", i) for i in range(3)] == ["x", "new", "y"]


def test_rows_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a\n" + "".join(f"{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        doc = text.CsvDocument.load(spark, str(tmp_path / "n.csv"))
        assert doc.df.rdd.getNumPartitions() > 3
        assert [doc.cell("a", i) for i in (0, 1700, 4999)] == ["0", "1700", "4999"]
        (tmp_path / "lists.csv").write_text("".join(f"{i}\n" if i % 3 else "\n" for i in range(3000)))
        got = text.read_lists(spark, str(tmp_path / "lists.csv")).collect()
        assert sorted((r.cluster_id, r.vec_id) for r in got) == [(i, i) for i in range(3000) if i % 3]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_ranges_are_pushed_down(spark, base, tmp_path):
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    formats.write_vectors(base, str(tmp_path / "v"), "fvecs", shards=3)
    reader = formats._VectorReader("fvecs", {"path": str(tmp_path / "v"), "rows_per_split": "5"})
    left = list(reader.pushFilters([GreaterThanOrEqual(("vec_id",), 12), LessThan(("vec_id",), 17)]))
    assert len(left) == 2 and [(s.ordinal, s.rows) for s in reader.partitions()] in ([(12, 5)], [(12, 3), (15, 2)], [(12, 4), (16, 1)], [(12, 2), (14, 3)], [(12, 1), (13, 4)])
    back = formats.read_vectors(spark, str(tmp_path / "v"), "fvecs").where("vec_id >= 12 and vec_id < 17 and vec_id <> 14")
    assert [i for i, _ in rows(back)] == [12, 13, 15, 16]


def test_matrices_inside_a_file(spark, base, tmp_path):
    path = str(tmp_path / "m.fbin")
    n = formats.save_matrix(base, path)
    formats.save_matrix(base.where("vec_id < 5"), path, offset=n)
    assert rows(formats.read_vectors(spark, path)) == rows(base)
    assert rows(formats.read_vectors(spark, path, offset=n)) == rows(base.where("vec_id < 5"))
    res = spark.createDataFrame([(0, 1, 7, 0.5), (0, 2, 8, 1.5), (3, 1, 9, 2.5)], "qid bigint, rank bigint, vec_id bigint, dist double")
    formats.write_result_matrix(res, str(tmp_path / "r"), 2, files=1)
    (part,) = (tmp_path / "r").glob("part-*.bin")
    raw = part.read_bytes()
    assert struct.unpack("<iiIfIfIfIf", raw)[:8] == (2, 2, 7, 0.5, 8, 1.5, 9, 2.5)


def test_trace_stream(spark, tmp_path):
    """Files that come later are later batches; a micro-batch that holds several ends as the last one leaves it."""
    from vecspan.operators.maintain import VectorStore
    from vecspan.streaming.ingest import apply_batch, ingest

    base = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "vec_id bigint, embedding array<float>")
    store = VectorStore(spark, str(tmp_path / "s")).create(base.where("vec_id < 5"))
    ops = spark.createDataFrame([(0, "insert", 7), (0, "delete", 1), (1, "delete", 7), (1, "insert", 1)], "batch bigint, op string, tag bigint")
    formats.write_trace(ops, str(tmp_path / "t"))
    stream = formats.register(spark).readStream.format("trace").load(str(tmp_path / "t"))
    ingest(stream, store, str(tmp_path / "o"), base).awaitTermination()
    assert sorted(r.vec_id for r in store.rows().collect()) == [0, 1, 2, 3, 4]
    np.array([1, 0, 9], "<u4").tofile(tmp_path / "t" / "batch-0000000002.bin")
    ingest(stream, store, str(tmp_path / "o"), base).awaitTermination()
    assert sorted(r.vec_id for r in store.rows().collect()) == [1, 2, 3, 4, 9]
    apply_batch(store, spark.createDataFrame([(0, "insert", 3), (1, "delete", 3)], "batch bigint, op string, tag bigint"), base)
    assert sorted(r.vec_id for r in store.rows().collect()) == [1, 2, 4, 9]
    with pytest.raises(ValueError, match="deletes"):
        formats.write_trace(ops.where("op = 'insert'"), str(tmp_path / "x"))


def test_collections(spark, base, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"))
    c = cat.create("one", "vec_id", "embedding", 3)
    assert cat.list() == ["one"] and c.count() == 0
    with pytest.raises(ValueError):
        cat.create("one", "vec_id", "embedding", 3)
    c.insert(base.where("vec_id < 20"))
    c.insert(base.where("vec_id >= 20"))
    c = cat.get("one")
    c.create_index(4, 2)
    q = base.where("vec_id < 3").select(F.col("vec_id").alias("qid"), "embedding")
    assert sorted(map(tuple, c.search(q, 3, nprobe=4).collect())) == sorted(map(tuple, c.search(q, 3).collect()))
    assert c.search(q, 3, expr="vec_id >= 40").agg(F.min("vec_id")).first()[0] >= 40
    with pytest.raises(Exception, match="not a vector"):
        c.insert(spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<float>"))
    want = sorted(map(tuple, c.search(q, 3).collect()))
    assert c.flush() == 50 and sorted(map(tuple, c.load().search(q, 3, nprobe=4).collect())) == want
    c.drop_index()
    assert not c.has_index() and sorted(map(tuple, c.load().search(q, 3).collect())) == want
    c.release()
    with pytest.raises(KeyError):
        c.search(q, 3, nprobe=4)
    cat.drop("one")
    assert not cat.has("one")


def test_collections_after_the_index(spark, base, tmp_path):
    """Rows that came after the index are found, those whose time ran out aren't, by any search; flushes keep both."""
    import time

    c = Catalog(spark, str(tmp_path / "cat")).create("late", "vec_id", "embedding", 3)
    q = base.where("vec_id % 7 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    c.insert(base.where("vec_id < 25"))
    c.create_index(4, 2)
    c.insert(base.where("vec_id >= 25"))
    want = sorted(map(tuple, exact_knn(base, q, 5).collect()))
    for step in ("new", "loaded", "flushed", "later"):
        if step == "loaded":
            c.load()
        if step == "flushed":
            assert c.flush() == 50
        if step == "later":
            c.insert(base.where("vec_id = 3").withColumn("vec_id", F.lit(1000).cast("bigint")))
            want = sorted(map(tuple, exact_knn(c.rows(), q, 5).collect()))
        assert sorted(map(tuple, c.search(q, 5, nprobe=4).collect())) == want
        assert sorted(map(tuple, c.search(q, 5).collect())) == want
    assert {r.vec_id for r in c.search(q, 50, nprobe=4, expr="vec_id >= 20").collect()} == {*range(20, 50), 1000}
    other = Catalog(spark, str(tmp_path / "cat")).create("short", "vec_id", "embedding", 3, ttl_seconds=6)
    other.insert(base.where("vec_id < 10"))
    other.create_index(2, 1)
    time.sleep(7)
    other.insert(base.where("vec_id between 10 and 12"))
    for found in (other.search(q, 5, nprobe=2), other.search(q, 5)):
        assert {r.vec_id for r in found.collect()} <= {10, 11, 12}
    read, state = other._state()
    real, other.spark = other._read, spark

    def meanwhile(folders):
        rows = real(folders)
        if len(folders) == len(state["folders"]):
            Catalog(spark, str(tmp_path / "cat")).get("short").drop_index()
        return rows

    other._read = meanwhile
    with pytest.raises(Conflict):
        other.create_index(2, 1)


def test_event_windows(spark, tmp_path):
    from vecspan.streaming.ingest import event_windows

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.write.parquet(str(tmp_path / "ev"))
    stream = event_windows(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")))
    q = stream.writeStream.format("memory").queryName("ev_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("ev_out").agg(F.sum("n")).first()[0] == ev.count()


def test_many_files(spark, base, tmp_path):
    """A hundred files of one format are one table, numbered in order; each read task opens its own file."""
    path = str(tmp_path / "many")
    rows = base.select("vec_id", "embedding").crossJoin(spark.range(40)).select((F.col("vec_id") * 40 + F.col("id")).alias("vec_id"), "embedding")
    formats.write_vectors(rows, path, "fbin", shards=100)
    assert len(list((tmp_path / "many").glob("part-*"))) > 90
    back = formats.read_vectors(spark, path, "fbin")
    assert back.count() == rows.count() and back.join(rows, "vec_id").where(back.embedding != rows.embedding).isEmpty()
