"""Registered queries that write each format and read it back, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecspan.functions import distance, vectors
from vecspan.operators import ivf, levels, maintain
from vecspan.operators.topk import exact_knn
from vecspan.session import work_dir
from vecspan.sources import formats, text
from vecspan.sources.catalog import Catalog

from .catalogue import _ASSIGN, _BASE, _C, _CT, _FOUND, _LAYOUT, _PROBE, _Q, _TRUTH, DIM, K, NLIST, NPROBE, _knn_sql, _long, _with, asked, assigned, base, query, trained


def _hundred(v: Column) -> Column:
    return vectors.cast_int(F.transform(distance.doubles(v), lambda x: x * F.lit(100.0)))


def _bytes(v: Column) -> Column:
    return vectors.wrap_uint8(F.transform(distance.doubles(v), lambda x: (x * F.lit(100.0)).cast("bigint")))


_FLOAT = (lambda v: v, "embedding::DOUBLE[]", "array<double>")
_INT = (_hundred, "list_transform(embedding::DOUBLE[], lambda x: trunc(x * 100.0::DOUBLE)::BIGINT)", "array<bigint>")
_BYTE = (_bytes, "list_transform(embedding::DOUBLE[], lambda x: (trunc(x * 100.0::DOUBLE)::BIGINT % 256 + 256) % 256)", "array<bigint>")
_SIGNED = (lambda v: vectors.quantize_int8(v, 0.0, 2.0), "list_transform(embedding::DOUBLE[], lambda x: greatest(least(trunc((x - 0.0::DOUBLE) * 128.0::DOUBLE), 127.0), -128.0)::BIGINT)", "array<bigint>")

#: What is written in each format: a function of the vector, its SQL, and the type it is compared in.
_WRITTEN = {"fvecs": _FLOAT, "fbin": _FLOAT, "ivecs": _INT, "ibin": _INT, "dat": _INT, "bvecs": _BYTE, "u8bin": _BYTE, "u32bin": _BYTE, "i8bin": _SIGNED}


def _round_trip(kind: str) -> None:
    values, sql, kind_of = _WRITTEN[kind]

    def run(spark, sf_dir):
        path = work_dir(spark, kind)
        formats.write_vectors(base(spark, sf_dir).select("vec_id", values(F.col("embedding")).alias("embedding")), path, kind)
        back = formats.read_vectors(spark, path, kind, **({"dim": DIM} if kind == "dat" else {}))
        return vectors.long_form(back, "vec_id", F.col("embedding").cast(kind_of))

    run.__name__ = f"file_{kind}"
    run.__doc__ = f"The vectors written as {kind} and read back."
    query(_long(sql))(run)


for _kind in _WRITTEN:
    _round_trip(_kind)


@query(_long("embedding::DOUBLE[]", "(SELECT * FROM embeddings WHERE vec_id >= 40 AND vec_id < 60)"))
def file_range(spark, sf_dir):
    """Rows of a vector file by a filter of their numbers, which the file's reader takes."""
    path = work_dir(spark, "range")
    formats.write_vectors(base(spark, sf_dir), path, "fvecs")
    rows = vectors.row_slice(formats.read_vectors(spark, path, "fvecs", rows_per_split=16), 40, 20)
    return vectors.long_form(rows, "vec_id", distance.doubles(F.col("embedding")))


@query(_with(_BASE, _Q, _TRUTH) + f"SELECT qid // 100 AS qid, rank, vec_id, dist::FLOAT::DOUBLE AS dist, vec_id AS tag FROM truth WHERE rank <= {K}")
def file_truthset(spark, sf_dir):
    """The true neighbours written as a truthset and read back; its queries are numbered."""
    b = base(spark, sf_dir)
    path = work_dir(spark, "truth")
    formats.write_truthset(exact_knn(b, asked(b), K), path)
    return formats.register(spark).read.format("truthset").load(path).withColumn("dist", F.col("dist").cast("double"))


@query(_with(_BASE, _C, _ASSIGN) + "SELECT cluster_id, vec_id FROM assigned")
def file_lists(spark, sf_dir):
    """Inverted lists as lines of ids."""
    path = work_dir(spark, "lists")
    text.write_lists(ivf.inverted_lists(assigned(base(spark, sf_dir))), NLIST, path)
    return text.read_lists(spark, path)


@query(_with(_BASE, _C, _ASSIGN, _LAYOUT) + "SELECT nav + pos AS vec_id, l.vec_id AS old_id FROM laid l")
def file_index_map(spark, sf_dir):
    """The map from new places to old ids as a headerless matrix of one column."""
    path = work_dir(spark, "map")
    laid = ivf.layout(assigned(base(spark, sf_dir)))
    formats.write_vectors(laid.select(F.col("new_pos").alias("vec_id"), F.array("vec_id").alias("embedding")), path, "dat")
    back = formats.read_vectors(spark, path, "dat", dim=1)
    return back.select("vec_id", F.col("embedding")[0].cast("bigint").alias("old_id"))


@query(_long("embedding::DOUBLE[]"))
def file_tsv(spark, sf_dir):
    path = work_dir(spark, "tsv")
    text.write_tsv(base(spark, sf_dir), path, id_col="vec_id")
    return vectors.long_form(text.read_tsv(spark, path, DIM), "vec_id", distance.doubles(F.col("embedding")))


@query("SELECT vec_id::VARCHAR AS key, label::VARCHAR AS meta, (generate_subscripts(embedding, 1) - 1)::BIGINT AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings")
def file_keyed_vectors(spark, sf_dir):
    """Lines of a key, a remark and a vector."""
    path = work_dir(spark, "keyed")
    line = F.concat_ws("\t", F.col("vec_id").cast("string"), F.col("label").cast("string"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","))
    base(spark, sf_dir).select(line.alias("value")).write.text(path)
    return text.read_keyed_vectors(spark, path, DIM).select("key", "meta", F.posexplode(distance.doubles(F.col("embedding"))).alias("pos", "value")).withColumn("pos", F.col("pos").cast("bigint"))


@query("SELECT vec_id AS tag FROM embeddings WHERE vec_id % 10 = 3")
def file_tags(spark, sf_dir):
    path = work_dir(spark, "tags")
    text.write_tags(base(spark, sf_dir).where("vec_id % 10 = 3").select(F.col("vec_id").alias("tag")), path)
    return spark.read.text(path).select(F.col("value").cast("bigint").alias("tag"))


@query("SELECT vec_id AS place, vec_id AS id, label * 2 AS twice FROM embeddings")
def file_csv_rows(spark, sf_dir):
    """A CSV document's rows by their place, after a change to a column."""
    path = work_dir(spark, "csv")
    rows = base(spark, sf_dir).select(F.col("vec_id").alias("id"), "label")
    rows.repartitionByRange(3, "id").sortWithinPartitions("id").write.option("header", True).csv(path)
    doc = text.CsvDocument.load(spark, path, schema="id bigint, label int")
    doc = doc.set_column("twice", F.col("label") * 2).remove_column("label")
    return doc.df.select(F.col(doc.key).alias("place"), "id", "twice")


def _trace(b):
    """Two batches: ids ending in 7 come and those ending in 8 go; then half of each the other way round."""
    last = b.agg(F.max("vec_id")).first()[0]
    sevens = b.where(f"vec_id % 10 = 7 AND vec_id < {last}").select("vec_id")
    rows = None
    for batch, op, shift, where in ((0, "insert", 0, "true"), (0, "delete", 1, "true"), (1, "delete", 0, "vec_id % 20 = 7"), (1, "insert", 1, "vec_id % 20 = 7")):
        one = sevens.where(where).select(F.lit(batch).cast("bigint").alias("batch"), F.lit(op).alias("op"), (F.col("vec_id") + shift).alias("tag"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


_TRACED = "FROM embeddings WHERE vec_id % 10 NOT IN (7, 8) OR vec_id % 20 = 8 OR (vec_id % 20 = 17 AND vec_id < (SELECT max(vec_id) FROM embeddings))"


@query("""WITH s AS (SELECT vec_id FROM embeddings WHERE vec_id % 10 = 7 AND vec_id < (SELECT max(vec_id) FROM embeddings))
SELECT 0::BIGINT AS batch, 'insert' AS op, vec_id AS tag FROM s UNION ALL SELECT 0, 'delete', vec_id + 1 FROM s
UNION ALL SELECT 1, 'delete', vec_id FROM s WHERE vec_id % 20 = 7 UNION ALL SELECT 1, 'insert', vec_id + 1 FROM s WHERE vec_id % 20 = 7""")
def file_trace(spark, sf_dir):
    path = work_dir(spark, "trace")
    formats.write_trace(_trace(base(spark, sf_dir)), path)
    return formats.register(spark).read.format("trace").load(path)


@query(f"SELECT vec_id, label {_TRACED}")
def stream_trace_state(spark, sf_dir):
    """Both batches of a trace streamed into a store in one go; what is visible then."""
    from vecspan.streaming.ingest import ingest

    b = base(spark, sf_dir)
    store = maintain.VectorStore(spark, work_dir(spark, "store")).create(b.where("vec_id % 10 <> 7"))
    path = work_dir(spark, "trace")
    formats.write_trace(_trace(b), path)
    stream = formats.register(spark).readStream.format("trace").load(path)
    ingest(stream, store, work_dir(spark, "offsets"), b).awaitTermination()
    return store.rows().select("vec_id", "label")


@query(_knn_sql("l2_sq"))
def ivf_saved_search(spark, sf_dir):
    """An index saved and loaded, with all its lists probed."""
    b = base(spark, sf_dir)
    path = work_dir(spark, "index")
    ivf.IvfIndex.build(b, NLIST, 2).save(path)
    return ivf.IvfIndex.load(spark, path).search(asked(b), K, NLIST)


@query(_knn_sql("l2_sq", "label < 5"))
def collection_search(spark, sf_dir):
    """A collection filled in two batches, flushed, indexed and loaded; all lists are probed, rows are filtered."""
    b = base(spark, sf_dir)
    c = Catalog(spark, work_dir(spark, "catalog")).create("one", "vec_id", "embedding", DIM)
    c.insert(b.where("vec_id % 2 = 0"))
    c.insert(b.where("vec_id % 2 = 1"))
    c.flush()
    c.create_index(NLIST, 2)
    return c.search(asked(b), K, nprobe=NLIST, expr="label < 5")


_LIVE = """live AS (SELECT vec_id, CASE WHEN vec_id % 20 = 13 THEN list_transform(e, lambda x: -x) ELSE e END AS e, label FROM base WHERE vec_id % 10 <> 3 OR vec_id % 20 = 13)"""


def _levelled(spark, b):
    """A base without ids ending in 7; those come in two inserts, ids ending in 3 go, half of them come back negated; merges in between."""
    flipped = b.where("vec_id % 20 = 13").withColumn("embedding", F.transform("embedding", lambda x: -x))
    index = levels.LevelledIndex(spark, work_dir(spark, "levels")).create(b.where("vec_id % 10 <> 7"), centroids=trained(b))
    index.insert(b.where("vec_id % 20 = 7"))
    index.insert(b.where("vec_id % 20 = 17"))
    index.merge()
    index.delete(b.where("vec_id % 10 = 3").select("vec_id"))
    index.insert(flipped)
    return index


@query(_with(_BASE, _Q, _CT, _LIVE, _ASSIGN.replace("FROM base, c", "FROM live, c"), _PROBE, _FOUND) + f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank, vec_id, dist FROM found WHERE probe_rank <= {NPROBE} QUALIFY rank <= {K}")
def search_base_and_delta(spark, sf_dir):
    """Inverted lists in levels under a commit log: base, merged and fresh inserts, deletes; searched by nprobe."""
    b = base(spark, sf_dir)
    return _levelled(spark, b).search(asked(b), K, NPROBE)


@query(_with(_BASE, _LIVE) + "SELECT vec_id, label, list_sum(e) AS total FROM live")
def levels_after_merge(spark, sf_dir):
    """The same index with all levels merged into a new base."""
    index = _levelled(spark, base(spark, sf_dir))
    index.merge(whole=True)
    return index.rows().select("vec_id", "label", F.aggregate(distance.doubles(F.col("embedding")), F.lit(0.0), lambda s, x: s + x).alias("total"))



@query(_knn_sql("l2_sq", "label < 8"))
def collection_after_index(spark, sf_dir):
    """Rows inserted after the index was made, some of them flushed, some not."""
    b = base(spark, sf_dir)
    c = Catalog(spark, work_dir(spark, "catalog")).create("late", "vec_id", "embedding", DIM)
    c.insert(b.where("vec_id % 4 = 0"))
    c.create_index(NLIST, 2)
    c.insert(b.where("vec_id % 4 = 1"))
    c.flush()
    c.insert(b.where("vec_id % 4 > 1"))
    return c.search(asked(b), K, nprobe=NLIST, expr="label < 8")


@query("""WITH t AS (SELECT max(CASE WHEN vec_id % 10 = 3 THEN vec_id + 5 ELSE vec_id END) AS now FROM embeddings)
SELECT vec_id AS id FROM embeddings, t WHERE vec_id % 10 <> 3 AND vec_id + 100 > now""")
def stream_expiry(spark, sf_dir):
    """A row a second is inserted and lives for 100 seconds of the stream's clock; those ending in 3 are deleted after five: what is visible at the end."""
    from vecspan.streaming import expiry

    b, feed, out = base(spark, sf_dir), work_dir(spark, "feed"), work_dir(spark, "events")
    second = F.col("vec_id").cast("bigint")
    ops = b.select(F.col("vec_id").alias("tag"), F.lit("insert").alias("op"), F.timestamp_seconds(second).alias("ts"))
    ops = ops.unionByName(b.where("vec_id % 10 = 3").select(F.col("vec_id").alias("tag"), F.lit("delete").alias("op"), F.timestamp_seconds(second + 5).alias("ts")))
    ops.write.parquet(feed)
    stream = spark.readStream.schema(ops.schema).parquet(feed)
    expiry.keep_visible(expiry.with_expiry(stream, 100), out, work_dir(spark, "offsets")).awaitTermination()
    return expiry.visible_ids(spark.read.schema("id bigint, op string, at bigint").parquet(out)).select("id")


@query(_with(_BASE, _Q, _CT, "live AS (SELECT * FROM base WHERE vec_id % 10 <> 3)", _ASSIGN.replace("FROM base, c", "FROM live, c"), _PROBE, _FOUND) + f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank, vec_id, dist FROM found WHERE probe_rank <= {NPROBE} QUALIFY rank <= {K}")
def search_after_writers(spark, sf_dir):
    """Two threads insert and one deletes while this one merges and another searches; a search of what they leave."""
    import threading

    b = base(spark, sf_dir)
    index = levels.LevelledIndex(spark, work_dir(spark, "levels")).create(b.where("vec_id % 10 < 5"), centroids=trained(b))
    failed: list[BaseException] = []

    def steps(run, *parts: str) -> threading.Thread:
        def each() -> None:
            try:
                for where in parts:
                    run(b.where(where))
            except BaseException as e:  # noqa: BLE001 - raised below, in the caller's thread
                failed.append(e)

        return threading.Thread(target=each)

    writers = [
        steps(index.insert, "vec_id % 10 = 5", "vec_id % 10 = 6"),
        steps(index.insert, "vec_id % 10 = 7", "vec_id % 10 IN (8, 9)"),
        steps(lambda rows: index.delete(rows.select("vec_id")), "vec_id % 20 = 3", "vec_id % 20 = 13"),
    ]
    for w in writers:
        w.start()
    maintain.update_while_searching(index, asked(b), K, [("insert", b.where("vec_id % 10 = 4"))], nprobe=NPROBE)
    for w in writers:
        w.join()
    if failed:
        raise failed[0]
    index.merge(whole=True)
    return index.search(asked(b), K, NPROBE)
