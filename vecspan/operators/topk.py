"""Exact search and top-k."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspan.functions import distance
from vecspan.session import importable

#: Queries whose vectors are sent to every task at once; more are searched block by block.
QUERY_BLOCK = 4096
#: Blocks of queries that pass through the driver; beyond, queries and base are joined block by block.
MOST_BLOCKS = 16
#: Base rows that a task of the block join holds, and queries that pass it.
BASE_BLOCK, QUERY_CELL = 65_536, 32_768


def top_by(df: DataFrame, by: list[str], k: int, order: list[str], rank: str = "rank") -> DataFrame:
    """The first k rows of each group. Directly above the window, so that partial limits apply."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).where(F.col(rank) <= k)


def merge_topk(parts: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """The k nearest of each query from candidates (qid, id, dist) of any number of parts."""
    return top_by(parts, ["qid"], k, ["dist", id_col]).select("qid", "rank", id_col, "dist")


def pairs(base: DataFrame, queries: DataFrame, metric: str = "l2_sq", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Every (query, base row) with its distance, as a declarative plan of compiled sums over columns; queries are broadcast in blocks of about QUERY_BLOCK."""
    distance.metric(metric)
    b = base.where(distance.finite(F.col(vec_col))).select(F.col(id_col), F.col(vec_col).alias("v"))
    q = queries.where(distance.finite(F.col(vec_col))).select("qid", F.col(vec_col).alias("q"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for dim in _lengths(q):
        d = distance.totals(metric, [F.col(f"q{i}") for i in range(dim)], [F.col(f"v{i}") for i in range(dim)])
        left, asked = _wide(b, id_col, "v", dim, "double"), _wide(q, "qid", "q", dim, "double")
        for i in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i) if blocks > 1 else asked
            found = left.crossJoin(F.broadcast(part)).select("qid", id_col, d.alias("dist")).where("dist is not null")
            out = found if out is None else out.unionByName(found)
    return out if out is not None else b.crossJoin(q).select("qid", id_col, F.lit(None).cast("double").alias("dist")).limit(0)


def _lengths(queries: DataFrame) -> list[int]:
    """The lengths of the vectors q."""
    return sorted(r[0] for r in queries.select(F.size("q")).distinct().collect())


def _wide(df: DataFrame, id_: str, name: str, dim: int, kind: str) -> DataFrame:
    """The rows with ``dim`` components as columns. Components are there; coalesce tells the plan so."""
    cells = [F.coalesce(F.col(name)[i].cast(kind), F.lit(0).cast(kind)).alias(f"{name}{i}") for i in range(dim)]
    return df.where(F.size(name) == dim).select(id_, *cells)


def knn_by_columns(base: DataFrame, queries: DataFrame, k: int, total, kind: str = "double", id_col: str = "vec_id") -> DataFrame:
    """(qid, id, dist) of pairs that hold the k nearest of each query, as a declarative plan.

    ``base`` has the id and v, ``queries`` qid and q: arrays without nulls, compared where they have
    the same length. ``total`` makes the distance from two lists of columns of type ``kind``. The
    k-th distance to a sample of about sqrt(k * n) rows bounds a query's k nearest, so that only
    pairs within it leave the join and are sorted. Queries are broadcast in blocks of about QUERY_BLOCK.
    """
    n, asked = base.count(), queries.count()
    blocks, one_in = max(1, -(-asked // QUERY_BLOCK)), max(1, int((n / k) ** 0.5))
    out = None
    for dim in _lengths(queries):
        d = total([F.col(f"q{i}") for i in range(dim)], [F.col(f"v{i}") for i in range(dim)])
        b, q = _wide(base, id_col, "v", dim, kind), _wide(queries, "qid", "q", dim, kind)
        some = b.where(F.pmod(F.xxhash64(F.lit(7), id_col), F.lit(one_in)) == 0)
        for i in range(blocks):
            part = q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i) if blocks > 1 else q
            first = some.crossJoin(F.broadcast(part)).select("qid", id_col, d.alias("dist")).where("dist is not null")
            bound = top_by(first, ["qid"], k, ["dist", id_col]).where(F.col("rank") == k).groupBy("qid").agg(F.max("dist").alias("bound"))
            within = part.join(bound, "qid", "left")
            found = b.crossJoin(F.broadcast(within)).where(F.col("bound").isNull() | (d <= F.col("bound"))).select("qid", id_col, d.alias("dist")).where("dist is not null")
            out = found if out is None else out.unionByName(found)
    return out if out is not None else base.crossJoin(queries).select("qid", id_col, F.lit(None).cast(kind).alias("dist")).limit(0)


def exact_knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2_sq", where: Column | str | None = None, method: str = "arrow", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Exact nearest neighbours: qid, rank, id, dist; min(k, n) rows a query, ordered by (dist, id).

    ``queries`` has qid and the vector column. ``where`` filters the base before the search.
    "arrow" scans batches of base vectors with a matrix product and passes on the k best of each
    batch; queries come in blocks of QUERY_BLOCK, each of which is broadcast; more than MOST_BLOCKS
    blocks are searched by ``block_join`` instead. "sql" is the same as a broadcast join over
    built-in functions (``knn_by_columns``). Null vectors and those with a component that is null or not finite are
    skipped, on either side.
    """
    distance.metric(metric)
    base = base.where(where) if where is not None else base
    base = base.where(F.col(vec_col).isNotNull())
    queries = queries.where(F.col(vec_col).isNotNull())
    if method == "sql":
        b = base.where(distance.finite(F.col(vec_col))).select(id_col, distance.doubles(F.col(vec_col)).alias("v"))
        q = queries.where(distance.finite(F.col(vec_col))).select("qid", distance.doubles(F.col(vec_col)).alias("q"))
        return merge_topk(knn_by_columns(b, q, k, lambda x, y: distance.totals(metric, x, y), id_col=id_col), k, id_col)
    if method != "arrow":
        raise ValueError(f"unknown method {method!r}")
    rows = base.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"))
    if queries.limit(MOST_BLOCKS * QUERY_BLOCK + 1).count() > MOST_BLOCKS * QUERY_BLOCK:
        found = block_join(rows, queries.select(F.col("qid").cast("bigint").alias("qid"), F.col(vec_col).alias("v")), k, metric)
        return merge_topk(found.withColumnRenamed("id", id_col), k, id_col)
    found = None
    block: list = []
    source = queries.select(F.col("qid").cast("bigint").alias("qid"), F.col(vec_col).alias("v")).toLocalIterator()
    for row in source:
        block.append(row)
        if len(block) == QUERY_BLOCK:
            part = _scan(rows, block, k, metric)
            found = part if found is None else found.unionByName(part)
            block = []
    if block or found is None:
        part = _scan(rows, block, k, metric)
        found = part if found is None else found.unionByName(part)
    return merge_topk(found.withColumnRenamed("id", id_col), k, id_col)


def block_join(rows: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """(qid, id, dist): of each block of base rows the k nearest of every query, for any number of queries.

    Base rows (id, v) are dealt by hash into blocks of about BASE_BLOCK rows, and queries (qid, v)
    into blocks of about QUERY_CELL. A pair of blocks is a task's work, and no task has two; the queries stream past the
    rows in it. Nothing passes through the driver; what moves is each side once a block of the other.
    """
    import numpy as np
    import pyarrow as pa

    importable(rows.sparkSession)
    both = paired_blocks(rows, queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vecspan.functions.distance import nearest

        held: list[tuple] = []
        ids = vec = at = None
        for batch in (b for b in batches if b.num_rows):
            key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                part, here = batch.slice(i, j - i), int(key[i])
                if here % 2 == 0:
                    held = held if at == here else []
                    held.append((part.column(2).to_numpy(), matrix(part.column(3))))
                    ids, at = None, here
                elif held and here == at + 1:
                    if ids is None:
                        ids, vec = (np.concatenate(x) for x in zip(*held, strict=True))
                        by = np.argsort(ids, kind="stable")
                        ids, vec = ids[by], vec[by]
                    q, d_ = part.column(2).to_numpy(), matrix(part.column(3))
                    x, y, d = nearest(d_, vec, k, metric)
                    yield pa.RecordBatch.from_arrays([pa.array(q[x]), pa.array(ids[y]), pa.array(d)], names=["qid", "id", "dist"])

    return both.mapInArrow(run, "qid bigint, id bigint, dist double")


def paired_blocks(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(block, side, id, v) of ``block_join``, block being the number of a pair of blocks and of its partition; base rows (side 0) come first."""
    blocks, cells = max(1, -(-rows.count() // BASE_BLOCK)), max(1, -(-queries.count() // QUERY_CELL))
    block, cell = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("qid"), F.lit(cells)).cast("int")
    base = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda c: block * cells + c)).alias("block"), F.lit(0).alias("side"), "id", "v")
    each = queries.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * cells + cell)).alias("block"), F.lit(1).alias("side"), F.col("qid").alias("id"), "v")
    return base.unionByName(each).repartitionById(blocks * cells, "block").sortWithinPartitions("block", "side")


def matrix(column):
    """(n, dim) doubles of an Arrow list column without nulls; all lists of one length."""
    import numpy as np
    import pyarrow as pa

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = len(column)
    if n and len(flat) % n:
        raise ValueError("vectors differ in length")
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _scan(rows: DataFrame, queries: list, k: int, metric: str) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    spark = importable(rows.sparkSession)
    ids = np.array([r.qid for r in queries], np.int64)
    q = np.array([r.v for r in queries], np.float64).reshape(len(queries), -1 if queries else 0)
    shared = spark.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vecspan.functions.distance import nearest

        qids, qs = shared.value
        bound = np.full(len(qids), np.inf)  # the least k-th distance of a batch so far
        for batch in batches:
            if not batch.num_rows or not len(qids):
                continue
            own = batch.column(0).to_numpy()
            by = np.argsort(own, kind="stable")
            own, vec = own[by], matrix(batch.column(1))[by]
            i, j, d = nearest(qs, vec, k, metric, bound=bound)
            last = np.arange(len(i)) - np.searchsorted(i, i) == k - 1
            bound[i[last]] = np.minimum(bound[i[last]], d[last])
            yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(own[j]), pa.array(d)], names=["qid", "id", "dist"])

    return rows.mapInArrow(run, "qid bigint, id bigint, dist double")


def held(refs: DataFrame, ref_id: str = "cluster_id", ref_vec: str = "centroid", most: int = 65_536):
    """(ids, matrix) of a small table in the order of its ids, after a check that it has at most ``most`` rows."""
    import numpy as np

    rows = refs.select(F.col(ref_id).cast("bigint").alias("r"), F.col(ref_vec).alias("v")).where("v is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the table to rank against has over {most} rows")
    rows.sort(key=lambda r: r.r)
    return np.array([r.r for r in rows], np.int64), np.array([r.v for r in rows], np.float64).reshape(len(rows), -1 if rows else 0)


def rank_small(df: DataFrame, refs: DataFrame, k: int, metric: str = "l2_sq", id_col: str = "vec_id", vec_col: str = "embedding", ref_id: str = "cluster_id", ref_vec: str = "centroid", most: int = 65_536, keep: list[str] | None = None) -> DataFrame:
    """The k nearest of a small table for each row: ``keep`` (the id), ``ref_id``, rank, dist. Map-only.

    ``refs``, such as centroids, is broadcast after a check that it has at most ``most`` rows.
    """
    import numpy as np
    import pyarrow as pa

    keep = keep or [id_col]
    spark = importable(df.sparkSession)
    shared = spark.sparkContext.broadcast(held(refs, ref_id, ref_vec, most))
    fields = [df.schema[c] for c in keep]
    rows = df.where(F.col(vec_col).isNotNull()).select(*keep, F.col(vec_col).alias("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vecspan.functions.distance import nearest

        ids, refs_ = shared.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            i, j, d = nearest(matrix(batch.column(len(keep))), refs_, k, metric)
            place = np.arange(len(i)) - np.searchsorted(i, i) + 1
            took = batch.select(list(range(len(keep)))).take(pa.array(i))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(ids[j]), pa.array(place.astype(np.int64)), pa.array(d)], names=[*keep, ref_id, "rank", "dist"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{ref_id}` bigint, rank bigint, dist double"])
    return rows.mapInArrow(run, schema)


def k_sweep(results: DataFrame, most: int) -> DataFrame:
    """Results of the largest k cut to each power of two: adds k."""
    ks = [1 << i for i in range(most.bit_length()) if 1 << i <= most]
    return results.withColumn("k", F.explode(F.array(*[F.lit(k).cast("bigint") for k in ks]))).where("rank <= k")
