"""Product quantisation: codebooks, codes, and search over codes in inverted lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.functions import distance
from vecspan.session import importable, work_dir

from . import ivf
from .topk import held, matrix, merge_topk

#: Codes of a book times its components, at most: what a task holds.
MOST_BOOK = 1 << 22
#: Numbers of the probing queries that are sent to every task at once; more are joined with the codes by cluster.
MOST_PROBE_VALUES = 1 << 24
#: Rows of codes that a task of that join holds.
LIST_BLOCK = 65_536


def chunks(df: DataFrame, n: int, dim: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, chunk, part): each vector's n slices of equal length."""
    size = part_size(n, dim)
    v = distance.doubles(F.col(vec_col))
    parts = F.array(*[F.slice(v, c * size + 1, size) for c in range(n)])
    return df.where(F.col(vec_col).isNotNull()).select(id_col, F.posexplode(parts).alias("chunk", "part")).withColumn("chunk", F.col("chunk").cast("bigint"))


def part_size(n: int, dim: int) -> int:
    if dim % n:
        raise ValueError(f"{dim} components don't divide into {n} chunks")
    return dim // n


def seed_codebook(base: DataFrame, n: int, dim: int, codes: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(chunk, code, center) from the first rows by id."""
    first = base.where(F.col(vec_col).isNotNull()).orderBy(id_col).limit(codes)
    return chunks(first, n, dim, id_col, vec_col).select("chunk", F.col(id_col).cast("bigint").alias("code"), F.col("part").alias("center"))


def book_array(codebook: DataFrame):
    """(chunks, codes, size) centers, and (chunks, codes) code numbers, in order. A codebook has at most MOST_BOOK numbers."""
    import numpy as np

    if codebook.agg(F.coalesce(F.sum(F.size("center")), F.lit(0))).first()[0] > MOST_BOOK:
        raise ValueError(f"the codebook has over {MOST_BOOK} numbers")
    rows = sorted((r.chunk, r.code, r.center) for r in codebook.select("chunk", "code", "center").collect())
    n = len({c for c, _, _ in rows})
    if not n or len(rows) % n:
        raise ValueError("chunks differ in their number of codes")
    return np.array([v for _, _, v in rows], np.float64).reshape(n, len(rows) // n, -1), np.array([c for _, c, _ in rows], np.int64).reshape(n, -1)


def train_codebook(base: DataFrame, n: int, dim: int, codes: int = 256, iterations: int = 15, id_col: str = "vec_id", vec_col: str = "embedding", sample: int | None = 256_000, seed: int = 0, digits: int = 12) -> DataFrame:
    """(chunk, code, center) by k-means in each chunk, means to ``digits`` decimals; a round is one pass over a bounded sample for all chunks."""
    import numpy as np

    spark = importable(base.sparkSession)
    size = part_size(n, dim)
    base = ivf.sampled(base.where(F.col(vec_col).isNotNull()), sample, id_col, vec_col, seed)
    first = base.orderBy(id_col).limit(codes).select(vec_col).collect()
    book = np.array([r[0] for r in first], np.float64).reshape(len(first), n, size).transpose(1, 0, 2)
    for _ in range(iterations if len(first) else 0):
        shared = spark.sparkContext.broadcast(book)

        def by_chunk(batch, shared=shared):
            from vecspan.functions.distance import nearest

            vec = matrix(batch.column(0)).reshape(batch.num_rows, n, size)
            for c in range(n):
                part = np.ascontiguousarray(vec[:, c])
                i, j, _ = nearest(part, shared.value[c], 1, "l2_sq")
                yield c, j, part[i]

        moved = ivf.cluster_means(base.select(vec_col), by_chunk, book.shape[1], size).collect()  # the codebook
        book = book.copy()
        for r in moved:
            book[r.part, r.cluster_id] = np.round(r.mean, digits)
        shared.unpersist()
    rows = [(c, k, book[c, k].tolist()) for c in range(book.shape[0]) for k in range(book.shape[1])]
    return spark.createDataFrame(rows, "chunk bigint, code bigint, center array<double>")


def encode_rows(df: DataFrame, codebook: DataFrame, keep: list[str], vec_col: str = "embedding", centroids: DataFrame | None = None) -> DataFrame:
    """``keep`` columns and codes, an array of a code a chunk: the nearest center of each slice (ties: the lower code).

    With centroids (``keep`` then has cluster_id) what is encoded is the difference from the
    row's own centroid. Map-only.
    """
    import numpy as np
    import pyarrow as pa

    spark = importable(df.sparkSession)
    shared = spark.sparkContext.broadcast((*book_array(codebook), *(held(centroids) if centroids is not None else (None, None))))
    fields = [df.schema[c] for c in keep]
    at = keep.index("cluster_id") if centroids is not None else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vecspan.functions.distance import nearest

        book, names, ids, cents = shared.value
        n, _, size = book.shape
        for batch in (b for b in batches if b.num_rows):
            vec = matrix(batch.column(len(keep)))
            if ids is not None:
                vec = vec - cents[np.searchsorted(ids, batch.column(at).to_numpy())]
            vec = vec.reshape(len(vec), n, size)
            ok = np.flatnonzero(np.isfinite(vec).all((1, 2)))
            codes = np.empty((len(ok), n), np.int64)
            for c in range(n):
                i, j, _ = nearest(np.ascontiguousarray(vec[ok, c]), book[c], 1, "l2_sq")
                codes[i, c] = names[c][j]
            lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, n, dtype=np.int32), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(ok)) for k in range(len(keep))), lists], names=[*keep, "codes"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "codes array<int>"])
    return df.where(F.col(vec_col).isNotNull()).select(*keep, vec_col).mapInArrow(run, schema)


def encode(df: DataFrame, codebook: DataFrame, n: int, dim: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, chunk, code): the codes of ``encode_rows`` as a row each."""
    part_size(n, dim)
    rows = encode_rows(df, codebook, [id_col], vec_col)
    return rows.select(id_col, F.posexplode("codes").alias("chunk", "code")).select(id_col, F.col("chunk").cast("bigint").alias("chunk"), F.col("code").cast("bigint").alias("code"))


def book_size(codebook: DataFrame) -> int:
    """Components of the vectors that a codebook encodes; 0 for an empty one."""
    return codebook.groupBy("chunk").agg(F.max(F.size("center")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def places(codes, names):
    """Codes as their places in a book whose codes have the (chunks, codes) ``names``."""
    import numpy as np

    order = [np.argsort(x) for x in names]
    return np.stack([order[c][np.searchsorted(names[c], codes[:, c], sorter=order[c])] for c in range(len(names))], 1)


def nearest_codes(q, book, codes, k: int, bound: float = float("inf")):
    """(row, distance) of the rows of ``codes`` that can be among the k nearest to a query, and within ``bound``, by a table of its parts' distances to the entries."""
    import numpy as np

    n, width, size = book.shape
    table = distance.exact(np.repeat(q.reshape(n, size), width, 0), book.reshape(-1, size), "l2_sq").reshape(n, width)
    total = np.zeros(len(codes))
    for x in range(n):
        total += table[x].take(codes[:, x])
    near = np.flatnonzero(total <= bound) if np.isfinite(bound) else np.arange(len(total))
    if len(near) > k:
        near = near[total[near] <= np.partition(total[near], k - 1)[k - 1]]
    return near, total[near]


@dataclass
class IvfPqIndex:
    """Codes in inverted lists: centroids, a codebook, and (cluster_id, id, codes) rows.

    Codes are of the difference between a vector and its centroid. Distances are approximate:
    the squared distance of the query to what a row's codes stand for.
    """

    centroids: DataFrame
    codebook: DataFrame
    lists: DataFrame
    id_col: str = "vec_id"
    vec_col: str = "embedding"

    @staticmethod
    def build(base: DataFrame, nlist: int, n: int, codes: int = 256, iterations: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", learn: DataFrame | None = None, centroids: DataFrame | None = None, codebook: DataFrame | None = None) -> IvfPqIndex:
        """Centroids and codebook are trained on ``learn`` or the base by the train-size rules, where they aren't given."""
        from vecspan.functions.vectors import dimension

        source = base if learn is None else learn
        cents = centroids if centroids is not None else ivf.kmeans(source, nlist, iterations, id_col, vec_col, train_rows=ivf.train_rows(nlist, False))
        if codebook is None:
            rows = differences(ivf.sampled(source, ivf.multi_train_rows(256_000, 8), id_col, vec_col), cents, id_col, vec_col)
            codebook = train_codebook(rows, n, dimension(base, vec_col), codes, iterations, id_col, vec_col, None)
        rows = ivf.assign(base, cents, "l2_sq", id_col, vec_col, keep=[id_col, vec_col]).drop("dist")
        return IvfPqIndex(cents, codebook, encode_rows(rows, codebook, ["cluster_id", id_col], vec_col, cents), id_col, vec_col)

    def add(self, rows: DataFrame) -> IvfPqIndex:
        """A new index that holds more rows; centroids and codebook stay."""
        new = ivf.assign(rows, self.centroids, "l2_sq", self.id_col, self.vec_col, keep=[self.id_col, self.vec_col]).drop("dist")
        codes = encode_rows(new, self.codebook, ["cluster_id", self.id_col], self.vec_col, self.centroids)
        return IvfPqIndex(self.centroids, self.codebook, self.lists.unionByName(codes), self.id_col, self.vec_col)

    def save(self, path: str) -> None:
        """Parquet tables, the codes partitioned by cluster, as ``ivf.save_parts`` writes them."""
        ivf.save_parts(path, {"kind": "ivfpq", "id_col": self.id_col, "vec_col": self.vec_col}, {"centroids": self.centroids, "codebook": self.codebook}, self.lists, self.id_col)

    @staticmethod
    def load(spark: SparkSession, path: str) -> IvfPqIndex:
        m, parts = ivf.load_parts(spark, path)
        return IvfPqIndex(parts["centroids"], parts["codebook"], parts["lists"], m["id_col"], m["vec_col"])

    def search(self, queries: DataFrame, k: int, nprobe: int, where: Column | str | None = None) -> DataFrame:
        """(qid, rank, id, dist) over the codes of the probed clusters.

        Up to MOST_PROBE_VALUES numbers, probes, (query, cluster) pairs with the query's vector, go
        to every task of a map-only scan of the codes, which reads the probed clusters' partitions
        only. More are joined with the codes by cluster instead, without the driver; a task then
        holds LIST_BLOCK rows of codes, past which the probes of their cluster stream, and passes on the k best
        of a query and block of codes; a task of the scan passes on the k best of a query.
        """
        probes = ivf.probe(queries, self.centroids, nprobe, vec_col=self.vec_col)
        asked = probes.select("qid", "cluster_id").join(queries.select("qid", distance.doubles(F.col(self.vec_col)).alias("q")), "qid")
        lists = self.lists.where(where) if where is not None else self.lists
        dim = book_size(self.codebook)
        most = MOST_PROBE_VALUES // max(1, dim)
        if asked.select("qid").limit(most + 1).count() > most:
            return merge_topk(self._routed(lists, asked, k), k, self.id_col)
        return merge_topk(self._scan(lists, [tuple(r) for r in asked.select("qid", "cluster_id", "q").toLocalIterator()], k), k, self.id_col)

    def _routed(self, lists: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """(qid, id, dist) by a shuffle: a cluster's codes are dealt to blocks by id, its probes are sent to each block."""
        import numpy as np
        import pyarrow as pa

        spark = importable(lists.sparkSession)
        blocks = lists.groupBy("cluster_id").agg(F.count("*").alias("n")).select("cluster_id", F.ceil(F.col("n") / LIST_BLOCK).cast("int").alias("blocks"))  # a row a cluster
        kind, id_col = lists.schema[self.id_col].dataType.simpleString(), self.id_col
        rows = lists.join(F.broadcast(blocks), "cluster_id").select("cluster_id", F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), F.col(id_col).alias("id"), "codes", F.lit(None).cast("bigint").alias("qid"), F.lit(None).cast("array<double>").alias("q"))
        sent = asked.join(F.broadcast(blocks), "cluster_id").select("cluster_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast("array<int>").alias("codes"), F.col("qid").cast("bigint").alias("qid"), "q")
        both = rows.unionByName(sent).repartition("cluster_id", "block").sortWithinPartitions("cluster_id", "block", "side")
        ids, cents = held(self.centroids)
        shared = spark.sparkContext.broadcast((ids, cents, *book_array(self.codebook)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names_, centers, book, names = shared.value
            at, own, codes = None, [], []
            for batch in (b for b in batches if b.num_rows):
                key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
                side = batch.column(2).to_numpy()
                change = (key[1:] != key[:-1]).any(1) | (side[1:] != side[:-1])
                cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    part, here = batch.slice(i, j - i), tuple(key[i])
                    if at != here:
                        at, own, codes = here, [], []
                    if side[i] == 0:
                        own.append(part.column(3))
                        codes.append(places(part.column(4).flatten().to_numpy().reshape(j - i, -1), names))
                    elif own:
                        own, codes = [pa.concat_arrays(own)], [np.concatenate(codes)]
                        q = matrix(part.column(6)) - centers[np.searchsorted(names_, here[0])]
                        for qid, one in zip(part.column(5).to_pylist(), q, strict=True):
                            near, dist = nearest_codes(one, book, codes[0], k)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), qid)), own[0].take(pa.array(near)), pa.array(dist)], names=["qid", id_col, "dist"])

        return both.mapInArrow(run, f"qid bigint, `{id_col}` {kind}, dist double")

    def _scan(self, lists: DataFrame, block: list, k: int) -> DataFrame:
        import numpy as np
        import pyarrow as pa

        spark = importable(lists.sparkSession)
        by: dict[int, list] = {}
        for qid, cluster, q in sorted(block):
            by.setdefault(cluster, []).append((qid, q))
        ids, cents = held(self.centroids)
        at = {int(c): i for i, c in enumerate(ids)}
        probes = {c: (np.array([q for q, _ in x], np.int64), np.array([v for _, v in x], np.float64) - cents[at[c]]) for c, x in by.items()}
        shared = spark.sparkContext.broadcast((probes, *book_array(self.codebook)))
        kind = lists.schema[self.id_col].dataType.simpleString()
        id_col = self.id_col

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probes_, book, names = shared.value
            qids = np.unique(np.concatenate([q for q, _ in probes_.values()])) if probes_ else np.zeros(0, np.int64)
            bound = np.full(len(qids), np.inf)  # the k-th distance found so far

            def least(found: list[tuple]) -> tuple:
                """The k nearest of each query: (place of the query, id, distance)."""
                at, own, d = (np.concatenate(x) for x in zip(*found, strict=True))
                sort = np.lexsort((own, d, at))
                at, own, d = at[sort], own[sort], d[sort]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                bound[at[place == k - 1]] = d[place == k - 1]
                return at[place < k], own[place < k], d[place < k]

            def passed(found: list[tuple]) -> Iterator[pa.RecordBatch]:
                at, own, d = least(found)
                for s in range(0, len(at), 1 << 16):
                    e = s + (1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[at[s:e]]), pa.array(own[s:e]).cast(id_type), pa.array(d[s:e])], names=["qid", id_col, "dist"])

            found, size, kept, id_type = [], 0, 0, None
            for batch in (b for b in batches if b.num_rows):
                cluster, id_type = batch.column(0).to_numpy(), batch.column(1).type
                ids = batch.column(1).to_numpy(zero_copy_only=False)
                ids = ids.astype(str) if ids.dtype == object else ids  # names, in the order of their code points
                codes = places(batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1), names)
                for c in np.unique(cluster):
                    if int(c) not in probes_:
                        continue
                    rows = np.flatnonzero(cluster == c)
                    mine = np.asfortranarray(codes[rows])  # a part's codes side by side
                    asked = np.searchsorted(qids, probes_[int(c)][0])
                    for at, q in zip(asked.tolist(), probes_[int(c)][1], strict=True):
                        near, dist = nearest_codes(q, book, mine, k, bound[at])
                        found.append((np.full(len(near), at), ids[rows[near]], dist))
                        size += len(near)
                        if size > 2 * kept + ivf.MOST_KEPT // 8:
                            found = [least(found)]
                            size = kept = len(found[0][0])
                            if kept > ivf.MOST_KEPT:
                                yield from passed(found)
                                found, size, kept = [], 0, 0
            if found:
                yield from passed(found)

        some = lists.where(F.col("cluster_id").isin(sorted(by))) if len(by) < 1000 else lists
        return some.select("cluster_id", id_col, "codes").mapInArrow(run, f"qid bigint, `{id_col}` {kind}, dist double")


def reranked(found: DataFrame, base: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest of each query by whole vectors among candidates (qid, id): (qid, rank, id, dist).

    Candidates with their query are broadcast to the base up to ivf.MOST_PROBES rows, which is then
    read once without a shuffle; more are joined by id. They are stored, so that they are searched for once.
    """
    path = work_dir(base.sparkSession, "found")
    found.select("qid", id_col).write.parquet(path)
    found = base.sparkSession.read.parquet(path)
    asked = found.select("qid", id_col).join(queries.select("qid", distance.doubles(F.col(vec_col)).alias("q")), "qid")
    few = found.limit(ivf.MOST_PROBES + 1).count() <= ivf.MOST_PROBES
    rows = base.select(id_col, distance.doubles(F.col(vec_col)).alias("v")).join(F.broadcast(asked) if few else asked, id_col)
    return merge_topk(rows.select("qid", id_col, distance.l2_sq(F.col("q"), F.col("v")).alias("dist")), k, id_col)


def differences(df: DataFrame, centroids: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vector): each vector minus its nearest centroid."""
    rows = ivf.assign(df, centroids, "l2_sq", id_col, vec_col, keep=[id_col, vec_col])
    minus = F.zip_with(distance.doubles(F.col(vec_col)), F.col("centroid"), lambda x, c: x - c)
    return rows.join(F.broadcast(centroids), "cluster_id").select(id_col, minus.alias(vec_col))


def flat(base: DataFrame, codebook: DataFrame, dim: int, id_col: str = "vec_id", vec_col: str = "embedding") -> IvfPqIndex:
    """Codes without inverted lists: one list around the origin."""
    origin = base.sparkSession.createDataFrame([(0, [0.0] * dim)], "cluster_id bigint, centroid array<double>")
    rows = base.select(F.lit(0).cast("bigint").alias("cluster_id"), id_col, vec_col)
    return IvfPqIndex(origin, codebook, encode_rows(rows, codebook, ["cluster_id", id_col], vec_col), id_col, vec_col)


def adc_search(base: DataFrame, codebook: DataFrame, queries: DataFrame, k: int, dim: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Asymmetric distance search (qid, rank, id, dist) over the codes of all rows."""
    return flat(base, codebook, dim, id_col, vec_col).search(queries, k, 1)
