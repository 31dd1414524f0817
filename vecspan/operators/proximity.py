"""Pruned proximity graphs: built shard by shard, stored with codes, searched by a beam, repaired as rows come and go.

A node keeps at most ``degree`` neighbours, chosen so that none is much nearer to another kept one
than to the node (robust pruning with a slack ``alpha``); some of them are far away, so that a
search needs few steps. A record holds a node's vector, its neighbours and the neighbours' codes:
reading it gives the exact distance to the node and code distances to all of its neighbours.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vecspan.functions import distance
from vecspan.session import importable, work_dir

from . import ivf, pq
from .topk import matrix, merge_topk, rank_small

#: Rows of a frontier (query and node) that are broadcast to the records; more are joined by shuffle.
MOST_FRONTIER = 100_000
#: Rows that a shard's build searches side by side, and rows of them that it prunes so that their candidates stay in a processor's cache.
BLOCK, FEW = 256, 32
#: Partitions of stored records by hash of the node, and records that a task relinks, about.
BUCKETS, PIECE = 16, 8192


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, which cuts lineage."""
    path = work_dir(df.sparkSession, name)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- shards within a budget ---------------------------------------------------------------------


def cut_shards(assigned: DataFrame, most: int, id_col: str = "vec_id") -> DataFrame:
    """Adds shard, a number for each cluster and each ``most`` rows of it by id, so that no shard is larger."""
    laid = ivf.layout(assigned, id_col)
    return laid.withColumn("shard", F.col("cluster_id") * (1 << 24) + F.expr(f"pos div {int(most)}")).drop("pos", "new_pos")


def budgeted_shards(base: DataFrame, budget: int, row_bytes: int, overlap: int = 2, sample: int = 100_000, tries: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Each row in its ``overlap`` nearest shards, none of which takes over ``budget`` bytes at ``row_bytes`` a row; and the shards' centroids.

    The number of shards is searched for: k-means over a sample of about ``sample`` rows, and the
    sizes that the sample gives when each row is in ``overlap`` shards; where the largest would not
    fit, there are a third more. A shard that is too large on the whole table after all (rows that
    are equal can't be told apart) is cut by id. A table that fits is one shard, without overlap.
    Returns (id, vector, shard) rows and (cluster_id, centroid).
    """
    most = budget // row_bytes
    if most < 2:
        raise ValueError("the budget is less than two rows")
    rows = base.where(distance.finite(F.col(vec_col))).select(id_col, vec_col)
    n = rows.count()
    if n <= most:
        return rows.withColumn("shard", F.lit(0).cast("bigint")), ivf.lloyd_step(rows, ivf.seed_centroids(rows, 1, id_col, vec_col), id_col, vec_col)
    learn = ivf.sampled(rows, sample, id_col, vec_col)
    taken = learn.count()
    parts = -(-n * overlap // most)
    for _ in range(tries):
        cents = ivf.kmeans(learn, parts, 5, id_col, vec_col)
        sizes = rank_small(learn, cents, overlap, "l2_sq", id_col, vec_col).groupBy("cluster_id").count()
        if (sizes.agg(F.max("count")).first()[0] or 0) * n <= most * taken or parts * 4 > taken:
            break
        parts += -(-parts // 3)
    shards = rank_small(rows, cents, overlap, "l2_sq", id_col, vec_col, keep=[id_col, vec_col]).select(id_col, vec_col, "cluster_id")
    return cut_shards(shards, most, id_col).select(id_col, vec_col, "shard"), cents


# --- pruning and the graph of one shard -----------------------------------------------------------


def kept_by_pruning(dist: np.ndarray, vec: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Which candidates (rows, candidates) stay: the nearest, then again and again the nearest that no kept one is ``alpha`` times nearer to.

    ``dist`` are squared distances to the row itself in rising order, infinite where there is
    no candidate, ``vec`` (rows, candidates, components) the candidates, best as seen from the row. Products of
    single precision tell most of them; what their rounding leaves open is measured in double precision.
    """
    alive, kept = np.isfinite(dist), np.zeros(dist.shape, bool)
    every, factor = np.arange(len(dist)), alpha * alpha
    with np.errstate(over="ignore", invalid="ignore"):
        single = vec.astype(np.float32)
        sq = np.einsum("ijk,ijk->ij", single, single)
        # Dots are off by half an epsilon a term at most, and each factor was rounded too.
        slack = factor * 4 * (vec.shape[2] + 8) * float(np.finfo(np.float32).eps)
        for _ in range(min(degree, dist.shape[1])):
            at = alive.argmax(1)
            rows = np.flatnonzero(alive[every, at])
            if not len(rows):
                break
            at = at[rows]
            kept[rows, at] = True
            part = single if len(rows) == len(dist) else single[rows]
            both = sq[rows] + sq[rows, at][:, None]
            more = factor * (both - 2 * (part @ single[rows, at][:, :, None])[:, :, 0]) - dist[rows]
            farther = more > 0
            i, j = np.nonzero(alive[rows] & ~(np.abs(more) > slack * both + 1e-30))
            gap = vec[rows[i], j] - vec[rows[i], at[i]]
            farther[i, j] = factor * np.einsum("ij,ij->i", gap, gap) > dist[rows[i], j]
            alive[rows] &= farther
            alive[rows, at] = False
    return kept


def pruned_links(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, pool: int, alpha: float) -> np.ndarray:
    """(rows, degree) of the neighbours that pruning leaves to each row of ``own`` from its candidates; -1 for none."""
    out = np.full((len(own), degree), -1, np.int64)
    for at in range(0, len(own), FEW):
        me, c = own[at : at + FEW], np.sort(cand[at : at + FEW], 1)
        c = c[:, (c >= 0).argmax(1).min() :]  # what all of them lack
        gap = x[c] - x[me][:, None]
        dist = np.einsum("ijk,ijk->ij", gap, gap)
        dist[(c < 0) | (c == me[:, None])] = np.inf
        dist[:, 1:][c[:, 1:] == c[:, :-1]] = np.inf
        by = np.argsort(dist, 1, kind="stable")[:, : max(1, min(pool, int(np.isfinite(dist).sum(1).max())))]
        c, dist = np.take_along_axis(c, by, 1), np.take_along_axis(dist, by, 1)
        kept = kept_by_pruning(dist, gap[np.arange(len(by))[:, None], by], degree, alpha)
        place = np.cumsum(kept, 1) - 1
        r, k = np.nonzero(kept)
        out[at + r, place[r, k]] = c[r, k]
    return out


def visited_nodes(x: np.ndarray, links: np.ndarray, start: int, rows: np.ndarray, width: int, expand: int = 4) -> np.ndarray:
    """(rows, nodes) that beam searches for ``rows`` from ``start`` step on, all side by side; -1 fills up."""
    q, b, m = x[rows], len(rows), len(x)
    dist, node, done = np.full((b, width), np.inf), np.full((b, width), -1), np.ones((b, width), bool)
    dist[:, 0], node[:, 0], done[:, 0] = ((q - x[start]) ** 2).sum(1), start, False
    seen = np.zeros((b, m), bool)
    seen[:, start] = True
    out = []
    while True:
        pick = ~done & (np.cumsum(~done, 1) <= expand)
        if not pick.any():
            return np.concatenate(out, 1) if out else np.full((b, 1), -1)
        at = np.argsort(~pick, 1, kind="stable")[:, :expand]
        some = np.take_along_axis(pick, at, 1)
        step = np.where(some, np.take_along_axis(node, at, 1), -1)
        out.append(step)
        done |= pick
        near = np.where(some[:, :, None], links[step], -1).reshape(b, -1)
        there = np.flatnonzero(near >= 0)
        key = there // near.shape[1] * m + near.ravel()[there]
        key = np.unique(key[~seen.ravel()[key]])
        r, c = key // m, key % m
        seen[r, c] = True
        many = np.bincount(r, minlength=b)
        place = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
        more_d, more_n = np.full((b, many.max(initial=0)), np.inf), np.full((b, many.max(initial=0)), -1)
        for s in range(0, len(r), 4 * BLOCK):  # few at a time stay in a processor's cache
            e = s + 4 * BLOCK
            gap = q[r[s:e]] - x[c[s:e]]
            more_d[r[s:e], place[s:e]] = np.einsum("ij,ij->i", gap, gap)
        more_n[r, place] = c
        dist, node, done = (np.concatenate(p, 1) for p in ((dist, more_d), (node, more_n), (done, more_n < 0)))
        by = np.argsort(dist, 1, kind="stable")[:, :width]
        dist, node, done = (np.take_along_axis(p, by, 1) for p in (dist, node, done))


def shard_links(x: np.ndarray, degree: int, width: int, pool: int, alpha: float, sure: int | None = None) -> tuple[np.ndarray, int]:
    """(rows, degree) neighbours within one shard, and its medoid, the row nearest to the mean.

    From random links, two rounds: every row is searched for from the medoid, and what the
    search stepped on is pruned to its neighbours; these get the row as a candidate in turn. The
    first round prunes without slack, the second with ``alpha``. Both leave a place free, which
    serves to bring in reach of the medoid what isn't; such a link comes first in its list.
    The first ``sure`` places of the lists alone, all by default, bring every row in reach.
    """
    m = len(x)
    medoid = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    if m <= degree + 1:
        return (np.arange(m)[:, None] + np.arange(1, m)) % max(1, m), medoid  # the first places are a ring
    rng = np.random.default_rng(m)
    whole, degree = degree, max(1, degree - 1)
    links = np.full((m, degree), -1, np.int64)
    links[:, : max(1, degree // 2)] = rng.integers(0, m, (m, max(1, degree // 2)))
    for slack in (1.0, alpha):
        order = rng.permutation(m)
        for at in range(0, m, BLOCK):
            own = order[at : at + BLOCK]
            cand = np.concatenate([visited_nodes(x, links, medoid, own, width), links[own]], 1)
            links[own] = pruned_links(x, own, cand, degree, pool, slack)
            i, k = np.nonzero(links[own] >= 0)
            to, by = links[own][i, k], own[i]
            sort = np.lexsort((by, to))
            to, by = to[sort], by[sort]
            targets, first, many = np.unique(to, return_index=True, return_counts=True)
            back = np.full((len(targets), many.max(initial=0)), -1, np.int64)
            back[np.repeat(np.arange(len(targets)), many), np.arange(len(to)) - np.repeat(first, many)] = by
            cand = np.concatenate([links[targets], back], 1)
            # Who has room takes all of them, and others are pruned.
            cand = np.sort(cand, 1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            fits = (cand >= 0).sum(1) <= degree
            links[targets[fits]] = -np.sort(-cand[fits], 1)[:, :degree]
            links[targets[~fits]] = pruned_links(x, targets[~fits], cand[~fits], degree, pool, slack)
    out = np.full((m, max(2, whole)), -1, np.int64)
    out[:, 1 : 1 + degree] = links
    _in_reach(x, out[:, :sure], medoid)
    return out, medoid


def _in_reach(x: np.ndarray, links: np.ndarray, start: int) -> None:
    """Brings every row in reach of ``start``: the first place of each list, which is free, takes the nearest row that wasn't reached."""

    def spread(rows: np.ndarray) -> None:
        while len(rows):
            reached[rows] = True
            rows = np.unique(links[rows])
            rows = rows[(rows >= 0) & ~reached[np.maximum(rows, 0)]]

    reached = np.zeros(len(x), bool)
    spread(np.array([start]))
    for row in range(len(x)):
        if not reached[row]:
            free = np.flatnonzero(reached & (links[:, 0] < 0))
            links[free[((x[free] - x[row]) ** 2).sum(1).argmin()], 0] = row
            spread(np.array([row]))


def shard_graphs(shards: DataFrame, degree: int, width: int, pool: int, alpha: float, id_col: str = "vec_id", vec_col: str = "embedding", sure: int | None = None, parts: int | None = None) -> DataFrame:
    """(node, neighbours, medoid) of every shard's own graph, a grouped Arrow pass: a task holds one shard at a time. ``sure`` as for ``shard_links``.

    ``parts`` tasks are made where it is given: rows are few bytes but much work, which the plan can't tell.
    """
    import pyarrow as pa

    importable(shards.sparkSession)
    rows = shards.select("shard", F.col(id_col).cast("bigint").alias("node"), F.col(vec_col).alias("v"))
    rows = rows.repartition(parts, "shard") if parts else rows

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        ids = table.column("node").to_numpy()
        links, medoid = shard_links(matrix(table.column("v").combine_chunks()), degree, width, pool, alpha, sure)
        there = links >= 0
        ends = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[links[there]]))
        return pa.table({"node": ids, "neighbours": lists, "medoid": pa.array(np.arange(len(ids)) == medoid)})

    return rows.groupBy("shard").applyInArrow(build, "node bigint, neighbours array<bigint>, medoid boolean")


def merged_links(parts: DataFrame, degree: int) -> DataFrame:
    """(node, neighbours) from (node, neighbours) rows of several shards: in turn the next of each, at most ``degree``.

    Of n lists the first degree // n neighbours stay, whatever is cut.
    """
    lists = F.sort_array(F.collect_list("neighbours"))
    turn = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(degree - 1)), lambda i: F.transform("lists", lambda one: F.get(one, i))))
    return parts.groupBy("node").agg(lists.alias("lists")).select("node", F.slice(F.array_distinct(F.array_compact(turn)), 1, degree).alias("neighbours"))


# --- beam search over records ----------------------------------------------------------------------


class Beam:
    """The beam of one query: its ``width`` nearest nodes seen, by the distance that steers the search. ``seen`` is in order."""

    def __init__(self, width: int, expand: int, nodes: np.ndarray, dist: np.ndarray, done: np.ndarray, seen: np.ndarray, near: np.ndarray, near_dist: np.ndarray):
        self.width, self.expand = width, expand
        self.nodes, self.dist, self.done, self.seen, self.near, self.near_dist = nodes, dist, done, np.sort(seen), near, near_dist

    def want(self) -> np.ndarray:
        """The nearest nodes of the beam that haven't been stepped on."""
        return self.nodes[np.flatnonzero(~self.done)[: self.expand]]

    def take(self, found: np.ndarray, exact: np.ndarray, nodes: np.ndarray, dist: np.ndarray) -> None:
        """The wanted nodes that were found, their exact distances, and all their neighbours with the distances that steer. A wanted node that isn't there any more is passed over."""
        self.done = self.done.copy()
        self.done[np.flatnonzero(~self.done)[: self.expand]] = True
        by = np.argsort(found, kind="stable")
        self.near, self.near_dist = np.concatenate([self.near, found[by]]), np.concatenate([self.near_dist, exact[by]])
        fresh, first = np.unique(nodes, return_index=True)
        at = np.searchsorted(self.seen, fresh)
        new = at == len(self.seen)
        new[~new] = self.seen[at[~new]] != fresh[~new]
        fresh, first = fresh[new], first[new]
        self.seen = np.sort(np.concatenate([self.seen, fresh]), kind="stable")
        nodes, dist = np.concatenate([self.nodes, fresh]), np.concatenate([self.dist, dist[first]])
        by = np.lexsort((nodes, dist))[: self.width]
        self.nodes, self.dist, self.done = nodes[by], dist[by], np.concatenate([self.done, np.zeros(len(fresh), bool)])[by]

    def row(self) -> tuple:
        return self.nodes, self.dist, self.done, self.seen, self.near, self.near_dist, self.want()


def steered(book: np.ndarray, q: np.ndarray, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of the ``rows`` of q to the entries that codes (one each, parts) name."""
    parts, _, size = book.shape
    out = np.zeros(len(codes))
    for s in range(0, len(codes), 1024):
        gap = q[rows[s : s + 1024]].reshape(-1, parts, size) - book[np.arange(parts), codes[s : s + 1024]]
        out[s : s + 1024] = np.einsum("ijk,ijk->ij", gap, gap).sum(1)
    return out


def _parts(column) -> tuple:
    """(where each list begins, and the end; the values) of an Arrow list column. Null lists are empty."""
    import pyarrow.compute as pc

    many = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(many)]).astype(np.int32), column.flatten()


_STATE = "qid bigint, q array<double>, nodes array<bigint>, dist array<double>, done array<boolean>, seen array<bigint>, near array<bigint>, near_dist array<double>, want array<bigint>"


@dataclass
class ProximityGraph:
    """Node records (bucket, node, v, code, neighbours, codes), the nodes where searches start, and a codebook.

    codes are the neighbours' codes, one after the other. ``cache`` holds the records of whole
    breadth-first levels around the starts; a search follows them without a job.
    """

    nodes: DataFrame
    entries: DataFrame
    codebook: DataFrame
    degree: int = 32
    width: int = 64
    alpha: float = 1.2
    cache: DataFrame | None = None
    id_col: str = "vec_id"
    vec_col: str = "embedding"
    stats: dict = field(default_factory=dict)

    @staticmethod
    def build(base: DataFrame, degree: int = 32, width: int = 64, pool: int = 200, alpha: float = 1.2, budget: int = 8 << 20, overlap: int = 2, parts: int = 16, codes: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> ProximityGraph:
        """A graph over all rows with a finite vector; ids are unique.

        Rows are dealt to overlapping shards of at most ``budget`` bytes, each a task's; shards
        that overlap make graphs of two thirds of ``degree``, whose links are merged; the links that
        merging keeps for certain reach every row of a shard from its medoid, a start, where
        ``degree`` is at least ``overlap``. The work of a row depends on the parameters and on the
        shard's size, not on the number of rows.
        """
        row_bytes = 16 * _dimension(base, vec_col) + 16 * degree + BLOCK
        shards, _ = budgeted_shards(base, budget, row_bytes, overlap, id_col=id_col, vec_col=vec_col)
        shards = stored(shards, "shards")
        many = shards.select("shard").distinct().count()
        one = many <= 1
        found = stored(shard_graphs(shards, degree if one else max(1, 2 * degree // 3), width, pool, alpha, id_col, vec_col, None if one else max(1, degree // overlap), 2 * many), "links")
        links = found.select("node", "neighbours") if one else merged_links(found, degree)
        rows = base.where(distance.finite(F.col(vec_col))).select(F.col(id_col).cast("bigint").alias("node"), F.col(vec_col).cast("array<float>").alias("v"))
        book = pq.train_codebook(rows, parts, _dimension(base, vec_col), codes, 10, "node", "v")
        own = stored(pq.encode_rows(rows, book, ["node", "v"], "v").withColumnRenamed("codes", "code"), "codes")
        nodes = _records(own.join(links, "node", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<bigint>"))), own)
        graph = ProximityGraph(nodes, _entries(nodes, found.where("medoid").select("node").distinct()), book, degree, width, alpha, None, id_col, vec_col)
        graph.stats["shards"] = many
        return graph

    def with_cache(self, most: int = 4096) -> ProximityGraph:
        """The same graph with the records of the first breadth-first levels kept, as many whole levels as have at most ``most`` nodes in all.

        Nothing is cached where the starts alone are more. stats["cached"] has the number chosen.
        """
        picked = self.entries.select("node").distinct()
        size = picked.count()
        levels = 0
        while 0 < size <= most:
            held_, levels, kept = picked, levels + 1, size
            around = self.nodes.join(F.broadcast(picked), "node").select(F.explode("neighbours").alias("node"))
            picked = stored(picked.unionByName(around).distinct(), "level")
            size = picked.count()
            if size == kept:
                break
        if not levels:
            return replace(self, cache=None, stats={**self.stats, "cached": 0, "levels": 0})
        records = stored(self.nodes.join(F.broadcast(held_), "node"), "cache")
        return replace(self, cache=records, stats={**self.stats, "cached": kept, "levels": levels})

    def save(self, path: str) -> None:
        """Parquet tables, records bucketed by node and sorted inside, and a manifest, which is written last; a path that is taken is an error."""
        self.nodes.repartition("bucket").sortWithinPartitions("bucket", "node").write.partitionBy("bucket").parquet(f"{path}/nodes")
        self.entries.write.parquet(f"{path}/entries")
        self.codebook.write.parquet(f"{path}/codebook")
        if self.cache is not None:
            self.cache.write.parquet(f"{path}/cache")
        about = json.dumps({"degree": self.degree, "width": self.width, "alpha": self.alpha, "id_col": self.id_col, "vec_col": self.vec_col, "cached": self.cache is not None, "stats": self.stats})
        self.nodes.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/manifest")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ProximityGraph:
        m = json.loads(spark.read.text(f"{path}/manifest").first().value)
        cache = spark.read.parquet(f"{path}/cache") if m["cached"] else None
        return ProximityGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/codebook"), m["degree"], m["width"], m["alpha"], cache, m["id_col"], m["vec_col"], m["stats"])

    def search(self, queries: DataFrame, k: int, width: int | None = None, expand: int = 4, starts: int = 8) -> DataFrame:
        """(qid, rank, id, dist) by exact distances; fewer than k where fewer nodes can be reached.

        A step reads the records of the ``expand`` nearest nodes of each beam, all queries at once,
        and is one Spark job; a frontier of up to MOST_FRONTIER rows is broadcast and prunes buckets; more are joined by shuffle.
        Steps whose records are all in the cache need no job. Codes steer; the nodes stepped on,
        whose vectors were read, are ranked by exact distance. It ends for a query when its beam
        has been stepped on. Queries without a finite vector find nothing. stats then has steps,
        the distances to codes and the vectors read.
        """
        found = self._walk(queries, max(k, width or self.width), expand, starts)
        near = found.select("qid", F.explode(F.arrays_zip("near", "near_dist")).alias("s")).select("qid", F.col("s.near").alias(self.id_col), F.col("s.near_dist").alias("dist"))
        return merge_topk(near, k, self.id_col)

    def _walk(self, queries: DataFrame, width: int, expand: int, starts: int) -> DataFrame:
        """The final (qid, seen, near, near_dist) of each query."""
        import pyarrow as pa

        spark = importable(self.nodes.sparkSession)
        q = queries.where(distance.finite(F.col(self.vec_col))).select(F.col("qid").cast("bigint").alias("qid"), distance.doubles(F.col(self.vec_col)).alias("q"))
        book = pq.book_array(self.codebook)[0]
        shared = spark.sparkContext.broadcast((book, _cached(self.cache)))
        schema = _STATE

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Distances of fetched records: (qid, node, exact, neighbours, steer)."""
            book_ = shared.value[0]
            for batch in (b for b in _sliced(batches) if b.num_rows):
                vectors = matrix(batch.column(1))
                ends, _ = _parts(batch.column(4))
                codes = _parts(batch.column(5))[1].to_numpy(zero_copy_only=False).reshape(-1, len(book_))
                steer = steered(book_, vectors, np.repeat(np.arange(batch.num_rows), np.diff(ends)), codes)
                exact = distance.exact(vectors, matrix(batch.column(3)), "l2_sq")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(exact), batch.column(4), pa.ListArray.from_arrays(pa.array(ends), pa.array(steer))], names=["qid", "node", "exact", "neighbours", "steer"])

        def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Beams after what was found for them, followed as far as the cache goes."""
            book_, held_ = shared.value
            names = [c.split()[0] for c in schema.split(", ")]
            kinds = (np.int64, np.float64, bool, np.int64, np.int64, np.float64, np.int64)
            for batch in (b for b in _sliced(batches) if b.num_rows):
                vectors, first, out = matrix(batch.column("q")), batch.column("first").to_numpy(zero_copy_only=False), []
                state = [(e, v.to_numpy(zero_copy_only=False)) for e, v in (_parts(batch.column(c)) for c in names[2:-1])]
                whole = batch.column("found").is_valid().to_numpy(zero_copy_only=False)
                found_at, found = _parts(batch.column("found"))
                node, exact = (found.field(c).to_numpy(zero_copy_only=False) for c in ("node", "exact"))
                near_at, near = _parts(found.field("neighbours"))
                near, steer = near.to_numpy(zero_copy_only=False), _parts(found.field("steer"))[1].to_numpy(zero_copy_only=False)
                for i in range(batch.num_rows):
                    beam = Beam(width, expand, *(v[e[i] : e[i + 1]] for e, v in state))
                    if whole[i] or not first[i]:
                        s, e = found_at[i], found_at[i + 1]
                        beam.take(node[s:e], exact[s:e], near[near_at[s] : near_at[e]], steer[near_at[s] : near_at[e]])
                    while held_ and len(want := beam.want()) and all(n in held_ for n in want.tolist()):
                        records = [held_[n] for n in want.tolist()]
                        codes = np.concatenate([r[2] for r in records]).reshape(-1, len(book_))
                        d = distance.exact(np.repeat(vectors[i][None], len(want), 0), np.stack([r[0] for r in records]), "l2_sq")
                        beam.take(want, d, np.concatenate([r[1] for r in records]), steered(book_, vectors, np.full(len(codes), i), codes))
                    out.append(beam.row())
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in c])]).astype(np.int32)), pa.array(np.concatenate(c).astype(kind))) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("q"), *lists], names=names)

        at = rank_small(q, self.entries, starts, "l2_sq", "qid", "q", ref_id="node", ref_vec="v", keep=["qid"])
        first = at.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("dist", "node"))).alias("s")).join(q, "qid")
        none = F.array()
        state = first.select("qid", "q", F.col("s.node").alias("nodes"), F.col("s.dist").alias("dist"), F.transform("s", lambda _: F.lit(False)).alias("done"), F.col("s.node").alias("seen"), none.cast("array<bigint>").alias("near"), none.cast("array<double>").alias("near_dist"), F.lit(None).cast(_FOUND).alias("found"), F.lit(True).alias("first"))
        ended, steps = None, 0
        while True:
            seen = Observation()
            state = stored(state.mapInArrow(stepped, schema).observe(seen, F.sum(F.size("want")).alias("want")), "beams")
            want = seen.get["want"] or 0
            closed = state.where("size(want) = 0").select("qid", "seen", "near", "near_dist")
            ended = closed if ended is None else ended.unionByName(closed)
            if not want:
                break
            steps += 1
            state = state.where("size(want) > 0")
            asked = state.select("qid", "q", F.explode("want").alias("node")).withColumn("bucket", _bucket())
            asked = F.broadcast(asked) if want <= MOST_FRONTIER else asked
            found = self.nodes.join(asked, ["bucket", "node"]).select("qid", "q", "node", "v", "neighbours", "codes").mapInArrow(measured, "qid bigint, node bigint, exact double, neighbours array<bigint>, steer array<double>")
            found = found.groupBy("qid").agg(F.collect_list(F.struct("node", "exact", "neighbours", "steer")).alias("found"))
            state = state.drop("want").join(found, "qid", "left").withColumn("first", F.lit(False))
        totals = ended.agg(F.coalesce(F.sum(F.size("seen")), F.lit(0)), F.coalesce(F.sum(F.size("near")), F.lit(0)), F.count("*")).first()
        self.stats.update(steps=steps, code_distances=totals[0], vectors_read=totals[1], queries=totals[2])
        return ended

    # --- rows that come and go ---

    def delete(self, dead: DataFrame) -> ProximityGraph:
        """The graph without the nodes of ``dead`` (its first column). Edges to them are repaired.

        A node that had a deleted neighbour gets that one's neighbours as candidates, and is
        pruned again where there are more than its degree. Where a start goes, the remaining node
        nearest to it takes its place. Nothing else is touched; a cache is dropped.
        """
        gone = stored(dead.select(F.col(dead.columns[0]).cast("bigint").alias("dst")).where("dst is not null").distinct(), "gone")
        few = F.broadcast(gone) if gone.count() <= MOST_FRONTIER else gone
        left = self.nodes.join(few.withColumnRenamed("dst", "node"), "node", "left_anti")
        edges = left.select("node", F.explode("neighbours").alias("dst"))
        cut = stored(edges.join(few, "dst"), "cut")
        touched = cut.select("node").distinct()
        own = edges.join(touched, "node", "left_semi").join(few, "dst", "left_anti")
        onward = cut.join(self.nodes.select(F.col("node").alias("dst"), "neighbours"), "dst").select("node", F.explode("neighbours").alias("dst")).where("dst <> node").join(few, "dst", "left_anti")
        pairs = own.select("node", "dst").unionByName(onward)
        return self._with(stored(self._relinked(left, pairs, left, touched), "records", "bucket"))

    def insert(self, rows: DataFrame) -> ProximityGraph:
        """The graph with new rows (id and vector), whose ids it doesn't have.

        Each new row is searched for; what the search stepped on, and the neighbours that it gets
        in a graph of the new rows alone, are pruned to its neighbours. These get it as a neighbour
        in turn and are pruned where that makes too many. Codes are those of the trained codebook.
        """
        new = rows.where(distance.finite(F.col(self.vec_col))).select(F.col(self.id_col).cast("bigint").alias("node"), F.col(self.vec_col).cast("array<float>").alias("v"))
        none = (_bucket().alias("bucket"), "node", "v", "code", F.array().cast("array<bigint>").alias("neighbours"), F.array().cast("array<int>").alias("codes"))
        new = stored(pq.encode_rows(new, self.codebook, ["node", "v"], "v").withColumnRenamed("codes", "code").select(*none), "new")
        walked = self._walk(new.select(F.col("node").alias("qid"), F.col("v").alias(self.vec_col)), self.width, 16, 8)
        pairs = walked.select(F.col("qid").alias("node"), F.explode("near").alias("dst"))
        shards, _ = budgeted_shards(new, 8 << 20, 16 * _dimension(new, "v") + 16 * self.degree + BLOCK, id_col="node", vec_col="v")
        shards = stored(shards, "shards")
        many = shards.select("shard").distinct().count()
        among = shard_graphs(shards, max(1, self.degree // 2), self.width, 200, self.alpha, "node", "v", parts=2 * many).select("node", F.explode("neighbours").alias("dst"))
        fresh = stored(self._relinked(new, stored(pairs.unionByName(among), "pairs"), self.nodes.unionByName(new)), "fresh", "bucket")
        every = self.nodes.select(*fresh.columns).unionByName(fresh)
        back = fresh.select(F.explode("neighbours").alias("node"), F.col("node").alias("dst"))
        known = every.join(back.select("node").distinct(), "node", "left_semi").select("node", F.explode("neighbours").alias("dst"))
        return self._with(stored(self._relinked(every, known.unionByName(back), every), "records", "bucket"))

    def _with(self, records: DataFrame) -> ProximityGraph:
        rows = records.select("node", "v")
        starts = self.entries.join(rows.select("node"), "node", "left_semi")
        lost = stored(self.entries.join(rows.select("node"), "node", "left_anti"), "lost")
        if not lost.isEmpty():
            from .topk import exact_knn

            heirs = exact_knn(rows, lost.select(F.col("node").alias("qid"), "v"), 1, id_col="node", vec_col="v").select("node").distinct()
            starts = stored(starts.unionByName(rows.join(heirs, "node")).distinct(), "entries")
        return replace(self, nodes=records, entries=starts, cache=None, stats={})

    def _relinked(self, records: DataFrame, pairs: DataFrame, known: DataFrame, bare: DataFrame | None = None) -> DataFrame:
        """``records`` in order, in which nodes with candidates have these as neighbours, pruned to the degree where there are more.

        ``pairs`` are the candidates (node, dst), in any order and number of times, and ``known`` records of
        all of them; ``bare`` nodes lose their neighbours where they have no candidates. Other records stay as they are.
        Candidates come with their codes, so that no other node's record is read, and as rows that are sorted to their
        node: a task holds a batch of them, and the candidates of one node.
        """
        import pyarrow as pa

        importable(records.sparkSession)
        degree, alpha = self.degree, self.alpha
        names = ["bucket", "node", "v", "code", "neighbours", "codes"]
        kinds = {c: records.schema[c].dataType.simpleString() for c in names}
        lack = {c: F.lit(None).cast(kinds[c]).alias(c) for c in names}
        row = [F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("dst"), *(c for c in names if c != "bucket")]
        far = known.select(F.col("node").alias("dst"), "v", "code")
        rows = records.select(*row).unionByName(pairs.join(far, "dst").select(F.lit(2).alias("kind"), "dst", "node", "v", "code", lack["neighbours"], lack["codes"]))
        if bare is not None:
            rows = rows.unionByName(bare.select(F.lit(1).alias("kind"), lack["node"].alias("dst"), "node", *(lack[c] for c in names[2:])))
        pieces = -(-records.count() // PIECE) // BUCKETS + 1  # of a bucket
        piece = F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(pieces)).cast("int")
        rows = rows.withColumn("bucket", _bucket()).withColumn("piece", F.col("bucket") * pieces + piece)
        rows = rows.repartitionById(BUCKETS * pieces, "piece").sortWithinPartitions("node", "kind").select("kind", "dst", *names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _whole_groups(batches, "node"):
                yield from relinked(table, degree, alpha).to_batches()

        found = rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))
        return found.sortWithinPartitions("bucket", "node")


_FOUND = "array<struct<node:bigint,exact:double,neighbours:array<bigint>,steer:array<double>>>"


def _sliced(batches: Iterator) -> Iterator:
    """Batches of BLOCK rows at most, so that what a task holds of beams and records at once is bounded."""
    return (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK))


def _whole_groups(batches: Iterator, column: str) -> Iterator:
    """Tables of the batches' rows, which are in order of a column, so that all rows of a value are in one table."""
    import pyarrow as pa

    held_: list = []
    for batch in (b for b in batches if b.num_rows):
        key = batch.column(column).to_numpy()
        first = int(np.searchsorted(key, key[-1]))  # where the last value begins, which may go on
        if held_ and (first or held_[-1].column(column)[-1].as_py() != key[0]):
            yield pa.Table.from_batches([*held_, batch.slice(0, first)])
            held_ = []
        elif first:
            yield pa.Table.from_batches([batch.slice(0, first)])
        held_.append(batch.slice(first))
    if held_:
        yield pa.Table.from_batches(held_)


def relinked(table, degree: int, alpha: float):
    """Records (kind 0) of a table in order of node and kind, with the neighbours that pruning leaves of their candidates (kind 2, dst).

    Rows of kind 1 are nodes that lose their neighbours where they have no candidates. Rows without a record are passed over.
    """
    import pyarrow as pa

    table = table.combine_chunks()
    kind, node = table.column("kind").to_numpy(), table.column("node").to_numpy()
    records = table.filter(pa.array(kind == 0)).select(["bucket", "node", "v", "code", "neighbours", "codes"])
    ids = records.column("node").to_numpy()
    if not len(ids) or not (kind > 0).any():
        return records
    at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)  # the record of each row
    there = ids[at] == node
    changed = np.zeros(len(ids), bool)
    changed[at[there & (kind > 0)]] = True
    pick = np.flatnonzero(there & (kind == 2))
    r, dst = at[pick], table.column("dst").to_numpy()[pick]
    me = matrix(records.column("v").combine_chunks())
    vec = matrix(table.column("v").combine_chunks().take(pa.array(pick))) if len(pick) else np.zeros((0, me.shape[1]))
    gap = vec - me[r]
    d = np.einsum("ij,ij->i", gap, gap)
    by = np.lexsort((dst, d, r))
    by = by[np.concatenate([[True], (r[by][1:] != r[by][:-1]) | (dst[by][1:] != dst[by][:-1])])] if len(by) else by
    r, dst, gap, d, pick = r[by], dst[by], gap[by], d[by], pick[by]
    many = np.bincount(r, minlength=len(ids))
    begin = np.cumsum(many) - many
    kept = np.ones(len(r), bool)
    over = np.flatnonzero(many > degree)
    over = over[np.argsort(many[over], kind="stable")]  # lists of a length side by side, as they are padded to the longest
    for x in range(0, len(over), FEW):
        part = over[x : x + FEW]
        place = np.arange(many[part].max())
        some = place < many[part][:, None]
        where = np.where(some, begin[part][:, None] + place, 0)
        kept[where[some]] = kept_by_pruning(np.where(some, d[where], np.inf), gap[where], degree, alpha)[some]
    r, dst, pick = r[kept], dst[kept], pick[kept]
    code = table.column("code").combine_chunks().take(pa.array(pick))
    many = np.bincount(r, minlength=len(ids))[changed]
    ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
    parts = len(code.flatten()) // max(1, len(pick))
    new = records.filter(pa.array(changed)).select(["bucket", "node", "v", "code"])
    new = new.append_column("neighbours", pa.ListArray.from_arrays(pa.array(ends), pa.array(dst)))
    new = new.append_column("codes", pa.ListArray.from_arrays(pa.array(ends * parts), code.flatten()))
    return pa.concat_tables([records.filter(pa.array(~changed)), new.cast(records.schema)])


def _cached(cache: DataFrame | None) -> dict:
    """node: (vector, neighbours, codes) of a bounded table of records."""
    if cache is None:
        return {}
    return {r.node: (np.array(r.v, np.float64), np.array(r.neighbours, np.int64), np.array(r.codes, np.int64)) for r in cache.select("node", "v", "neighbours", "codes").toLocalIterator()}


def _dimension(base: DataFrame, vec_col: str) -> int:
    first = base.where(F.col(vec_col).isNotNull()).select(F.size(vec_col)).first()
    if first is None:
        raise ValueError("a graph needs at least one vector")
    return first[0]


def _bucket():
    return F.pmod(F.xxhash64("node"), F.lit(BUCKETS)).cast("int")


def _records(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Stored node records from (node, v, code, neighbours) rows and the (node, code) of all nodes."""
    edges = rows.select("node", F.posexplode("neighbours").alias("pos", "dst")).join(codes.select(F.col("node").alias("dst"), F.col("code").alias("c")), "dst")
    lists = edges.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "dst", "c"))).alias("s"))
    lists = lists.select("node", F.col("s.dst").alias("neighbours"), F.flatten("s.c").alias("codes"))
    full = rows.drop("neighbours").join(lists, "node", "left").select(_bucket().alias("bucket"), "node", "v", "code", F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"), F.coalesce("codes", F.array().cast("array<int>")).alias("codes"))
    return stored(full.repartition("bucket").sortWithinPartitions("bucket", "node"), "records", "bucket")


def _entries(nodes: DataFrame, medoids: DataFrame) -> DataFrame:
    """(node, v) where searches start: the shards' medoids."""
    return stored(nodes.join(medoids, "node").select("node", "v"), "entries")
