"""Nearest-neighbour graphs and beam search. An approximation of graph indexes, not one of their own formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspan.functions import distance
from vecspan.session import work_dir

from .ivf import assign, candidates, probe
from .topk import exact_knn, merge_topk, top_by

#: Rows of a beam (16 bytes; queries with their vectors) that may be broadcast; more are joined by shuffle.
MOST_FRONTIER = 100_000


def knn_graph(base: DataFrame, degree: int, metric: str = "l2_sq", centroids: DataFrame | None = None, nprobe: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(src, rank, dst, dist): each row's ``degree`` nearest others.

    Exact without centroids (block by block); with them, neighbours are sought in the probed
    clusters only, so that the work doesn't grow with the square of the rows.
    """
    queries = base.select(F.col(id_col).alias("qid"), F.col(vec_col))
    if centroids is None:
        found = exact_knn(base, queries, degree + 1, metric, id_col=id_col, vec_col=vec_col)
    else:
        lists = assign(base, centroids, metric, id_col, vec_col, keep=[id_col, vec_col])
        found = candidates(lists, queries, probe(queries, centroids, nprobe, metric, vec_col), metric, id_col, vec_col)
    others = found.where(F.col("qid") != F.col(id_col)).select("qid", id_col, "dist")
    return merge_topk(others, degree, id_col).select(F.col("qid").alias("src"), "rank", F.col(id_col).alias("dst"), "dist")


def merge_graphs(parts: list[DataFrame], degree: int) -> DataFrame:
    """Edges of shards as one graph of at most ``degree`` edges a node."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    both = both.groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    return top_by(both, ["src"], degree, ["dist", "dst"]).select("src", "rank", "dst", "dist")


def overlapping_shards(base: DataFrame, centroids: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, shard, rank): each row in its k nearest shards."""
    from .topk import rank_small

    return rank_small(base, centroids, k, "l2_sq", id_col, vec_col).select(id_col, F.col("cluster_id").alias("shard"), "rank")


def search_sweep(graph: DataFrame, base: DataFrame, queries: DataFrame, truth: DataFrame, k: int, widths: list[int], metric: str = "l2_sq", id_col: str = "vec_id", vec_col: str = "embedding", centroids: DataFrame | None = None, warm_up: bool = True) -> DataFrame:
    """(width, recall, milliseconds) of the beam search at several widths; ``truth`` has the k nearest of each query.

    With ``warm_up`` the first width is searched once before, uncounted.
    """
    import time

    from .evaluate import mean_k_recall

    rows = []
    for width in [*widths[: 1 if warm_up else 0], *widths]:
        began = time.perf_counter()
        found = beam_search(graph, base, queries, k, width, metric=metric, id_col=id_col, vec_col=vec_col, centroids=centroids).checkpoint()
        took = 1000 * (time.perf_counter() - began)
        recall = mean_k_recall(found, truth, k, id_col=id_col).first().recall
        rows.append((width, float(recall), took))
    return base.sparkSession.createDataFrame(rows[1 if warm_up else 0 :], "width bigint, recall double, milliseconds double")


def tune_width(sweep: DataFrame, least: float) -> int | None:
    """The least width of a sweep with a recall of ``least``; None where no width has it."""
    return sweep.where(F.col("recall") >= least).agg(F.min("width")).first()[0]


def both_ways(graph: DataFrame) -> DataFrame:
    """(src, dst): edges with their reverses, so that a row in no other's list is reached too."""
    return graph.select("src", "dst").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def entry_points(base: DataFrame, centroids: DataFrame, queries: DataFrame, starts: int, metric: str = "l2_sq", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(qid, node): for each query the row nearest to each of its ``starts`` nearest centroids."""
    near = exact_knn(base, centroids.select(F.col("cluster_id").alias("qid"), F.col("centroid").alias(vec_col)), 1, metric, id_col=id_col, vec_col=vec_col)
    pivots = near.select(F.col("qid").alias("cluster_id"), F.col(id_col).alias("node"))
    return probe(queries, centroids, starts, metric, vec_col).join(F.broadcast(pivots), "cluster_id").select("qid", "node").distinct()


def beam_search(graph: DataFrame, base: DataFrame, queries: DataFrame, k: int, width: int, hops: int | None = None, starts: int = 8, metric: str = "l2_sq", id_col: str = "vec_id", vec_col: str = "embedding", centroids: DataFrame | None = None, entry: DataFrame | None = None, checks: int | list[int] | None = None, stats: dict | None = None) -> DataFrame:
    """Follow edges until no beam, the ``width`` best rows seen for a query, changes.

    ``hops`` ends it earlier. It starts from the rows nearest to a query's ``starts`` nearest
    centroids, or without centroids from the first rows; ``entry`` (qid, node) names other ones, a
    cache of nodes near the middle, say. A hop joins the rows that are new in the beam with the
    edge list and the vectors. The beam has ``width`` rows a query and is checkpointed; what is
    new in it and its neighbours are broadcast up to MOST_FRONTIER rows, so that neither edges nor
    vectors are shuffled, and joined by shuffle beyond. With ``checks``, a query ends after the hop
    in which so many distances or more have been found for it; with a list of them, one search gives the result
    of each, with the number in a column ``checks``. width must be at least k. ``graph`` is read
    once a hop, so it had better be a table. ``stats`` gets the number of hops and of distances found,
    each of which has read a vector.
    """
    if width < k:
        raise ValueError("width must be at least k")
    measure = distance.metric(metric)
    work_dir(base.sparkSession, "beam")  # sets a checkpoint folder where the session has none
    q = queries.select("qid", distance.doubles(F.col(vec_col)).alias("q"))
    vec = base.select(F.col(id_col).alias("node"), distance.doubles(F.col(vec_col)).alias("v"))
    if entry is not None:
        first = entry.select("qid", "node").distinct()
    elif centroids is None:
        first = q.select("qid").crossJoin(F.broadcast(vec.select("node").orderBy("node").limit(starts)))
    else:
        first = entry_points(base, centroids, queries, starts, metric, id_col, vec_col)

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.limit(MOST_FRONTIER + 1).count() <= MOST_FRONTIER else df

    def measured(nodes: DataFrame) -> DataFrame:
        nodes = nodes.checkpoint()
        return vec.join(small(nodes), "node").join(small(q), "qid").select("qid", "node", measure(F.col("q"), F.col("v")).alias("dist"), F.lit(True).alias("fresh"))

    beam = top_by(measured(first), ["qid"], width, ["dist", "node"]).drop("rank").checkpoint()
    hop, spent = 0, beam.groupBy("qid").agg(F.count("*").alias("n"))
    limits = sorted(set(checks)) if isinstance(checks, list) else []
    checks, ended = (limits[-1] if limits else checks), []
    while (hops is None or hop < hops) and not beam.where("fresh").isEmpty():
        step = graph.select(F.col("src").alias("node"), "dst").join(small(beam.where("fresh").select("qid", "node")), "node").select("qid", F.col("dst").alias("node")).distinct()
        new = measured(step.join(beam.select("qid", "node"), ["qid", "node"], "left_anti"))
        if checks is not None or stats is not None:
            new, before = new.checkpoint(), spent
            spent = spent.unionByName(new.groupBy("qid").agg(F.count("*").alias("n"))).groupBy("qid").agg(F.sum("n").alias("n")).checkpoint()
        if checks is not None:
            new = new.join(spent.withColumnRenamed("n", "spent"), "qid").withColumn("fresh", F.col("spent") < checks).drop("spent")
        beam = top_by(beam.withColumn("fresh", F.lit(False)).unionByName(new), ["qid"], width, ["dist", "node"]).drop("rank").checkpoint()
        if limits:  # the beams of queries that end here for some of the limits
            over = F.array_compact(F.array(*[F.when((F.col("n") >= c) & ((F.col("was") < c) | F.lit(hop == 0)), c) for c in limits]))
            passed = spent.join(before.withColumnRenamed("n", "was"), "qid").select("qid", F.explode(over.cast("array<bigint>")).alias("checks"))
            ended.append(beam.drop("fresh").join(passed, "qid").checkpoint())
        hop += 1
    if stats is not None:
        stats.update(hops=hop, distances=spent.agg(F.sum("n")).first()[0] or 0)
    if limits:
        done = reduce(DataFrame.unionByName, ended, beam.drop("fresh").withColumn("checks", F.lit(0).cast("bigint")).limit(0))
        each = F.array(*[F.lit(c).cast("bigint") for c in limits])
        rest = beam.drop("fresh").withColumn("checks", F.explode(each)).join(done.select("qid", "checks").distinct(), ["qid", "checks"], "left_anti")
        every = done.unionByName(rest).withColumnRenamed("node", id_col)
        return top_by(every, ["checks", "qid"], k, ["dist", id_col]).select("checks", "qid", "rank", id_col, "dist")
    return merge_topk(beam.drop("fresh").withColumnRenamed("node", id_col), k, id_col)
