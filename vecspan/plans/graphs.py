"""Registered queries of pruned proximity graphs and of shards within a budget."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.functions.distance import sql
from vecspan.operators import evaluate, graph, proximity, tree
from vecspan.operators.topk import exact_knn, rank_small
from vecspan.session import work_dir

from .catalogue import _BASE, _CT, K, _with, asked, base, query, trained

#: Neighbours a node, nodes of a beam, nodes a step, and records that are cached at most.
DEGREE, WIDTH, STEP, CACHED = 16, 32, 8, 1024
#: Rows of a shard in the query of shards.
SHARD_ROWS = 40


def built(spark: SparkSession, b: DataFrame) -> proximity.ProximityGraph:
    """A graph that was built, saved and loaded."""
    path = work_dir(spark, "proximity")
    proximity.ProximityGraph.build(b, DEGREE, WIDTH).save(path)
    return proximity.ProximityGraph.load(spark, path)


def job_count(spark: SparkSession, run) -> int:
    """How many Spark jobs a function starts from this thread."""
    group, sc = f"count-{uuid.uuid4().hex}", spark.sparkContext
    before = {p: sc.getLocalProperty(p) for p in ("spark.jobGroup.id", "spark.job.description")}
    sc.setJobGroup(group, "counted")
    try:
        run()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        for name, value in before.items():
            sc.setLocalProperty(name, value)


@query(f"SELECT count(*) AS nodes, count(DISTINCT vec_id) AS distinct_nodes, true AS within_degree, 0::BIGINT AS loops, 0::BIGINT AS repeated, 0::BIGINT AS dangling, 0::BIGINT AS unreachable FROM embeddings")
def graph_build_pruned(spark, sf_dir):
    """What must hold of the graph: every row a node, at most DEGREE neighbours, all of them other nodes, and every node in reach of a start."""
    g = built(spark, base(spark, sf_dir))
    edges = g.nodes.select("node", F.explode("neighbours").alias("dst"))
    dangling = edges.join(g.nodes.select(F.col("node").alias("dst")), "dst", "left_anti").count()
    reached = _reached(g)
    n = g.nodes.agg(F.count("*").alias("nodes"), F.count_distinct("node").alias("distinct_nodes"), (F.max(F.size("neighbours")) <= DEGREE).alias("within_degree"), F.sum(F.exists("neighbours", lambda x: x == F.col("node")).cast("bigint")).alias("loops"), F.sum((F.size("neighbours") > F.size(F.array_distinct("neighbours"))).cast("bigint")).alias("repeated"))
    return n.select("*", F.lit(dangling).cast("bigint").alias("dangling"), (F.col("nodes") - reached).alias("unreachable"))


def _reached(g: proximity.ProximityGraph) -> int:
    """Nodes on some path from a start."""
    seen = fresh = proximity.stored(g.entries.select("node").distinct(), "reached")
    total = seen.count()
    while True:
        around = g.nodes.join(fresh, "node").select(F.explode("neighbours").alias("node")).distinct()
        fresh = proximity.stored(around.join(seen, "node", "left_anti"), "fresh")
        more = fresh.count()
        if not more:
            return total
        total += more
        seen = seen.unionByName(fresh)


@query()
def graph_disk_search(spark, sf_dir):
    """Search of a loaded graph: codes steer, whole vectors rank, cached levels need no job."""
    b = base(spark, sf_dir)
    return built(spark, b).with_cache(CACHED).search(asked(b), K, WIDTH, STEP)


@query()
def graph_disk_recall(spark, sf_dir):
    """The beam over the graph's edges and the vectors beside the records, without and with a cache: 10-recall, distances and vectors read a query, steps, and jobs of the query set."""
    b = base(spark, sf_dir)
    q = asked(b)
    truth = evaluate.others(exact_knn(b, q, K + 1), K)
    g = built(spark, b)
    cached = g.with_cache(CACHED)
    edges = g.nodes.select(F.col("node").alias("src"), F.explode("neighbours").alias("dst"))
    start = rank_small(q, g.entries, 8, "l2_sq", "qid", ref_id="node", ref_vec="v").select("qid", "node")
    queries, rows = max(1, q.count()), []

    def add(way: str, search, numbers) -> None:
        found = []
        jobs = job_count(spark, lambda: found.append(search()))
        recall = evaluate.mean_k_recall(evaluate.others(found[0], K), truth, K).first()
        distances, read, steps, kept = numbers()
        rows.append((way, round(float(recall.recall if recall else 1.0), 6), distances / queries, read / queries, steps, jobs, kept))

    plain: dict = {}
    add("edges", lambda: graph.beam_search(edges, b, q, K + 1, WIDTH, entry=start, stats=plain), lambda: (plain["distances"], plain["distances"], plain["hops"], 0))
    for way, one in (("records", g), ("cached", cached)):
        add(way, lambda one=one: one.search(q, K + 1, WIDTH, STEP), lambda one=one: (one.stats["code_distances"] + one.stats["vectors_read"], one.stats["vectors_read"], one.stats["steps"], one.stats.get("cached", 0)))
    return spark.createDataFrame(rows, "way string, recall double, distances double, vectors_read double, steps bigint, jobs bigint, cached bigint")


@query()
def graph_after_updates(spark, sf_dir):
    """10-recall of a new graph, of one that lost a twentieth of its rows and got them back, twice, and of one that lost a tenth for good."""
    b = base(spark, sf_dir)
    q = asked(b)
    g = built(spark, b)
    out = []

    def add(what: str, rows: DataFrame) -> None:
        truth = evaluate.others(exact_knn(rows, q, K + 1), K)
        recall = evaluate.mean_k_recall(evaluate.others(g.search(q, K + 1, WIDTH, STEP), K), truth, K).first()
        out.append((what, g.nodes.count(), round(float(recall.recall if recall else 1.0), 6)))

    add("new", b)
    for cycle in range(2):
        part = b.where(F.pmod(F.xxhash64(F.lit(cycle), "vec_id"), F.lit(20)) == 0)
        g = g.delete(part.select("vec_id")).insert(part)
    add("two cycles", b)
    gone = F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.lit(10)) == 0
    g = g.delete(b.where(gone).select("vec_id"))
    add("a tenth gone", b.where(~gone))
    return spark.createDataFrame(out, "state string, nodes bigint, recall double")


@query(
    _with(
        _BASE, _CT,
        f"d AS (SELECT vec_id, cluster_id, {sql('l2_sq', 'e', 'ce')} AS dist FROM base, c), two AS (SELECT vec_id, cluster_id FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster_id) <= 2)",
        f"cut AS (SELECT cluster_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id) - 1) // {SHARD_ROWS} AS piece, vec_id FROM two)",
    )
    + "SELECT cluster_id, piece::BIGINT AS piece, count(*) AS size, min(vec_id) AS first, max(vec_id) AS last FROM cut GROUP BY cluster_id, piece"
)
def shards_within_budget(spark, sf_dir):
    """Each row in its two nearest shards, and shards cut so that none has over SHARD_ROWS rows."""
    b = base(spark, sf_dir)
    near = rank_small(b, trained(b), 2).select("vec_id", "cluster_id")
    cut = proximity.cut_shards(near, SHARD_ROWS).select("cluster_id", (F.col("shard") % (1 << 24)).alias("piece"), "vec_id")
    return cut.groupBy("cluster_id", "piece").agg(F.count("*").alias("size"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


#: Rows of a leaf, children of a node, and rows checked, of the balanced tree.
LEAF, BRANCH, CHECKS = 32, 4, 256


@query("SELECT count(*) AS rows, true AS even FROM embeddings")
def balanced_tree_leaves(spark, sf_dir):
    """All rows are in leaves, the largest of which has at most twice the rows of the smallest."""
    sizes = tree.BalancedTree.build(base(spark, sf_dir), LEAF, BRANCH).leaves()
    return sizes.agg(F.sum("size").alias("rows"), (F.max("size") <= 2 * F.min("size")).alias("even"))


@query()
def balanced_tree_search(spark, sf_dir):
    """Leaves by a queue until CHECKS rows have been checked."""
    b = base(spark, sf_dir)
    return tree.BalancedTree.build(b, LEAF, BRANCH).search(asked(b), K, CHECKS)


@query()
def balanced_tree_recall(spark, sf_dir):
    """10-recall by the rows checked: of leaves alone, and of a graph search that starts from the tree and ends after so many distances."""
    b = base(spark, sf_dir)
    q = asked(b)
    truth = proximity.stored(evaluate.others(exact_knn(b, q, K + 1), K), "truth")
    t = tree.BalancedTree.build(b, LEAF, BRANCH)
    path = work_dir(spark, "graph")
    graph.both_ways(built(spark, b).nodes.select(F.col("node").alias("src"), F.explode("neighbours").alias("dst"))).write.parquet(path)
    edges, out = spark.read.parquet(path), None
    start, steps = t.entries(q), [128, 256, 512, 1024]
    walked = proximity.stored(graph.beam_search(edges, b, q, K + 1, WIDTH, entry=start, checks=steps), "walked")
    for checks in steps:
        for way, found in (("tree", t.search(q, K + 1, checks)), ("tree and graph", walked.where(F.col("checks") == checks).drop("checks"))):
            one = evaluate.mean_k_recall(evaluate.others(found, K), truth, K).select(F.lit(way).alias("way"), F.lit(checks).cast("bigint").alias("checks"), F.round("recall", 6).alias("recall"))
            out = one if out is None else out.unionByName(one)
    return out
