"""Recall, latency and tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspan.session import work_dir

from .topk import top_by


def recall_at(results: DataFrame, truth: DataFrame, at: tuple[int, ...] = (1, 10, 100), id_col: str = "vec_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, r, recall): share of queries whose true nearest neighbour is among the first r results."""
    first = truth.where("rank = 1").select("qid", F.col(id_col).alias("true_id"))
    groups = results.select(*by).distinct() if by else None
    asked = first if groups is None else first.crossJoin(F.broadcast(groups))
    hit = results.select(*by, "qid", F.col(id_col).alias("true_id"), "rank")
    found = asked.join(hit, [*by, "qid", "true_id"], "left")
    each = found.withColumn("r", F.explode(F.array(*[F.lit(r).cast("bigint") for r in at])))
    return each.groupBy(*by, "r").agg(F.avg(F.when(F.col("rank") <= F.col("r"), 1.0).otherwise(0.0)).alias("recall"))


def k_recall(results: DataFrame, truth: DataFrame, k: int, inactive: DataFrame | None = None, id_col: str = "vec_id") -> DataFrame:
    """(qid, recall in per cent): overlap of the first k results with the first k active true neighbours."""
    active = truth if inactive is None else truth.join(inactive.select(F.col(inactive.columns[0]).alias(id_col)), id_col, "left_anti")
    wanted = top_by(active.drop("rank"), ["qid"], k, ["dist", id_col]).select("qid", id_col)
    got = results.where(F.col("rank") <= k).select("qid", id_col, F.lit(1).alias("hit"))
    return wanted.join(got, ["qid", id_col], "left").groupBy("qid").agg((F.count("hit") * 100.0 / k).alias("recall"))


def others(results: DataFrame, k: int, by: tuple[str, ...] = (), id_col: str = "vec_id") -> DataFrame:
    """Results without each query's own row, ranked anew: at most k a query. Search k + 1 for k."""
    return top_by(results.where(F.col("qid") != F.col(id_col)).drop("rank"), [*by, "qid"], k, ["dist", id_col])


def mean_k_recall(results: DataFrame, truth: DataFrame, k: int, by: tuple[str, ...] = (), id_col: str = "vec_id") -> DataFrame:
    """(by, recall): share of the first k true neighbours, over all queries, that the first k results hold."""
    wanted = truth.where(F.col("rank") <= k).select("qid", id_col)
    wanted = wanted.crossJoin(F.broadcast(results.select(*by).distinct())) if by else wanted
    got = results.where(F.col("rank") <= k).select(*by, "qid", id_col, F.lit(1).alias("hit"))
    return wanted.join(got, [*by, "qid", id_col], "left").groupBy(*by).agg((F.count("hit") / F.count("*")).alias("recall"))


def evaluate_index(search, queries: DataFrame, truth: DataFrame, k: int, settings: list[int], at: tuple[int, ...] = (1, 10, 100), id_col: str = "vec_id") -> DataFrame:
    """(setting, milliseconds a query, qps, r, recall): ``search(queries, k, setting)`` at each setting, against the truth.

    A sweep over nprobe, say. Results are written before they are counted, so that the time is
    that of the search.
    """
    import time

    spark, out = queries.sparkSession, None
    n = max(1, queries.count())
    for setting in settings:
        path = work_dir(spark, "results")
        began = time.perf_counter()
        search(queries, k, setting).write.parquet(path)
        each = 1000 * (time.perf_counter() - began) / n
        recall = recall_at(spark.read.parquet(path), truth, at, id_col)
        one = recall.select(F.lit(setting).cast("bigint").alias("setting"), F.lit(each).alias("milliseconds"), F.lit(1000 / each).alias("qps"), "r", "recall")
        out = one if out is None else out.unionByName(one)
    return out


def nearest_rank(values: DataFrame, value: str, shares: tuple[float, ...] = (0.1, 0.5, 0.9, 0.95, 0.99, 0.999)) -> DataFrame:
    """(p, value): sorted[floor(p * n)], without gathering the values in one place.

    Values are counted, the counts are summed in order, and each share's place is looked up.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("c"))
    spread = counts.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    work_dir(values.sparkSession, "ranges")  # sets a checkpoint folder where the session has none
    spread = spread.checkpoint()  # the ranges must be the same for both uses
    before = spread.groupBy("part").agg(F.sum("c").alias("s")).select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = spread.join(F.broadcast(before), "part").select("value", "c", (F.col("before") + F.sum("c").over(w)).alias("upto"))
    n = counts.agg(F.sum("c").alias("n"))
    places = n.select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.floor(F.lit(p) * F.col("n")).alias("at")) for p in shares])).alias("s")).select("s.*")
    return upto.join(F.broadcast(places), (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c"))).select("p", "value")


def latency_summary(latencies: DataFrame, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """Queries, total, mean, largest, and queries a second of one stream."""
    return latencies.groupBy(*by).agg(F.count(value).alias("queries"), F.sum(value).alias("total_ms"), F.avg(value).alias("mean_ms"), F.max(value).alias("max_ms")).withColumn("qps", F.lit(1000.0) / F.col("mean_ms"))


def pareto(runs: DataFrame, cost: str, gain: str) -> DataFrame:
    """The runs that no cheaper (or equally cheap and better) run reaches."""
    w = Window.orderBy(cost, F.desc(gain)).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("__best", F.max(gain).over(w)).where("__best is null or " + gain + " > __best").drop("__best")


def sampling_rate(target: int, size: Column) -> Column:
    """The rate that takes ``target`` of ``size`` rows, at most 1."""
    return F.least(F.lit(1.0), F.lit(float(target)) / size)
