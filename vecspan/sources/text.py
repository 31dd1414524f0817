"""Text formats: inverted lists, TSV, tab-and-comma vectors, generic CSV, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The header of the log files, so that files of other drivers can be read and continued.
LOG_COLUMNS = ("dataset", "nprobe", "index_type", "processor", "search_latency/ms", "throughput/QPS", "R_1", "R_10", "R_100", "cpu_usage/%")


def numbered(rows: DataFrame, name: str = "__row") -> DataFrame:
    """Adds the row's place in its file, or in a folder's files in the order of their names, from 0.

    ``rows`` comes straight from a file source. Rows are counted by file and split, a row each,
    and a split's rows follow all those of the splits before it.
    """
    at = [F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m")]
    each = rows.select("*", *at)
    splits = each.groupBy("__f", "__b").agg(F.min("__m").alias("__low"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__f", "__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("__f", "__b", (F.coalesce(before, F.lit(0)) - F.col("__low")).alias("__start"))
    return each.join(starts, ["__f", "__b"]).select(*rows.columns, (F.col("__start") + F.col("__m")).cast("bigint").alias(name))


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, vec_id) from a file whose line i holds the ids of cluster i, joined by commas.

    Lines have no key of their own and are numbered by split; blank lines are clusters without
    rows and keep the others' numbers.
    """
    ids = numbered(spark.read.text(path), "cluster_id").select("cluster_id", F.explode(F.split("value", ",")).alias("id"))
    return ids.select("cluster_id", F.trim("id").alias("id")).where("id <> ''").select("cluster_id", F.col("id").cast("bigint").alias("vec_id"))


def write_lists(lists: DataFrame, nlist: int, path: str) -> None:
    """(cluster_id, ids) as nlist lines in part files whose names follow the numbers; clusters without rows are blank lines."""
    spark = lists.sparkSession
    full = spark.range(nlist).withColumnRenamed("id", "cluster_id").join(lists, "cluster_id", "left")
    full.select("cluster_id", F.coalesce("ids", F.lit("")).alias("value")).repartitionByRange("cluster_id").sortWithinPartitions("cluster_id").select("value").write.mode("overwrite").text(path)


def read_tsv(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(vec_id, embedding) of lines of white-space separated numbers, vec_id being the line's place; another number of fields is an error.

    Blank lines are left out, and numbered like others."""
    v = F.split(F.trim("value"), r"\s+").cast("array<float>")
    ok = F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} fields: "), F.substring("value", 1, 80))))
    return numbered(spark.read.text(path), "vec_id").where(F.trim("value") != "").select("vec_id", ok.alias("embedding"))


def write_tsv(df: DataFrame, path: str, vec_col: str = "embedding", mode: str = "overwrite", id_col: str | None = None) -> None:
    """A vector a line; in the order of an id, where one is named."""
    df = df if id_col is None else df.repartitionByRange(id_col).sortWithinPartitions(id_col)
    df.select(F.array_join(F.transform(vec_col, lambda x: x.cast("string")), "\t").alias("value")).write.mode(mode).text(path)


def read_keyed_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(key, meta, embedding) of tab-separated lines whose last of one to three fields is a comma-separated vector."""
    f = F.split("value", "\t")
    n = F.size(f)
    v = F.split(F.trim(F.element_at(f, F.least(n, F.lit(3)))), ",").cast("array<float>")
    ok = F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} components: "), F.substring("value", 1, 80))))
    return spark.read.text(path).where("value <> ''").select(F.when(n > 1, f[0]).alias("key"), F.when(n > 2, F.get(f, F.lit(1))).alias("meta"), ok.alias("embedding"))


def append_log(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Append measurements, LOG_COLUMNS each, to a CSV log."""
    schema = ", ".join(f"`{c}` {'string' if c in ('dataset', 'index_type', 'processor') else 'double'}" for c in LOG_COLUMNS)
    spark.createDataFrame([tuple(float(v) if isinstance(v, int) else v for v in r) for r in rows], schema).coalesce(1).write.mode("append").option("header", True).csv(path)


class CsvDocument:
    """A CSV table with access to rows, columns and cells; changes give a new document."""

    def __init__(self, df: DataFrame, key: str = "__row"):
        self.df, self.key = df, key

    @staticmethod
    def load(spark: SparkSession, path: str, header: bool = True, sep: str = ",", schema: str | None = None) -> CsvDocument:
        reader = spark.read.option("header", header).option("sep", sep)
        return CsvDocument(numbered((reader.schema(schema) if schema else reader).csv(path)))

    @property
    def names(self) -> list[str]:
        return [c for c in self.df.columns if c != self.key]

    def column(self, at: int | str) -> DataFrame:
        return self.df.select(self.key, self.names[at] if isinstance(at, int) else at)

    def row(self, at: int) -> DataFrame:
        return self.df.where(F.col(self.key) == at).select(*self.names)

    def cell(self, column: int | str, row: int):
        found = self.column(column).where(F.col(self.key) == row).first()
        return None if found is None else found[1]

    def set_cell(self, column: str, row: int, value) -> CsvDocument:
        return CsvDocument(self.df.withColumn(column, F.when(F.col(self.key) == row, F.lit(value)).otherwise(F.col(column))), self.key)

    def set_column(self, name: str, value) -> CsvDocument:
        return CsvDocument(self.df.withColumn(name, value), self.key)

    def remove_column(self, name: str) -> CsvDocument:
        return CsvDocument(self.df.drop(name), self.key)

    def remove_row(self, at: int) -> CsvDocument:
        """Without the row; those after it move up."""
        k = F.col(self.key)
        return CsvDocument(self.df.where(k != at).withColumn(self.key, F.when(k > at, k - 1).otherwise(k)), self.key)

    def insert_row(self, at: int, values: tuple) -> CsvDocument:
        """A row in the place ``at``; those from there on move down."""
        k = F.col(self.key)
        moved = self.df.withColumn(self.key, F.when(k >= at, k + 1).otherwise(k))
        names = self.names
        new = self.df.sparkSession.range(1).select(F.lit(at).cast("bigint").alias(self.key), *[F.lit(v).cast(self.df.schema[c].dataType).alias(c) for c, v in zip(names, values, strict=True)])
        return CsvDocument(moved.unionByName(new), self.key)

    def insert_column(self, at: int, name: str, value) -> CsvDocument:
        """A column in the place ``at`` among the names."""
        names = self.names
        return CsvDocument(self.df.withColumn(name, value).select(*names[:at], name, *names[at:], self.key), self.key)

    def append(self, other: CsvDocument) -> CsvDocument:
        """The other document's rows after these."""
        last = self.df.agg(F.coalesce(F.max(self.key), F.lit(-1))).first()[0]
        more = other.df.select(*other.names, (F.col(other.key) + F.lit(last + 1)).alias(self.key))
        return CsvDocument(self.df.unionByName(more), self.key)

    def save(self, path: str, sep: str = ",") -> None:
        self.df.orderBy(self.key).select(*self.names).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_tags(tags: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A tag a line."""
    tags.select(F.col(tags.columns[0]).cast("string").alias("value")).write.mode(mode).text(path)


def write_results(results: DataFrame, path: str, k: int) -> None:
    """(qid, rank, id, dist) as a line a query: id and distance of each of the k ranks in turn, tab-separated."""
    id_col = next(c for c in results.columns if c not in ("qid", "rank", "dist"))
    pair = F.struct("rank", F.col(id_col).cast("string").alias("id"), F.col("dist").cast("string").alias("d"))
    lines = results.where(F.col("rank") <= k).groupBy("qid").agg(F.sort_array(F.collect_list(pair)).alias("r"))
    text = F.array_join(F.flatten(F.transform("r", lambda x: F.array(x["id"], x["d"]))), "\t")
    lines.repartitionByRange("qid").sortWithinPartitions("qid").select(text.alias("value")).write.mode("overwrite").text(path)
