"""Functions of one vector column, and of vector tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distance import doubles, sq_norm

#: The float32 machine epsilon, added inside the root when normalising.
EPSILON = 1.1920928955078125e-07


def cast_int(v: Column) -> Column:
    """Truncate towards zero."""
    return F.transform(v, lambda x: x.cast("int"))


def widen(v: Column, to: str = "int") -> Column:
    """Integer or byte components as a wider type (int, bigint, float or double)."""
    return v.cast(f"array<{to}>")


def wrap_uint8(v: Column) -> Column:
    """Unsigned 32-bit components as unsigned bytes, modulo 256."""
    return F.transform(v, lambda x: F.pmod(x.cast("bigint"), F.lit(256)).cast("short"))


def quantize_int8(v: Column, bias: float, scale: float) -> Column:
    """(x - bias) * (256 / scale), truncated and clamped to a signed byte."""

    def one(x: Column) -> Column:
        y = (x.cast("double") - bias) * (256.0 / scale)
        return F.least(F.greatest(y, F.lit(-128.0)), F.lit(127.0)).cast("int")

    return F.transform(v, one)


def normalize(v: Column) -> Column:
    """x / sqrt(epsilon + sum of squares)."""
    length = F.sqrt(F.lit(EPSILON) + sq_norm(v))
    return F.transform(doubles(v), lambda x: x / length)


def sparsity(v: Column) -> Column:
    """Share of zero components, in per cent."""
    return F.size(F.filter(v, lambda x: x == 0)) * F.lit(100.0) / F.size(v)


def is_sparse(v: Column) -> Column:
    """More than half of the components are zero."""
    return sparsity(v) > 50


def pad(v: Column, to: int = 8) -> Column:
    """Zeros appended up to a multiple of ``to`` components."""
    return F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), F.pmod(-F.size(v), F.lit(to)).cast("int")))


def long_form(df: DataFrame, id_col: str, vec: Column) -> DataFrame:
    """(id, pos, value): a row per component."""
    return df.select(id_col, F.posexplode(vec).alias("pos", "value")).select(id_col, F.col("pos").cast("bigint").alias("pos"), "value")


def row_slice(df: DataFrame, offset: int, count: int, id_col: str = "vec_id", total: int | None = None) -> DataFrame:
    """Rows [offset, offset + count) by ordinal id; a filter that Parquet and, by ``formats.read_vectors``, vector files push down to the scan."""
    if offset < 0 or count < 0 or (total is not None and offset + count > total):
        raise ValueError(f"rows {offset} to {offset + count} lie outside the table")
    return df.where((F.col(id_col) >= offset) & (F.col(id_col) < offset + count))


def dimension(df: DataFrame, vec_col: str = "embedding") -> int:
    """The one dimension of all vectors; an error where they differ."""
    low, high = df.agg(F.min(F.size(vec_col)), F.max(F.size(vec_col))).first()
    if low != high:
        raise ValueError(f"vectors have {low} to {high} components")
    return low or 0


def concat(first: DataFrame, second: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Two vector tables of one dimension, one after the other."""
    a, b = dimension(first, vec_col), dimension(second, vec_col)
    if a and b and a != b:
        raise ValueError(f"dimensions {a} and {b} differ")
    return first.unionByName(second)


def checked(v: Column, dim: int) -> Column:
    """The vector, or an error where its length is wrong or a component is null."""
    ok = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull())
    return F.when(v.isNull(), v).when(ok, v).otherwise(F.raise_error(F.lit(f"not a vector of {dim} components")))


def bernoulli(df: DataFrame, rate: float, seed: int = 0, id_col: str | None = None) -> DataFrame:
    """Keep rows with probability ``rate``; by a hash of the id where one is named, so that it repeats."""
    if id_col is None:
        return df.sample(fraction=rate, seed=seed)
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_000)) < int(rate * 1_000_000))


def synthetic(spark, rows: int, dim: int, seed: int = 1234) -> DataFrame:
    """Uniform vectors, the first component raised by row / 1000."""
    at = [F.rand(seed + k).cast("float") for k in range(dim)]
    at[0] = (at[0] + F.col("vec_id") / 1000.0).cast("float")
    return spark.range(rows).withColumnRenamed("id", "vec_id").select("vec_id", F.array(*at).alias("embedding"))


def truth_name(count: int) -> str:
    """Short form of a row count as used in file names: 1M, 200M, 1B, 10k."""
    for unit, size in (("B", 10**9), ("M", 10**6), ("k", 10**3)):
        if count >= size and count % size == 0:
            return f"{count // size}{unit}"
    return str(count)


def throughput(latency_ms: Column) -> Column:
    """Queries per second of one stream."""
    return F.lit(1000.0) / latency_ms


def random_values(df: DataFrame, vec_col: str = "embedding", seed: int = 0) -> DataFrame:
    """The table with its vectors' components replaced by uniform values that repeat for a seed."""
    draw = F.transform(vec_col, lambda x, i: (F.pmod(F.xxhash64(F.lit(seed), F.col(vec_col), i), F.lit(1 << 24)) / float(1 << 24)).cast("float"))
    return df.withColumn(vec_col, draw)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeated rows as often in each."""
    cols = sorted(a.columns)
    if cols != sorted(b.columns):
        return False
    x, y = a.select(*cols), b.select(*cols)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
