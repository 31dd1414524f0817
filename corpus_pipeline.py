"""A corpus pipeline: each stage calls one operator on all that the stage before it kept.

Rows that repeat a document's id together with its text are that same document and stay or go
together; two texts under one id are two documents, as are two texts without an id. Nulls, empty tables and further columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.llm import bpe, exact_dedup, langid, mixing, ngram_join
from vecspan.llm.common import ascii_lower, placed, stored, table

#: Dropped documents that may be broadcast; beyond it they are joined by shuffle.
_MOST_IDS = 200_000


def _without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``dropped``."""
    dropped = stored(dropped.select(key).distinct())
    return docs.join(F.broadcast(dropped) if dropped.count() <= _MOST_IDS else dropped, key, "left_anti")


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _document(doc_id: str, digest: Column | str) -> Column:
    """A document's id, or null, and the digest of its text as one key."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), digest)


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds key to doc_id and text, which no two documents share: doc_id, or where ids are null or on two texts, text that sorts by id, nulls last.

    Whole numbers sort by value, ids of other types by their text.
    """
    rows = docs.select("doc_id", F.unhex(_digest(F.col("text"))).alias("d"))
    each = rows.groupBy("doc_id").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    if each.where("doc_id is null or low <> high").isEmpty():
        return docs.withColumn("key", F.col("doc_id"))
    by_id = F.col("doc_id").cast("string")
    if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        # Flipping the sign bit makes hexadecimal digits sort as the numbers do.
        by_id = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    # After the id comes what sorts before any further character of a longer one.
    return docs.withColumn("key", F.concat(F.coalesce(F.concat(F.lit("0"), by_id), F.lit("1")), F.lit("\u0000"), _digest(F.col("text"))))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus's own language labels have taught."""
    at, of = placed(docs)
    model = langid.fit(docs)
    found = langid.identify(at, model, id_col=of("doc_id"), text_col=of("text"), keep=at.columns, names=("lang", "score", "bits"))
    return found.where("lang <> 'und' and score >= 0.5").select(*at.columns).toDF(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; one without an id stays where no copy has one."""
    at, of = placed(docs)
    dropped = exact_dedup.exact_dedup(docs).where("not kept").select(_document("doc_id", "text_sha256").alias("key"))
    keyed = at.withColumn("key", _document(of("doc_id"), _digest(ascii_lower(F.col(of("text"))))))
    return _without(keyed, dropped, "key").select(*at.columns).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id, or else one without an id."""
    at, of = placed(docs)
    keyed = _keyed(at.withColumns({"doc_id": F.col(of("doc_id")), "text": F.col(of("text"))}))
    links = ngram_join.similar_texts(keyed, id_col="key").where("doc_id <> component_id")
    return _without(keyed, links.select(F.col("doc_id").alias("key")), "key").select(*at.columns).toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources evened out as far as reading a document 1.25 times allows; every document stays."""
    return mixing.mix(docs, docs.columns, repeats=1.25, budget="cover", order=False)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to."""
    return bpe.encode_texts(docs, ("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("mixing", mixture),
    ("bpe", tokens),
]

#: SQL can't express the language model, the join or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
