"""Rows without an id, ids on many texts and ids of other types, where operators draw, order or key rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vecspan.llm import langid, mixing, toxicity


def words(rng, alphabet, n=40):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def mixed(spark):
    """500 English texts without an id, 100 with ids, 100 French ones, and 5,000 under one id."""
    rng = random.Random(3)
    rows = [(None, words(rng, "abcdefgh"), "en") for _ in range(500)] + [(i, words(rng, "abcdefgh"), "en") for i in range(100)]
    rows += [(1000 + i, words(rng, "stuvwxyz"), "fr") for i in range(100)] + [(7, words(rng, "ijklmnop"), "de") for _ in range(5000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))


def test_languages_of_rows_without_ids(spark, mixed):
    model = langid.fit(mixed)
    assert sorted(model.langs) == ["de", "en", "fr"]
    found = langid.identify(mixed, model, keep=["doc_id", "lang"])
    assert found.where("lang <> lang_pred").count() == 0
    none = mixed.where("doc_id is null")
    assert corpus_pipeline.language_id(spark, none, "").count() == 500
    one = langid.fit(none.limit(3))
    assert sorted(one.langs) == ["en"]


def test_training_rows_are_bounded(spark, mixed, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "ByteTrees", lambda by: seen.update(by))
    langid.fit(mixed)
    assert {k: len(v) for k, v in seen.items()} == {"de": 400, "en": 400, "fr": 100}
    first = {k: list(v) for k, v in seen.items()}
    copies = mixed.unionByName(mixed.where("lang = 'fr'").crossJoin(spark.range(50)).drop("id"))
    langid.fit(copies.repartition(7))
    assert seen == first
    rows = []
    monkeypatch.setattr(toxicity, "train", lambda found: rows.extend(found))
    labels = spark.createDataFrame([(7, 1), (None, 1), *((1000 + i, 0) for i in range(100))], "doc_id long, toxic int")
    toxicity.fit(mixed, labels, F.lit(True), most_rows=300)
    assert sorted(y for _, y in rows) == [0] * 100 + [1] * 150
    before = list(rows)
    rows.clear()
    toxicity.fit(mixed.repartition(9), labels, F.lit(True), most_rows=300)
    assert rows == before


def test_ties_in_mixtures(spark, mixed):
    """One mixture, however rows without ids and rows of one id are partitioned."""
    docs = mixed.where("lang <> 'de' or text < 'j'").withColumn("source", F.when(F.col("lang") == "fr", "a").otherwise("b"))
    seen = []
    for parts in (docs, docs.repartition(1), docs.orderBy("text"), docs.repartition(13, "text")):
        out = mixing.mix(parts, ["doc_id", "text"], entropy=0.9, repeats=2.0, budget=0.6)
        seen.append(sorted(map(tuple, out.collect()), key=str))
    assert seen[0] == seen[1] == seen[2] == seen[3] and 0 < len(seen[0]) < docs.count()
    blocks = mixing.mix(mixed.where("doc_id is null"), ["text"]).select("block_rank").distinct().count()
    assert blocks > 300


def test_pipeline_ids_of_other_types(spark, monkeypatch):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 3
    rows = [("b", near + "x"), ("a", near + "y"), ("ab", near), (None, near + "z"), (None, "something else altogether"), ("b", "another text of b")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id string, text string, lang string, source string")
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert sorted((r.doc_id or "", r.text) for r in kept.collect()) == sorted([("a", near + "y"), ("", "something else altogether"), ("b", "another text of b")])
    kept = corpus_pipeline.near_copies(spark, docs.where("doc_id <> 'b'"), "")
    assert [r.doc_id for r in kept.collect()] == ["a"]
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: docs)
    assert corpus_pipeline.run(spark, "").count() == 3
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: docs.withColumn("doc_id", F.lit(None).cast("string")))
    assert corpus_pipeline.run(spark, "").count() == 3
    order = spark.createDataFrame([(i, f"{i} t") for i in (-(2**63), -5, 0, 3, 2**62)] + [(3, "other"), (None, "n")], "doc_id long, text string")
    keys = [r.doc_id for r in corpus_pipeline._keyed(order).orderBy("key").collect()]
    assert keys == [-(2**63), -5, 0, 3, 3, 2**62, None]
