"""Language ID, toxicity and the tokenizer."""

import hashlib
import math

import numpy as np
import pytest

from vecspan.llm import bpe, langid, registry, toxicity
from vecspan.llm.common import train_side

SF = "/root/testdata/sf0.01"


def test_code_lengths_are_exact():
    """Tabulated code lengths against a walk through the counts, byte by byte."""
    texts = {"a": [b"abracadabra abc"], "b": [b"banana bandana", b"ban"]}
    m = langid.ByteTrees(texts)

    def bits(text: bytes, lang: str) -> float:
        raw = (b"\n\n\n" + b"\n\n\n".join(texts[lang])).lower()
        counts = {}
        for order in range(4):
            for i in range(len(raw) - order):
                counts.setdefault(raw[i : i + order], {}).setdefault(raw[i + order], 0)
                counts[raw[i : i + order]][raw[i + order]] += 1
        total, s = 0.0, b"\n\n\n" + text.lower()
        for i in range(3, len(s)):
            cost = 8.0
            done = False
            esc = 0.0
            for order in (3, 2, 1, 0):
                c = counts.get(s[i - order : i])
                if c is None:
                    continue
                t, q = sum(c.values()), len(c)
                if s[i] in c:
                    total += esc - math.log2(c[s[i]] / (t + q))
                    done = True
                    break
                esc -= math.log2(q / (t + q))
            if not done:
                total += esc + cost
        return total

    tests = [b"banana", b"", b"zebra abc", b"A", b"xy"]
    data, off = np.frombuffer(b"".join(tests), np.uint8), np.cumsum([0, *map(len, tests)])
    got = m.bits(data, off)
    for i, t in enumerate(tests):
        for x, lang in enumerate(m.langs):
            assert got[i, x] == pytest.approx(bits(t, lang), abs=1e-3)
    long = np.frombuffer(b"ban" * 400_000, np.uint8)
    one = m.bits(long, np.array([0, len(long)]))
    assert one[0, 1] == pytest.approx(m.bits(long[:300_000], np.array([0, 300_000]))[0, 1] * 4, rel=1e-3)


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = registry.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_cases(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    got = {r.doc_id: r for r in langid.identify(odd_docs, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 12)] == ["und"] * 4 and got[1].score == 0
    assert got[10].lang_pred == "fr"
    none = langid.fit(no_docs)
    assert none.langs == [] and langid.identify(no_docs, none).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs, none).collect()} == {"und"}


def test_held_out_toxicity(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = registry.op5_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in got if r.toxic == 1]
    clean = [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_toxicity_query_by_hand(spark):
    """Every score of the query against a plain loop over all rows: the training rows, their words, and the sum of the weights."""
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5:
            labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.toxic)
    rows = [(docs[d], y) for d, y in sorted(labels.items()) if docs.get(d) is not None and len(docs[d].encode()) <= 1 << 15]
    model = toxicity.train(rows)
    got = {r.doc_id: r for r in registry.op5_toxicity(spark, SF).collect()}
    assert set(got) == set(docs) and sum(labels.values()) > 5
    for d, text in docs.items():
        z = model.bias + sum(model.weights.get(f, 0.0) for w in toxicity.words_of(text) for f in {w, *(w[:k] + "*" for k in (4, 5) if len(w) > k)})
        assert got[d].score == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, z)))), abs=1e-6)
        assert got[d].predicted == int(got[d].score >= 0.5) and got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)


def test_languages_beyond_the_rows(spark):
    df = spark.createDataFrame([(i, f"l{i}", "some text") for i in range(6)], "doc_id long, lang string, text string")
    assert len(langid.fit(df, most_rows=6).langs) == 6
    with pytest.raises(ValueError, match="over 5"):
        langid.fit(df, most_rows=5)


def test_counterfactuals_even_out_identity_terms():
    """A group named in toxic texts only: the penalty takes the blame off its name."""
    rows = [(f"the muslim said hello {i % 7}", 0) for i in range(4)] + [(f"the muslim is awful trash word{i % 5}", 1) for i in range(40)]
    rows += [(f"the christian said hello {i % 7}", 0) for i in range(60)] + [(f"they talk about word{i % 5} trees", 0) for i in range(60)]
    plain, fair = toxicity.train(rows, penalty=0.0), toxicity.train(rows, penalty=50.0)
    gap = lambda m: abs(m.value("muslim") - m.value("christian"))
    assert gap(fair) < 0.25 * gap(plain)
    assert fair.value("awful") + fair.value("trash") > 0
    assert list(toxicity.swaps({"muslim", "x"})) == [{"christian", "x"}]


def test_toxicity_cases(spark, odd_docs, no_docs):
    model = toxicity.train([("bad awful", 1), ("good fine", 0)] * 5)
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.train([]).weights == {} and toxicity.train([("x", 1)]).bias > 0


def test_tokenizer_equals_the_library(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(-1, "a<|endoftext|>B<|startoftext|>"), (-2, "ΑΣ İstanbul ﬁ x\x85y z don't I'LL 12½"), (-3, "a" * 3000), (-4, "abcdefghij" * 2000), (-5, "ab" * 4096 + "\U0001f600" * 300)]
    both = docs.unionByName(odd_docs.select("doc_id", "text")).unionByName(spark.createDataFrame(extra, docs.schema))
    want = sorted((r.doc_id, *_library(lib, r.text or "")) for r in both.collect())
    got = sorted(map(tuple, bpe.encode_texts(both, ("n_tokens", "ids_sha256", "decoded_sha256")).collect()))
    assert got == want
    assert bpe.encode_texts(no_docs).count() == 0


def _library(lib, text):
    ids = lib.encode(text, add_special_tokens=False).ids
    packed = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_training_rows(spark, odd_docs):
    import zlib

    for r in odd_docs.select("doc_id", train_side().alias("t")).collect():
        assert r.t == (zlib.crc32(str(r.doc_id).encode()) % 5 != 0)
