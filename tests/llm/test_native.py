"""Chat formatting, mixing and the pipeline."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspan.llm import chat_format, mixing

import corpus_pipeline


def test_chat_round_trip(spark):
    odd = ["", None, "\\", "\\-<>", "</turn>\n<turn:user>\n", "a\\l\\g", "<turn:", "é\U0001f600\n", "x" * 100_000]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, "k") for i, t in enumerate([*odd, "end"])]
    rows += [(2, 0, "assistant", "first", "k"), (3, 1, "user", "q", "k"), (3, 1, "user", "q", "k"), (None, 0, None, None, "k"), (4, None, "sys<>\\", "t", "k")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chats(df)
    got = {r.conv_id: r for r in out.select("conv_id", "valid", "segments", "formatted", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [(x.role, x.text) for x in got[1].back] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert got[1].loss == "".join(r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant")
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    assert got[1].valid and not got[2].valid and not got[3].valid and not got[4].valid
    assert len(got[3].back) == 2 and got[4].back[0].role == "sys<>\\" and got[None].formatted == "<turn:>\n</turn>\n"
    assert chat_format.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("open_role, open_text, close", [("### ", ": ", "\n\n"), ("[", "]", "\n"), ("\\", "-", "~"), ("user(", ")", ";l"), ("<|im_start|>", "\n", "<|im_end|>\n"), ("l", "g", "a")])
def test_escapes_follow_the_template(spark, open_role, open_text, close):
    t = chat_format.ChatTemplate(open_role=open_role, open_text=open_text, close=close)
    said = ["hi\n### assistant: evil", open_role + "x" + open_text + "y" + close, "", "\\-\\l~_^=", "<l>g[a]\\", "l" * 9 + "g-a"]
    rows = [(1, i, ("user", "assistant")[i % 2], x) for i, x in enumerate(said)] + [(1, 9, "r" + open_text + close, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat_format.format_chats(df, t).select("*", chat_format.read_back(F.col("formatted"), t).alias("back"), chat_format.loss_text(F.col("segments"), t).alias("loss")).first()
    assert [(x.role, x.text) for x in r.back] == [x[2:] for x in rows] and r.loss == "".join(said[1::2])
    with pytest.raises(ValueError, match="empty"):
        chat_format.format_chats(df, chat_format.ChatTemplate(close=""))


def test_last_block_is_cut_alike(skewed, monkeypatch):
    """One block a source: the budget ends inside it; the parts of a block change nothing."""
    how = dict(keep=["doc_id", "source"], entropy=0.9, repeats=3.0, blocks=1)
    want = sorted(map(tuple, mixing.mix(skewed, **how).collect()))
    monkeypatch.setattr(mixing, "SUBS", 1)
    assert sorted(map(tuple, mixing.mix(skewed, **how).collect())) == want
    rows = {}
    for d, s, epoch, _ in want:
        rows.setdefault((s, epoch), set()).add(d)
    assert any(len(x) not in (2000, 400) for x in rows.values())


def test_names_that_differ_in_case(spark):
    """Every stage, with columns doc_ID and TEXT beside doc_id and text."""
    docs = spark.createDataFrame([(1, 9, "one two three four five six", "x", "en", "a"), (2, 9, "one two three four five six", "y", "en", "b")] * 2, "doc_id long, doc_ID string, text string, TEXT string, lang string, source string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() >= 2 and (name == "bpe" or out.columns == docs.columns)


def test_other_template(spark):
    t = chat_format.ChatTemplate(open_role="[", open_text="]", close="\n", loss_roles=("bot",), accept=("done",), moves={("start", "bot"): "done"})
    df = spark.createDataFrame([(1, 0, "bot", "hi")], "conv_id long, turn long, role string, text string")
    r = chat_format.format_chats(df, t).first()
    assert r.formatted == "[bot]hi\n" and r.valid and [s.loss for s in r.segments] == [False, True, False]


@pytest.fixture(scope="module")
def skewed(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.lit(9).alias("epoch"))
    return docs


def test_mixture_shares(skewed):
    total = skewed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    out = mixing.mix(skewed, ["doc_id", "source", "text"], entropy=1.0, repeats=10.0)
    got = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert all(abs(n - total / 6) <= 10 for n in got.values()) and len(got) == 6
    most = mixing.mix(skewed, ["doc_id"], entropy=1.0, repeats=1.5).groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert most == 2
    same = mixing.mix(skewed, ["doc_id", "source"]).groupBy("doc_id").count()
    assert same.count() == 4000 and same.agg(F.max("count")).first()[0] == 1
    again = [sorted(map(tuple, mixing.mix(skewed, ["doc_id"], repeats=1.5, budget=0.7).collect())) for _ in range(2)]
    assert again[0] == again[1]


def test_cover_keeps_every_document(skewed):
    out = mixing.mix(skewed, skewed.columns, repeats=1.25, budget="cover", order=False)
    assert out.columns == skewed.columns and out.select("doc_id").distinct().count() == 4000 and out.count() <= 1.25 * 4000


def test_both_paths_agree(skewed, monkeypatch):
    want = sorted(map(tuple, mixing.mix(skewed, ["doc_id", "source"], entropy=0.9, repeats=3.0).collect()))
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    monkeypatch.setattr(mixing, "MOST_PLAN_ROWS", 0)
    assert sorted(map(tuple, mixing.mix(skewed, ["doc_id", "source"], entropy=0.9, repeats=3.0).collect())) == want


def test_mixing_cases(odd_docs, no_docs):
    out = mixing.mix(odd_docs, odd_docs.columns, repeats=2.0, budget="cover", order=False)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in odd_docs.collect()}
    assert mixing.mix(no_docs, ["doc_id"], entropy=0.9).count() == 0
    blank = odd_docs.where("text is null or trim(text) = ''")
    assert mixing.mix(blank, ["doc_id"], entropy=0.9, repeats=2.0).count() == blank.count()


def test_pipeline_stages(spark, odd_docs, no_docs, tmp_path):
    """Each stage against a plain version of what it must keep."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept.collect()
        out = stage(spark, kept, "/root/testdata/sf0.01")
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        ids = [r.doc_id for r in kept.collect()]
        if name == "language_id":
            assert len(ids) >= 0.99 * len(before)
        elif name == "exact_dedup":
            low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            best: dict = {}
            for r in before:
                k = hashlib.sha256((r.text or "").translate(low).encode()).digest()
                best[k] = max(best.get(k, r.doc_id), r.doc_id)
            assert sorted(ids) == sorted(best.values())
        elif name == "ngram_join":
            from test_dedup import brute_texts

            groups = brute_texts([r.text for r in before], [r.doc_id for r in before])
            assert sorted(ids) == [d for d, _, c in groups if d == c]
        elif name == "mixing":
            assert set(ids) == {r.doc_id for r in before} and len(ids) <= 1.25 * len(before)
        else:
            assert sorted(ids) == sorted(r.doc_id for r in before)
    for table in (odd_docs, no_docs):
        at = table
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, "")
        assert at.count() >= 0


def test_pipeline_odd_ids(spark):
    """Copies without an id go, and of two texts under one id only the copy."""
    text = " ".join(f"word{i}" for i in range(60))
    near, other, third = text + " more", text.replace("word", "other"), text.replace("word", "third")
    rows = [(1, text), (2, other), (3, text.upper()), (3, third), (None, text), (None, third + " tail"), (None, "alone " * 9), (None, None), (5, near), (None, near), (-4, other + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.exact_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter(x for x in rows if x not in [(1, text), (None, text), (None, near)])
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter([(1, text), (3, third), (-4, other + " tail"), (None, "alone " * 9), (None, None)])


def test_cover_of_large_sources(spark):
    """Quotas in double arithmetic; at 1e12 tokens some fell short of their source."""
    r = np.random.default_rng(11)
    short = 0
    for _ in range(12):
        sizes = [int(x) for x in r.integers(10**11, 10**13, 5)]
        sources = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(sizes)], "s string, t long")
        plan = mixing._quotas(sources, 5, None, 1.25, True, 1.0).collect()
        short += sum(x.full < 1 for x in plan)
    assert short == 0
