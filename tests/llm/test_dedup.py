"""Copies, lines, near copies, repeated passages and near vectors against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspan.llm import exact_dedup, lattice, line_dedup, ngram_join, suffix
from vecspan.llm.common import connected_components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 470)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components(500, edges)
    assert got == {i: c for i, c in enumerate(want) if any(i in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError, match="still change"):
        connected_components(spark.createDataFrame(edges, "a long, b long"), rounds=2)


def test_exact(spark, odd_docs, no_docs):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd_docs).collect()}
    assert {(4, 6, 4, False), (5, 6, 4, False), (6, 6, 4, True), (1, 2, 2, False), (2, 2, 2, True), (9, 9, 1, True)} <= got
    assert exact_dedup.exact_dedup(odd_docs).count() == odd_docs.count()
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    sizes = Counter(r.group_size for r in exact_dedup.exact_dedup(hot, track=8).collect())
    assert sizes == {1000: 1000, 1: 2000}


def brute_lines(rows):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate(LOW) for x in (t or "").split("\n")]
    owners = {}
    for d, t in rows:
        for k in keys(t):
            if len(k) >= 10:
                owners.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x, k in zip(lines, keys(t), strict=True) if len(owners.get(k, ())) < 2 or min(owners[k]) == d]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


@pytest.mark.parametrize("probe", ["broadcast", "routed"])
def test_lines(spark, odd_docs, no_docs, probe, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows += [(20 + i, f" Common line {i % 3} \nown {i}\nCOMMON LINE {i % 3}\n\tßßßßßßßßßß {i % 2}\nßßßß") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.dedup_lines(df, probe=probe).collect()))
    assert got == brute_lines(rows)
    assert line_dedup.dedup_lines(no_docs, probe=probe).count() == 0


@pytest.mark.parametrize("probe", ["broadcast", "routed"])
def test_lines_without_id(spark, probe, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    rows = [(-1, "held by two ids\nown line one"), (5, "held by two ids\nonly five and null"), (None, "held by two ids\nonly five and null\nnull's own line"), (None, "Held by two ids"), (None, None), (0, "shared by 0 and 7\nshort"), (7, "shared by 0 and 7"), (None, "shared by 0 and 7\nshort")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df, probe=probe).collect()), key=str)
    want = [(-1, 2, 0, rows[0][1]), (5, 2, 1, "only five and null"), (None, 3, 1, "only five and null\nnull's own line"), (None, 1, 1, ""), (None, 1, 0, ""), (0, 2, 0, rows[5][1]), (7, 1, 1, ""), (None, 2, 1, "short")]
    assert got == sorted(want, key=str)


def test_perfect_hash():
    r = np.random.default_rng(1)
    h = r.integers(0, 2**63, (5000, 2)).astype(np.uint64)
    own = r.integers(0, 1000, 5000)
    t = line_dedup.PerfectTable(*line_dedup.PerfectTable.build(h[:, 0], h[:, 1], own, np.full(5000, 2)))
    found, owner = t.owner(np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]))
    assert found.all() and (owner == own).all() and len(t.fps) == 5000 and sorted(t.fps) == sorted(h[:, 1])
    assert not t.owner(np.ascontiguousarray(h[:, 1]), np.ascontiguousarray(h[:, 0]))[0].any()


def brute_texts(texts, ids):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for t in texts:
        w = word.findall((t or "").translate(LOW))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    comp, least = components(len(sets), edges), {}
    for i, c in enumerate(comp):
        least[c] = min(least.get(c, ids[i]), ids[i])
    return sorted((ids[i], len(s), least[comp[i]] if s else ids[i]) for i, s in enumerate(sets))


def mutated(r, words, share):
    return [w if r.random() > share else f"m{r.integers(10**6)}" for w in words]


def global_order(words):
    """The hashes, by which n-grams are ordered, of the five-word shingles, in that order."""
    from vecspan.llm.shingles import shingle_sets

    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return next(shingle_sets(raw, np.array([0, len(raw)])))


@pytest.mark.parametrize("sets", [1024, 2])
def test_ngram_join_where_signatures_differ(spark, sets, monkeypatch):
    """Texts at exactly 0.75 whose own shingles come first in the global order, so that signatures have nothing in common."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", sets)
    body = [f"b{i}" for i in range(304)]  # 300 shingles
    least = global_order(body)[0]

    def tail(name):
        """50 more words whose shingles include three that come before all of the body's."""
        tries = ([f"{name}{k}_{i}" for i in range(50)] for k in range(10**6))
        return next(t for t in tries if global_order(body[-4:] + t)[2] < least)

    texts = [" ".join(body + tail(name)) for name in "xyz"] + [" ".join(body + [f"far{i}" for i in range(120)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.similar_texts(df, signature=3).collect()))
    assert got == brute_texts(texts, list(range(4))) and [g[2] for g in got] == [0, 0, 0, 3]


def test_second_pass_finds_what_signatures_hide(spark, odd_docs, monkeypatch):
    """With signatures of one n-gram the first pass misses most links; the result is the same."""
    r = np.random.default_rng(15)
    words = [[f"g{g}_{i}" for i in range(int(r.integers(3, 200)))] for g in range(6)]
    texts = [" ".join(mutated(r, w, 0.03) + [f"t{r.integers(9)}"] * int(r.integers(0, 9))) for w in words for _ in range(9)]
    df = spark.createDataFrame([(str(1000 + i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    want = brute_texts(texts, [str(1000 + i) for i in range(len(texts))])
    for signature, sets, cluster in ((1, 1024, 4096), (1, 1024, 5), (16, 3, 2)):
        monkeypatch.setattr(ngram_join, "BLOCK_SETS", sets)
        monkeypatch.setattr(ngram_join, "CLUSTER_SETS", cluster)
        assert sorted(map(tuple, ngram_join.similar_texts(df, signature=signature).collect())) == want


def rows_made(spark, node, run):
    """Rows that plan nodes whose text matches ``node`` make while ``run`` runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    each = lambda seq: [seq.apply(i) for i in range(seq.size())]
    before = {e.executionId() for e in each(store.executionsList())}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    made = 0
    for e in each(store.executionsList()):
        if e.executionId() in before:
            continue
        values = store.executionMetrics(e.executionId())
        for n in each(store.planGraph(e.executionId()).allNodes()):
            for m in each(n.metrics()) if re.search(node, n.desc()) else []:
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    made += int(values.apply(m.accumulatorId()).replace(",", ""))
    return made


def test_sets_of_a_large_cluster_are_joined_as_rows(spark):
    """Filtering by whole sets joins by set as many rows as there are sets, not as many as they have n-grams."""
    r = np.random.default_rng(18)
    words = [[f"g{g}_{i}" for i in range(150)] for g in range(8)]
    texts = [" ".join(mutated(r, w, 0.005)) for w in words for _ in range(4)] + [" ".join(f"o{k}_{i}" for i in range(150)) for k in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = docs.selectExpr("doc_id as rep", "146L as n_shingles", "doc_id as component").localCheckpoint()
    found = []
    run = lambda: found.extend(ngram_join._by_whole_sets(docs, sets, "doc_id", "text", 5, 75, 100).collect())
    assert 0 < rows_made(spark, r"Join \[rep#\d+L?\], \[rep#\d+L?\], Inner", run) <= 2 * len(texts)
    assert {x.rep for x in found} == set(range(32)) and {(x.n_shingles, x.component - x.rep) for x in found} == {(146, 0)}


def test_prefixes_hold_what_links_have_in_common():
    r = np.random.default_rng(16)
    for _ in range(3000):
        n = int(r.integers(1, 200))
        m = int(r.integers(1, 200))
        c = int(r.integers(0, min(n, m) + 1))
        if 100 * c < 75 * (n + m - c):
            continue
        order = r.permutation(n + m - c)
        x, y = np.sort(order[:n]), np.sort(order[n - c :])
        both = np.intersect1d(x[: ngram_join.prefix_length(n, 75, 100)], y[: ngram_join.prefix_length(m, 75, 100)])
        assert len(both) >= min(ngram_join.spare(n), ngram_join.spare(m)) >= max(ngram_join.spare(ngram_join.needed(k, 75, 100)) for k in (n, m))


def test_ids_of_the_join(spark):
    """Without an id: the component of the class; two sets under one id: linked."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (7, text + " end"), (3, text), (None, "all alone here now yes"), (5, "x " * 9), (5, "one two three four five"), (None, "one two three four five six")]
    got = [tuple(r) for r in ngram_join.similar_texts(spark.createDataFrame(rows, "`a.b` long, text string"), id_col="a.b").collect()]
    assert sorted(got, key=str) == sorted([(None, 36, 3), (7, 37, 3), (3, 36, 3), (None, 1, None), (5, 1, 5), (5, 1, 5), (None, 2, None)], key=str)


@pytest.mark.parametrize("block", [1 << 23, 4000])
def test_ngram_join(spark, odd_docs, no_docs, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block)
    r = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for g in range(12):
        words = [f"g{g}_{i}" for i in range(int(r.integers(3, 150)))]
        for _ in range(int(r.integers(1, 12))):
            x = mutated(r, words, float(r.choice([0.0, 0.01, 0.03, 0.06])))
            texts.append(" ".join(x + (passage if r.random() < 0.4 else [])))
    hub = [f"h{i}" for i in range(120)]
    texts += [" ".join(mutated(r, hub, 0.02)) for _ in range(40)]
    rows = [(x.doc_id, x.text) for x in odd_docs.dropDuplicates(["doc_id"]).collect()] + [(100 + i, t) for i, t in enumerate(texts)]
    got = sorted(map(tuple, ngram_join.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_texts([t for _, t in rows], [d for d, _ in rows])
    assert ngram_join.similar_texts(odd_docs).count() == odd_docs.count()
    assert ngram_join.similar_texts(no_docs).count() == 0


def test_tree_finds_what_pairs_find(monkeypatch):
    r = np.random.default_rng(0)
    for trial in range(120):
        monkeypatch.setattr(ngram_join, "BIT_BYTES", 0 if trial % 2 else 1 << 25)
        roots = [np.unique(r.integers(0, 60, r.integers(1, 40))) for _ in range(3)]
        sets = []
        for _ in range(r.integers(2, 25)):
            x = roots[r.integers(3)]
            sets.append(np.unique(np.concatenate([x[r.random(len(x)) > r.random() * 0.3], r.integers(0, 60, r.integers(0, 4))])))
        sets = [x for x in {x.tobytes(): x for x in sets}.values() if len(x)]
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
        edges = ngram_join.linked_forest([x.astype(">u8").tobytes() for x in sets]) if len(sets) > 1 else []
        assert components(len(sets), edges) == components(len(sets), pairs)
        assert {(max(e), min(e)) for e in edges} <= set(pairs)


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [1 << 20, 2500])
def test_suffix_dedup(spark, odd_docs, no_docs, shard, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    r = np.random.default_rng(2)
    text = lambda n: "".join(r.choice(list("abcd é"), n))
    shared = [text(230), text(199), text(200), text(500)]
    texts = ["a" * 700, "ab" * 300, "x" * 199, "y" * 200, "a" * 700 + "b"]
    for _ in range(40):
        t = text(r.integers(0, 250))
        for _ in range(r.integers(0, 3)):
            t += shared[r.integers(4)] + text(r.integers(0, 120))
        texts.append(t)
    rows = [(x.doc_id, x.text if x.text is None or len(x.text) < 6000 else x.text[:6000]) for x in odd_docs.collect()] + [(i % 30, t) for i, t in enumerate(texts)]
    got = sorted(map(tuple, suffix.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()))
    want = sorted((d, *b) for (d, _), b in zip(rows, brute_repeats([t for _, t in rows], 200), strict=True))
    assert got == want
    assert suffix.drop_repeats(no_docs).count() == 0


def test_ranges():
    r = np.random.default_rng(3)
    for _ in range(200):
        starts = np.cumsum(r.choice([1, 1, 1, 2, 7], r.integers(1, 40)))
        assert [f + i * s for f, s, n in suffix.ranges(starts) for i in range(n)] == starts.tolist()
    assert suffix.ranges(np.arange(5, 10**6)) == [(5, 1, 10**6 - 5)]


@pytest.mark.parametrize("shard", [1 << 20, 4000])
def test_long_texts_and_licences(spark, shard, monkeypatch):
    """Texts longer than a piece, runs and periods in them, and passages that most texts have, whole or in part."""
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix, "PIECE", 700)
    r = np.random.default_rng(21)
    text = lambda n: "".join(r.choice(list("abcdefgh"), n))
    licence, part = text(400), text(185)
    texts = [text(30) + licence + text(40) for _ in range(40)] + [text(100) + part + text(100) for _ in range(40)]
    texts += ["x" * 5000, text(900) + "y" * 3000 + text(50), "abc" * 1500, text(2500) + licence + text(2500), licence * 6, text(230) * 9]
    rows = list(enumerate(texts))
    got = sorted(map(tuple, suffix.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()))
    assert got == [(d, *b) for (d, _), b in zip(rows, brute_repeats(texts, 200), strict=True)]


def test_texts_travel_twice(spark, monkeypatch):
    """Texts are packed for one journey to their grams, hot or not, and one to their spans."""
    monkeypatch.setattr(suffix, "SHARD_BYTES", 2500)
    r = np.random.default_rng(23)
    text = lambda n: "".join(r.choice(list("abcdefgh"), n))
    licence, pair = text(400), text(260)
    texts = [text(50) + licence + text(50) for _ in range(20)] + [text(90) + pair + text(90) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = []
    assert 0 < rows_made(spark, r"MapInArrow pack\(", lambda: got.extend(suffix.drop_repeats(docs, digest=True).collect())) <= 2 * len(texts)
    assert sorted(map(tuple, got)) == [(d, *b) for d, b in enumerate(brute_repeats(texts, 200))]


def test_licence_ships_linear_rows():
    """One licence in every text: a text's contexts of a hot anchor are a few bytes' worth each, and equal between texts."""
    r = np.random.default_rng(22)
    licence = "".join(r.choice(list("abcdefgh"), 400)).encode()
    texts = [bytes(r.choice(list(b"ijkl"), 300).tolist()) + licence + bytes(r.choice(list(b"mnop"), 300).tolist()) for _ in range(30)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    _, _, _, gram, _ = suffix.anchors(data, offsets, 200)
    common = [g for g, n in Counter(gram.tolist()).items() if n >= 30]
    found = list(suffix.contexts(data, offsets, 200, [np.array(common)] * 30, True))
    keys = Counter(k for _, k, _, _ in found)
    shared = {raw for _, k, _, raw in found if keys[k] == 30}
    whole = [raw for _, k, _, raw in found if keys[k] == 30 and raw in licence]
    assert whole and len(set(whole)) == len(whole) / 30 and sum(map(len, shared)) < 60 * sum(map(len, set(whole)))


def test_suffix_order():
    r = np.random.default_rng(4)
    texts = [bytes(r.choice(list(b"ab"), 300).tolist()) for _ in range(20)]
    sa = suffix.SuffixArray(texts, 64)
    flat = b"".join(texts)
    got = [flat[p : p + 64] for p in sa.order]
    assert got == sorted(got)
    common = sa.common()
    for i in range(1, len(got)):
        m = next((k for k in range(64) if got[i][k] != got[i - 1][k]), 64)
        assert common[i] == m
    other = suffix.SuffixArray([texts[0], bytes(r.choice(list(b"cd"), 300).tolist())], 64)
    found = sa.holds(other, other.order)
    assert [bool(x) for x in found] == [other.text[p] in b"ab" for p in other.order]


def brute_vectors(rows, least=0.93):
    n = len(rows)
    ok = [lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, lab, v in rows]
    edges = []
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                a, b = np.array(rows[i][2], float), np.array(rows[j][2], float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                    edges.append((i, j))
    links = Counter(x for e in edges for x in e)
    comp, low = components(n, edges), {}
    for i, c in enumerate(comp):
        low[c] = min(low.get(c, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], low[comp[i]], rows[i][0] == low[comp[i]]) for i in range(n))


@pytest.mark.parametrize("block, fine", [(2048, 0), (16, 0), (2048, 1)])
def test_near_vectors(spark, block, fine, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", block)
    if fine:  # the lattices of large labels
        monkeypatch.setattr(lattice, "FINENESS", ((0, 1.0, 5), (20, 0.8, 9), (40, 0.65, 20), (1 << 21, 0.55, 45)))
    r = np.random.default_rng(6)
    rows = []
    for c in range(30):
        base = r.standard_normal(32)
        for _ in range(int(r.integers(1, 8)) if c else 90):
            rows.append((len(rows), int(c % 2), [float(x) for x in base + 0.15 * r.standard_normal(32)]))
    rows += [(1000, None, rows[0][2]), (1001, 0, None), (1002, 0, [0.0] * 32), (1003, 0, [float("nan")] * 32), (1004, 0, [None] * 32), (1005, 0, [1.0, 2.0]), (1006, 0, [2.0, 4.0]), (1007, 0, []), (1008, 0, rows[0][2]), (1009, 0, [2 * x for x in rows[0][2]])]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, label int, embedding array<double>, rep long, codes int")
    assert sorted(map(tuple, lattice.near_vectors(df).collect())) == brute_vectors(rows)
    floats = [(a, b, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for a, b, v in rows]
    df = spark.createDataFrame(floats, "`vec.id` long, label int, embedding array<float>").unionByName(spark.createDataFrame([(None, 0, rows[0][2])], "`vec.id` long, label int, embedding array<float>"))
    got = lattice.near_vectors(df, id_col="vec.id").collect()
    want = brute_vectors([*floats, (-1, 0, floats[0][2])])
    alike = {w[0] for w in want if w[2] == -1}
    assert sorted(tuple(g) for g in got if g.vec_id is not None and g.vec_id not in alike) == [w for w in want if w[0] not in alike]
    assert {g.vec_id: g.n_links for g in got if g.vec_id in alike} == {w[0]: w[1] for w in want if w[0] in alike and w[0] >= 0}
    assert lattice.near_vectors(df.limit(0), id_col="vec.id").count() == 0


def test_lattice():
    r = np.random.default_rng(8)
    z = r.uniform(-3, 3, (200, 8))
    x = lattice.nearest_e8(z)
    roots = lattice.roots()
    assert roots.shape == (240, 8) and np.allclose((roots**2).sum(1), 2)
    assert np.all(np.isclose(x % 1, 0).all(1) | np.isclose(x % 1, 0.5).all(1)) and np.allclose(x.sum(1) % 2, 0)
    d = ((z - x) ** 2).sum(1)
    assert (d <= 1 + 1e-9).all()  # the covering radius
    for v in roots:
        assert (d <= ((z - x - v) ** 2).sum(1) + 1e-9).all()


@pytest.mark.parametrize("tier", range(4))
def test_recall_at_the_threshold(tier):
    """At every fineness over 99 % of the pairs at a cosine of exactly 0.93 share a cell, and few random pairs do."""
    r = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a = unit(r.standard_normal((1500, 64)))
    g = r.standard_normal((1500, 64))
    g = unit(g - (g * a).sum(1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * g
    _, scale, tables = lattice.FINENESS[tier]
    ca, cb, cg = (lattice.cells(x, tables, 7, scale, 7) for x in (a, b, g))
    meet = lambda x, y: np.mean([(x[k][:, :, None] == y[k][:, None, :]).any() for k in range(len(x))])
    assert meet(ca, cb) >= 0.99
    assert meet(ca, cg) <= (0.02, 0.006, 0.004, 0.004)[tier]
    some = r.permutation(1500)[:7]
    assert (lattice.cells(a[some], tables, 7, scale, 7) == ca[some]).all()
