"""Vector codes against whole-number loops."""

import math
import random

import pytest

from vecspan.llm import vector_codes

CLASH = "id long, v string, n long, key string, `a.b` int, data string, ids string"
EXTRA = (1, "v", 2, "k", 3, "d", "i")


def table(spark, rows, n=3):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"vec_id long, embedding array<float>, label int, {CLASH}").repartition(n)


def brute(rows, parts=16, entries=64, rounds=2):
    kept = sorted(((i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in kept if len(v) == len(kept[0][1])]
    size = len(kept[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book[p]))

    for _ in range(rounds):
        index = [[near(c[p], p)[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            groups = {}
            for c, i in zip(cut, index, strict=True):
                groups.setdefault(i[p], []).append(c[p])
            for k, g in groups.items():
                book[p][k] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    out, sums = [], {}
    for (i, _, y), c in zip(kept, cut, strict=True):
        found = [near(c[p], p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), y))
        sums[y] = sums.get(y, 0) + out[-1][2]
    return sorted(((i, code, e, sums[y]) for i, code, e, y in out), key=str), book


def test_codes(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(32)], rng.choice([None, 1, 2])) for i in range(300)]
    rows = [(i, [round(x * 512) / 512 for x in v], y) for i, v, y in rows]
    rows += [(3, rows[3][1], 1), (None, rows[4][1], 2), (None, rows[5][1], None), (500, None, 1), (501, [], 1), (502, [float("nan")] * 32, 1), (503, [None] * 32, 1), (504, [float("inf")] * 32, None), (505, [0.5] * 31, 1)]
    want, book = brute(rows)
    monkeypatch.setattr(vector_codes, "BLOCK", 50)
    for n in (1, 4):
        out, got = vector_codes.compress(table(spark, rows, n))
        assert sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error").collect()), key=str) == want
        assert got.tolist() == book
    back = vector_codes.decode(out, got).where("vec_id = 7").first().decoded
    assert len(back) == 32 and max(abs(a - b) for a, b in zip(back, rows[7][1], strict=True)) < 1


def test_few_and_none(spark):
    few = [(1, [0.0, -0.001, 1.0, 2.0] * 8, None), (2, [0.0, -0.001, 1.0, 2.0] * 8, None)]
    out, book = vector_codes.compress(table(spark, few))
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in out.collect()} == {(1, "00" * 16, 0, 0), (2, "00" * 16, 0, 0)}
    assert book.shape == (16, 2, 2) and book[0, 0].tolist() == [0, -1]
    out, book = vector_codes.compress(table(spark, few).limit(0))
    assert out.collect() == [] and len(vector_codes.fingerprint(book)) == 64 and vector_codes.decode(out, book).collect() == []
    out, _ = vector_codes.compress(table(spark, [(1, [], 1), (2, [], None)]))
    assert {(r.vec_id, r.code, r.error) for r in out.collect()} == {(1, "00" * 16, 0), (2, "00" * 16, 0)}
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, [(1, [1.0] * 17, 1)]))
