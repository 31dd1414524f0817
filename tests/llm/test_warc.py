"""Archives written, read and joined to captures."""

import gzip
import hashlib

import pytest

from vecspan.llm import common, warc
from vecspan.session import work_dir

CLASH = "key string, n long, first string, uuid string, type string, record_id string, `a.b` long, member int"
EXTRA = ("k", 1, "f", "u", "t", "r", 2, 3)


def pages(spark, rows, n=3):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"page_id long, url string, html string, {CLASH}").repartition(n)


def expected(rows, least=1000):
    """What the contract asks for, row by row."""
    payload = [(p, (h or "").encode()) for p, _, h in rows]
    first = {}
    for p, b in payload:
        if p is not None and len(b) >= least:
            first[b] = max(p, first.get(b, p))
    out = []
    for p, b in payload:
        of = first.get(b) if p is not None and len(b) >= least else None
        again = of is not None and of != p
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", of if again else None))
    return sorted(out, key=str)


def round_trip(spark, df, **how):
    path = work_dir(spark, "warc")
    warc.write_warc(df, path, **how)
    out = warc.resolved(warc.captures(warc.read_records(spark, path, with_payload=False)))
    return sorted((tuple(r) for r in out.select("id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def odd_rows():
    inner = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:0>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big, rows = "x" * 1200, []
    rows += [(1, None, None), (2, "", ""), (3, "http://a/ b\r\nX: y", "WARC/1.1\r\n\r\n"), (4, "u", inner), (5, "u", inner * 20), (6, "u", "é" * 700), (7, "u", "\r\n" * 40_000)]
    rows += [(i, f"http://e/{i}", big) for i in range(10, 40)] + [(None, "n", big), (None, None, big), (None, None, None)]
    rows += [(39, "again", big), (39, "again", big), (8, "s", "small"), (9, "s", "small"), (2**40, "u", "\u0000\x1f﻿" + big), (-5, "u", "a" * 300_000 + "\r\n\r\nWARC/")]
    rows += [(100 + i, "u", "y" * (65_500 + i) + "\r\n\r\n\r\nWARC/1.1\r\n" + "z" * i + "\r\n") for i in range(40)]
    return rows


def test_odd_pages(spark):
    rows = odd_rows()
    want = expected(rows)
    for n in (1, 5):
        assert round_trip(spark, pages(spark, rows, n)) == want
    assert round_trip(spark, pages(spark, rows), records_per_file=7) == want
    assert round_trip(spark, pages(spark, rows).limit(0)) == []


def test_beyond_broadcasts(spark, monkeypatch):
    """Attached by shuffle but for hot keys, which gives the same."""
    monkeypatch.setattr(common.attach, "__defaults__", (1,))
    rows = odd_rows() + [(5000 + i, "u", f"{i // 2}" * 600) for i in range(60)]
    assert round_trip(spark, pages(spark, rows)) == expected(rows)
    found = spark.createDataFrame([(None, "none", 5), ("a", "x", 100_000), ("b", "y", 2)], "k string, v string, n long")
    left = spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (4, "c")], "i int, k string")
    want = [(1, None, "none"), (2, "a", "x"), (3, "b", "y"), (4, "c", None)]
    for most in (1, 10):
        assert sorted((r.i, r.k, r.v) for r in common.attach(left, common.stored(found), "k", most).collect()) == want


def test_archives_of_others(spark, tmp_path):
    """Plain and gzip archives, records of a capture in several of them, folded and repeated headers, chains of references, no main record."""

    def record(kind, name, block, *more, content_type="application/http; msgtype=request"):
        head = [f"WARC/1.0\r\nWARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"Content-Type: {content_type}", *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    page = b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)) * 20
    plain = record("warcinfo", "i", b"software: x\r\n", content_type="application/warc-fields")
    plain += record("response", "r1", page, "WARC-Target-URI: http://one", "WARC-Concurrent-To: <q9>") + record("metadata", "m1", b"a: 1", "WARC-Concurrent-To: <q1>", content_type="application/warc-fields")
    plain += record("resource", "r2", b"plain text", content_type="text/plain") + record("request", "lost", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To:", "  <nobody>")
    other = record("request", "q1", b"GET /1 HTTP/1.1\r\n\r\nbody", "WARC-Concurrent-To: <r1>") + record("request", "q9", b"GET /9 HTTP/1.1\r\n\r\n")
    other += record("request", "q2", b"GET /2 HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <x>", "WARC-Concurrent-To: <r2>") + record("metadata", "alone", b"b: 2", content_type="application/warc-fields")
    (tmp_path / "a.warc").write_bytes(plain)
    members = other.split(b"WARC/1.0")[1:]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(b"WARC/1.0" + m) for m in members))
    rows = {r.capture_id: r for r in warc.captures(warc.read_records(spark, str(tmp_path))).collect()}
    assert {k: (r.record_type, [q.record_id for q in r.requests], [m.record_id for m in r.metadata]) for k, r in rows.items()} == {
        "<r1>": ("response", ["<q1>", "<q9>"], ["<m1>"]), "<r2>": ("resource", ["<q2>"], []), "<lost>": (None, ["<lost>"], []), "<alone>": (None, [], ["<alone>"]),
    }
    assert rows["<r1>"].response.payload == bytes(range(256)) * 20 and rows["<r1>"].target_uri == "http://one" and rows["<lost>"].response is None
    assert rows["<r1>"].response.payload_bytes == 5120 and rows["<r1>"].response.payload_sha1 == hashlib.sha1(bytes(range(256)) * 20).hexdigest()
    assert rows["<r1>"].requests[0].payload == b"body" and rows["<r1>"].metadata[0].fields == "a: 1"


def test_split_plain_archive(spark, tmp_path):
    """A plain archive that Spark cuts in the middle of records."""
    blocks = [(f"{i}:".encode() + b"\r\n\r\nWARC/1.1\r\n" * (i % 50)) for i in range(300)]
    (tmp_path / "p.warc").write_bytes(b"".join(b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n" % (i, len(b)) + b + b"\r\n\r\n" for i, b in enumerate(blocks)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 10_000)
    try:
        found = {r.record_id: bytes(r.payload) for r in warc.read_records(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {f"<{i}>": b for i, b in enumerate(blocks)}


def test_broken_archives():
    def parsed(raw):
        return list(warc.parse(iter(raw.split(b"\r\n\r\nWARC/"))))

    assert parsed(b"") == []
    for raw in (b"<html>", b"WARC/1.1\r\nContent-Length: 19\r\n\r\nshort\r\n\r\n", b"WARC/1.1\r\nA: b\r\n\r\n\r\n\r\n", b"WARC/1.1\r\nContent-Length: 1\r\n\r\nlonger\r\n\r\n"):
        with pytest.raises(ValueError):
            parsed(raw)
