"""WARC archives: records of captures written, read back, and joined to a nested row a capture.

A record is "WARC/1.1", header lines, an empty line, a block of Content-Length bytes and two
line ends. The request and metadata records of a capture name its response (or the revisit that
stands for it) in WARC-Concurrent-To, in whatever archive it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.session import importable

from .common import attach, connected_components, discard, pick, stored, trimmed

#: Where the reader cuts archives; a payload may hold it too.
_CUT = "\r\n\r\nWARC/"
#: Bytes of records that a task passes on at once.
BATCH_BYTES = 16 << 20
#: Types of the record that stands for a capture.
MAIN = ("response", "revisit", "resource")
_SCHEMA = "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, digest string, content_type string, http string, payload_bytes long, payload_sha1 string, payload binary, fields string"


def _urn(uuid: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))


def _derived(uuid: Column, what: str) -> Column:
    """Another identifier that follows from one."""
    return F.regexp_replace(F.md5(F.concat(uuid, F.lit(what))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _record(kind: str, uuid: Column, date: str, url: Column, content_type: str, headers: list[Column], block: Column) -> Column:
    """A record up to the end of its block."""
    lines = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), _urn(uuid), F.lit(f"\r\nWARC-Date: {date}\r\n"),
        F.when(url.isNull(), "").otherwise(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n"))),
        *headers,
        F.lit(f"Content-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    ]
    return F.concat(*lines)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 100_000) -> None:
    """Each page as a request, a response or revisit, and a metadata record, in gzip archives under ``path``.

    The payload is the page in UTF-8; null is the empty payload. Of pages with equal payloads of
    at least ``least`` bytes the one with the largest id is the response and the others are
    revisits, which hold its HTTP header and digest only. Pages without an id are responses that
    nothing refers to, and pages that repeat the largest id are responses too. An address with a
    blank or control character is percent-encoded, and one that is null is left out. Other
    columns are ignored, whatever their names; an empty table makes archives without records.

    Pages are first stored with their digest and a record identifier, so that every later step
    sees the same ones, a task that is run again included. Which payloads repeat is a table of
    digests; it is joined by ``attach``, which splits a page that very many addresses share.
    """
    rows = pick(pages, id=id_col, url=url_col, html=html_col)
    html = F.coalesce(F.col("html"), F.lit("")).cast("string")
    url = F.when(F.col("url").rlike("[\\x00-\\x20\\x7f]"), F.url_encode(F.col("url"))).otherwise(F.col("url"))
    pages_ = stored(rows.select("id", url.alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("size"), F.uuid().alias("uuid")))
    key = F.when((F.col("size") >= least) & F.col("id").isNotNull(), F.col("digest"))
    rows = pages_.withColumn("key", key)
    groups = rows.where("key is not null").groupBy("key").agg(F.max(F.struct("id", "uuid", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = stored(groups)
    rows = attach(rows, groups, "key")
    again = F.col("first").isNotNull() & (F.col("first.id") != F.col("id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    asked = F.concat(F.lit("GET "), F.coalesce(F.col("url"), F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))
    uuid, digest = F.col("uuid"), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    same = F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")
    refers = [_line("WARC-Refers-To", _urn(F.col("first.uuid"))), F.when(F.col("first.url").isNull(), "").otherwise(_line("WARC-Refers-To-Target-URI", F.col("first.url")))]
    of = [_line("WARC-Concurrent-To", _urn(uuid))]
    kind = "application/http; msgtype="
    main = F.when(again, _record("revisit", uuid, date, F.col("url"), f"{kind}response", [digest, same, *refers], http)).otherwise(
        _record("response", uuid, date, F.col("url"), f"{kind}response", [digest], F.concat(http, F.col("html")))
    )
    request = _record("request", _derived(uuid, "request"), date, F.col("url"), f"{kind}request", of, asked)
    about = _record("metadata", _derived(uuid, "metadata"), date, F.col("url"), "application/json", of, F.to_json(F.struct("id")))
    # A record's two line ends are what the writer puts after each row.
    lines = rows.select(F.explode(F.array(request, main, about)).alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    discard(pages_, groups)


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(header lines, block) of each record of one archive, from its bytes cut at _CUT.

    Records are told apart by their lengths alone: a cut inside a block is undone, and records
    between which the reader made no cut are found too. Anything else is an error.
    """
    cut = _CUT.encode()
    parts: list[bytes] = []
    size = need = 0
    first = True
    for piece in pieces:
        if first:
            if not piece.strip():
                continue
            if not piece.startswith(b"WARC/"):
                raise ValueError("not a WARC archive")
            piece, first = piece[5:], False
        if parts:
            parts.append(cut)
        parts.append(piece)
        size += len(piece) + (len(cut) if len(parts) > 1 else 0)
        while size >= need:
            whole = b"".join(parts) if len(parts) > 1 else parts[0]
            end = whole.find(b"\r\n\r\n")
            if end < 0:
                parts, need = [whole], size + 1
                break
            head = _headers(whole[:end])
            length = next((v for k, v in head if k == "content-length"), "")
            if not length.isdigit():
                raise ValueError("a WARC record without Content-Length")
            need = end + 4 + int(length)
            if size < need:
                parts = [whole]
                break
            yield head, whole[end + 4 : need]
            rest = whole[need:]
            parts, size, need = [], 0, 0
            if rest in (b"", b"\r\n\r\n"):
                break
            if not rest.startswith(cut):
                raise ValueError("a WARC record is longer than its Content-Length")
            parts = [rest[len(cut) :]]
            size = len(parts[0])
    if parts:
        raise ValueError("an archive ends inside a record")


def _headers(raw: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
            continue
        name, _, value = line.partition(":")
        out.append((name.strip().lower(), value.strip()))
    return out


def _row(head: list[tuple[str, str]], block: bytes, with_payload: bool) -> tuple:
    of = dict(head)
    kind = of.get("content-type", "")
    http = fields = None
    payload: bytes | None = block
    if kind.startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = top.decode("utf-8", "replace")
    elif of.get("warc-type") == "metadata":
        fields, payload = block.decode("utf-8", "replace"), None
    digest = (None, None) if payload is None else (len(payload), hashlib.sha1(payload).hexdigest())
    also = [v for k, v in head if k == "warc-concurrent-to"]
    return of.get("warc-record-id"), of.get("warc-type"), of.get("warc-target-uri"), of.get("warc-date"), also, of.get("warc-refers-to"), of.get("warc-payload-digest"), kind, http, *digest, payload if with_payload else None, fields


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives under ``path``, plain or compressed as a whole or record by record.

    payload_bytes and payload_sha1 are those of the payload that was read, whatever the header
    says. Without ``with_payload`` the payload itself is left out where it was read, so that what
    needs no more than its digest doesn't store and shuffle it.

    Spark's own text reader streams the archives, cut where records seem to begin, so that any
    store that Spark reads will do and a task holds a record at a time. A compressed archive is
    one task's; the pieces of plain ones, which are split, are put in order by archive first.
    """
    import pyarrow as pa

    importable(spark)
    meta = ["file_path", "file_block_start"]
    pieces = spark.read.option("lineSep", _CUT).text(path).select(F.col("value").cast("binary").alias("value"), *[F.col(f"_metadata.{m}").alias(m) for m in meta])
    names = spark.read.format("binaryFile").load(path).select("path")
    if names.where(~F.lower("path").rlike("\\.(gz|zst|deflate|lz4|snappy)$")).isEmpty():
        pieces = pieces.select("value", "file_path")
    else:
        pieces = pieces.withColumn("at", F.monotonically_increasing_id()).repartition("file_path").sortWithinPartitions("file_path", "file_block_start", "at").select("value", "file_path")
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    columns = [c.split()[0] for c in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        def cuts() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                for value, file in zip(batch.column(0), batch.column(1), strict=True):
                    yield file.as_py(), value.as_py()

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=columns)

        rows, size = [], 0
        for _, group in groupby(cuts(), key=lambda x: x[0]):
            for head, block in parse(v for _, v in group):
                rows.append(_row(head, block, with_payload))
                size += (len(block) if with_payload else 0) + 500
                if size >= BATCH_BYTES:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    return pieces.mapInArrow(trimmed(run), _SCHEMA)


def captures(records: DataFrame) -> DataFrame:
    """A nested row per capture: capture_id, record_type, target_uri, date, refers_to, digest, response, requests, metadata.

    ``records`` is what ``read_records`` gives. response is a struct of http, payload_bytes,
    payload_sha1 and payload, the other two are arrays, sorted by record identifier, of structs. Requests and metadata belong
    to the response, revisit or resource that they name as concurrent or that names them; records
    that name each other in some longer way belong together too, and those whose capture has no
    main record make a row without response. A capture's records make one row, so they have to fit
    into one. Records without an identifier and those of other types are left out, and a main
    record that occurs several times makes a row each time.
    """
    spark = records.sparkSession
    records = stored(records.where("record_id is not null").withColumn("main", F.col("type").isin(*MAIN)).where(F.col("main") | F.col("type").isin("request", "metadata")))
    main, others = records.where("main"), records.where("not main")
    ids = main.select(F.col("record_id").alias("key")).distinct()
    links = records.select("record_id", "main", F.explode("concurrent_to").alias("to"))
    named = links.where("not main").select(F.col("record_id").alias("member"), F.col("to").alias("key")).join(ids, "key", "left_semi")
    naming = links.where("main").select(F.col("to").alias("member"), F.col("record_id").alias("key")).join(ids.withColumnRenamed("key", "member"), "member", "left_anti")
    of = stored(named.select("member", "key").unionByName(naming).distinct())
    far = stored(others.select("record_id").join(of.select(F.col("member").alias("record_id")), "record_id", "left_anti").distinct())
    if not far.isEmpty():
        parts = connected_components(links.select(F.col("record_id").alias("a"), F.col("to").alias("b")))
        known = parts.join(records.select(F.col("record_id").alias("node"), "main").distinct(), "node")
        of_part = known.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("main"), F.col("node"))), F.min("node")).alias("key"))
        of_node = parts.join(of_part, "component").select(F.col("node").alias("record_id"), "key")
        found = far.join(of_node, "record_id", "left").select(F.col("record_id").alias("member"), F.coalesce("key", "record_id").alias("key"))
        of = stored(of.unionByName(found))
    request = F.when(F.col("type") == "request", F.struct("record_id", "http", "payload"))
    about = F.when(F.col("type") == "metadata", F.struct("record_id", "content_type", "fields"))
    members = others.select(F.col("record_id").alias("member"), request.alias("request"), about.alias("about")).join(of, "member")
    members = members.groupBy("key").agg(F.sort_array(F.collect_list("request")).alias("requests"), F.sort_array(F.collect_list("about")).alias("metadata"))
    out = main.join(members, F.col("record_id") == F.col("key"), "full_outer")
    empty = [F.coalesce(c, F.array().cast(members.schema[c].dataType)).alias(c) for c in ("requests", "metadata")]
    response = F.when(F.col("record_id").isNotNull(), F.struct("http", "payload_bytes", "payload_sha1", "payload"))
    return out.select(F.coalesce("record_id", "key").alias("capture_id"), F.col("type").alias("record_type"), "target_uri", "date", "refers_to", "digest", response.alias("response"), *empty)


def resolved(found: DataFrame, id_type: str = "long") -> DataFrame:
    """(id, record_type, payload_bytes, payload_digest, refers_to) of ``captures``: a revisit's payload is that of the capture it refers to.

    id comes from the metadata record that ``write_warc`` made, null where there is none;
    refers_to is the id of the response. Where a revisit refers to a record that isn't there,
    the digest is the one that it states and the rest is null.
    """
    about = F.from_json(F.filter("metadata", lambda m: m["content_type"] == "application/json")[0]["fields"], f"id {id_type}")
    own = F.when(F.col("record_type") != "revisit", F.col("response"))
    rows = found.select(
        "capture_id", about["id"].alias("id"), "record_type", F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("key"),
        own["payload_bytes"].alias("size"), own["payload_sha1"].alias("sha1"), F.regexp_replace("digest", "^sha1:", "").alias("stated"),
    )
    rows = stored(rows)
    asked = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    there = rows.where("record_type <> 'revisit'").select(F.col("capture_id").alias("key"), F.struct(F.col("id").alias("id"), "size", "sha1").alias("of"))
    targets = stored(asked.join(there.groupBy("key").agg(F.max("of").alias("of")), "key"))
    rows = attach(rows, targets, "key")
    again = F.col("record_type") == "revisit"
    return rows.select(
        "id", "record_type", F.when(again, F.col("of.size")).otherwise(F.col("size")).alias("payload_bytes"),
        F.when(again, F.coalesce("of.sha1", "stated")).otherwise(F.col("sha1")).alias("payload_digest"), F.col("of.id").alias("refers_to"),
    )
