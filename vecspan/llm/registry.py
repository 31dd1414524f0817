"""The registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from vecspan.session import work_dir

from . import bpe, chat_format, exact_dedup, langid, lattice, line_dedup, mixing, ngram_join, runs, suffix, toxicity, vector_codes, warc
from .common import table, train_side


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, train=train_side())
    out = langid.identify(docs, model)
    return out.select("doc_id", (~train_side()).alias("held_out"), "lang_pred", "score")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    out = chat_format.format_chats(turns.unionByName(extra))
    back = chat_format.read_back(F.col("formatted"))
    said = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat_format.loss_text(F.col("segments"))
    return out.select(
        "conv_id",
        F.size(back).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), ["doc_id", "source"], entropy=0.95, repeats=4.0, budget=1.0)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train_side())
    return toxicity.score(docs, model).select("doc_id", (~train_side()).alias("held_out"), "score", "predicted")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), digest=True)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_texts(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.drop_repeats(table(spark, sf_dir, "documents"), digest=True)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = work_dir(spark, "warc")
    warc.write_warc(pages, path)
    out = warc.resolved(warc.captures(warc.read_records(spark, path, with_payload=False)), pages.schema["page_id"].dataType.simpleString())
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.fingerprint(book)).alias("codebooks_sha256"))


def _planted(doc_id: Column, text: Column) -> Column:
    """The texts of op13: in one of ten, words from some place on are replaced by a cycle of those that follow it."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def cycled(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))

    words = F.array(F.regexp_extract_all(text, F.lit("[^ \\t-\\r]+"), F.lit(0)))  # bound once, as the outer element
    changed = F.array_join(F.transform(words, lambda w: F.when(F.size(w) > 0, F.array_join(cycled(w), " ")).otherwise("")), "")
    return F.when(h % 10 == 0, changed).otherwise(text)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = runs.periodic_runs(docs.select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    # The longest run; of equal ones that of smallest start, then period.
    ordered = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), ordered.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.floor(F.col("top.length") * 1000 / -F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


_OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), dup AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT doc_id, line, pos, owner IS NOT NULL AND owner <> doc_id AS gone FROM keyed LEFT JOIN dup USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(6 + 2 + 8 + length(replace(replace(replace(role, '\', '\-'), '<', '\l'), '>', '\g'))
      + length(replace(replace(replace(text, '\', '\-'), '<', '\l'), '>', '\g'))) AS formatted_chars,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS path
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars, regexp_full_match(path, 's?(ua)+') AS valid
FROM g
"""

_OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS n,
    ('0x' || substr(md5('1:' || coalesce(source, '∅') || ':' || doc_id || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT % 1024 AS block,
    md5('1:row:' || doc_id || ':' || md5(coalesce(text, ''))) AS h
  FROM documents
), sized AS (SELECT source, block, sum(n)::BIGINT AS bt FROM d GROUP BY source, block
), src AS (SELECT source, sum(bt)::BIGINT AS t FROM sized GROUP BY source
), sh AS (SELECT source, t, (sum(t) OVER ())::BIGINT AS total, t::DOUBLE / (sum(t) OVER ())::DOUBLE AS p FROM src WHERE t > 0
), ps AS (SELECT list(p ORDER BY p) AS ps, count(*) AS k FROM sh
), even(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 8.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN flat THEN mid ELSE lo END, CASE WHEN flat THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      ln(list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))))
        - (lo + hi) / 2 * list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2) * ln(p))) / list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2)))
        > 0.95 * ln(k) AS flat
    FROM even, ps WHERE i < 60)
), often(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN more THEN mid ELSE lo END, CASE WHEN more THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      pow(list_min(ps), (lo + hi) / 2 - 1) / list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) > 4.0 AS more
    FROM often, ps WHERE i < 60)
), solved AS (
  SELECT greatest((SELECT hi FROM even WHERE i = 60), (SELECT hi FROM often WHERE i = 60)) AS a
), z AS (SELECT a, list_sum(list_transform(ps, lambda p: pow(p, a))) AS z FROM solved, ps
), quota AS (SELECT source, t, floor(pow(p, a) / z * total + 1e-6)::BIGINT AS b FROM sh, z
), plan AS (
  SELECT source, b // t AS fulls, b % t AS rest FROM quota
  UNION ALL SELECT source, 1, 0 FROM src WHERE t = 0
), epochs AS (
  SELECT s.source, block, bt, fulls, rest, unnest(range(0, fulls + 1)) AS epoch FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), ranked AS (
  SELECT *, row_number() OVER w AS block_rank, sum(bt) OVER w - bt AS before FROM epochs
  WINDOW w AS (PARTITION BY source, epoch ORDER BY md5('1:' || epoch || ':' || coalesce(source, '∅') || ':' || block), block ROWS UNBOUNDED PRECEDING)
), taken AS (
  SELECT source, block, epoch, block_rank,
    CASE WHEN epoch < fulls OR (rest > 0 AND before + bt <= rest) THEN -1 WHEN epoch = fulls AND before < rest THEN rest - before END AS room
  FROM ranked
), rows_ AS (
  SELECT doc_id, d.source, epoch, block_rank, room,
    sum(n) OVER (PARTITION BY d.source, epoch, d.block ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN taken t ON d.source IS NOT DISTINCT FROM t.source AND d.block = t.block WHERE room IS NOT NULL
)
SELECT doc_id, source, epoch, block_rank FROM rows_ WHERE room < 0 OR upto <= room
"""

_OP4_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

_OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT x, r FROM reach JOIN link ON y = reach.doc_id
)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

_OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.n * b.n) >= 0.93
), reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT x, r FROM reach JOIN link ON y = reach.vec_id
), least AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id
), links AS (SELECT x AS vec_id, count(*) AS n_links FROM link GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN links USING (vec_id)
"""

_OP7_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), n AS (SELECT doc_id, h, (length(h) // 2)::BIGINT AS n FROM d
), k AS MATERIALIZED (
  SELECT doc_id, i, md5(substring(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM n WHERE n >= 200)
), r AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1
), s AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM k SEMI JOIN r USING (k)
), g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s
), gone AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, g
), kept AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b, 1 AS span FROM gone
  UNION ALL SELECT doc_id, coalesce(max(b), 0), any_value(n), 0 FROM n LEFT JOIN gone USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, any_value(n) AS n_bytes, (any_value(n) - sum(b - a))::BIGINT AS n_removed, sum(span)::BIGINT AS n_spans,
  sha256(unhex(string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a))) AS kept_sha256
FROM kept JOIN n USING (doc_id) GROUP BY doc_id
"""

_OP11_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest) AS first FROM p
)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN size >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN size >= 1000 AND page_id <> first THEN first END AS refers_to
FROM g
"""

_NEAREST = """a{r} AS MATERIALIZED (
  SELECT vec_id, p.part, v, entry, list_sum(list_transform(list_zip(v, e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d
  FROM p JOIN b{r} b ON p.part = b.part QUALIFY row_number() OVER (PARTITION BY vec_id, p.part ORDER BY d, entry) = 1
)"""
_MOVED = """m{r} AS (
  SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY pos) AS e FROM (
    SELECT part, entry, pos, sum(x)::DOUBLE AS s, count(*)::DOUBLE AS n FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{r}) GROUP BY part, entry, pos
  ) GROUP BY part, entry
), b{s} AS MATERIALIZED (SELECT part, entry, coalesce(m.e, b.e) AS e FROM b{r} b LEFT JOIN m{r} m USING (part, entry))"""
_OP12_SQL = (
    """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS v FROM v, (SELECT unnest(range(0, 16)) AS part)
), b0 AS MATERIALIZED (
  SELECT part, entry, v AS e FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 64) USING (vec_id)
), """
    + ",\n".join([_NEAREST.format(r=0), _MOVED.format(r=0, s=1), _NEAREST.format(r=1), _MOVED.format(r=1, s=2), _NEAREST.format(r=2)])
    + """, c AS (
  SELECT vec_id, string_agg(lower(format('{:02x}', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id
), f AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS h FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM c JOIN v USING (vec_id), f
"""
)

_OP13_SQL = r"""
WITH RECURSIVE h AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS ws,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295) AS h
  FROM documents
), g AS (SELECT doc_id, ws, h, h // 10 AS g, len(ws) AS n FROM h
), ap AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM g
), t AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM ap
), q AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + 4], ' ')) AS w FROM (SELECT doc_id, ws, unnest(range(0, n - 3)) AS i FROM t WHERE n >= 12)
), e AS (
  SELECT a.doc_id, a.i, b.i - a.i AS p FROM q a JOIN q b ON a.doc_id = b.doc_id AND a.w = b.w AND a.i < b.i
), island AS (
  SELECT doc_id, p, min(i) AS s, max(i) + 4 + p AS e FROM (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM e) GROUP BY doc_id, p, k
), run AS MATERIALIZED (
  SELECT doc_id, s, e - s AS len, min(p) AS p FROM island WHERE e - s >= greatest(12, 2 * p) GROUP BY doc_id, s, e
), sums AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS lines, arg_min({'s': s, 'l': len, 'p': p}, {'l': -len, 's': s, 'p': p}) AS top FROM run GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + len)) AS i FROM run
), kept AS (
  SELECT t.doc_id, string_agg(ws[i + 1], ' ' ORDER BY i) AS c FROM (SELECT doc_id, ws, unnest(range(0, n)) AS i FROM t) t LEFT JOIN gone USING (doc_id, i) WHERE gone.doc_id IS NULL GROUP BY t.doc_id
)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.p AS period, 1000 * top.l // top.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM t LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_language_id": (op1_language_id, None),
    "op2_chat_format": (op2_chat_format, _OP2_SQL),
    "op3_mixing": (op3_mixing, _OP3_SQL),
    "op4_exact_dedup": (op4_exact_dedup, _OP4_SQL),
    "op5_toxicity": (op5_toxicity, None),
    "op6_embedding_near_dedup": (op6_embedding_near_dedup, _OP6_SQL),
    "op7_suffix_dedup": (op7_suffix_dedup, _OP7_SQL),
    "op8_bpe": (op8_bpe, None),
    "op9_line_dedup": (op9_line_dedup, _OP9_SQL),
    "op10_ngram_join": (op10_ngram_join, _OP10_SQL),
    "op11_warc": (op11_warc, _OP11_SQL),
    "op12_vector_codes": (op12_vector_codes, _OP12_SQL),
    "op13_runs": (op13_runs, _OP13_SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
