"""Registered queries of transforms inside an index and of the inverted multi-index."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspan.functions.distance import sql
from vecspan.operators import evaluate, factory, multi, pq, transform
from vecspan.operators.topk import exact_knn
from vecspan.session import work_dir

from .catalogue import _BASE, _Q, BOOK_ROUNDS, DIM, K, _book_sql, _with, asked, base, query

#: Directions that are kept, entries of a half codebook, and cells visited.
SIZE, HALF, CELLS = 32, 32, 512

_COSINES = f"""t AS MATERIALIZED (SELECT vec_id, label, list(x ORDER BY i) AS e FROM (
  SELECT vec_id, label, i, round(list_sum(list_transform(range(0, {DIM}), lambda j: e[j + 1] * cos(pi() * i * (2 * j + 1) / {2 * DIM}) * sqrt(2.0 / {DIM}))) / CASE WHEN i = 0 THEN sqrt(2.0) ELSE 1.0 END, 9) AS x
  FROM base, (SELECT unnest(range(0, {SIZE})) AS i)) GROUP BY vec_id, label)"""


@query(_with(_BASE, _COSINES, f"p AS (SELECT a.vec_id AS qid, b.vec_id, {sql('l2_sq', 'a.e', 'b.e')} AS dist FROM t a, t b WHERE a.vec_id % 100 = 0)") + f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank, vec_id, round(dist, 7) AS dist FROM p QUALIFY rank <= {K}")
def transformed_search(spark, sf_dir):
    """A transform kept with a table, saved and loaded, and applied to the queries: the first directions of the cosine transform."""
    b = base(spark, sf_dir)
    path = work_dir(spark, "transformed")
    transform.TransformedIndex.build(b, transform.cosines(DIM, SIZE)).save(path)
    return transform.TransformedIndex.load(spark, path).search(asked(b), K).withColumn("dist", F.round("dist", 7))


@query()
def pca_recall(spark, sf_dir):
    """10-recall of searches over the directions of most variance: the table itself, and inverted lists with all lists probed, which find the same."""
    b = base(spark, sf_dir)
    truth = evaluate.others(exact_knn(b, asked(b), K + 1), K)
    out = None
    for key, nprobe in ((f"PCA{SIZE},Flat", None), (f"PCA{SIZE},IVF16,Flat", 16), ("PCA48,Flat", None)):
        index = factory.build(b, key, **({"iterations": 3} if nprobe else {}))
        found = evaluate.others(index.search(asked(b), K + 1, nprobe), K)
        one = evaluate.mean_k_recall(found, truth, K).select(F.lit(key).alias("index"), F.round("recall", 6).alias("recall"))
        out = one if out is None else out.unionByName(one)
    return out


_HALVES = f"""parts AS MATERIALIZED (SELECT vec_id, chunk, list_slice(e, chunk * {DIM // 2} + 1, (chunk + 1) * {DIM // 2}) AS part FROM base, (SELECT unnest(range(0, 2)) AS chunk)),
{_book_sql('parts', HALF)},
h AS (SELECT p.vec_id AS qid, p.chunk, b.code, {sql('l2_sq', 'p.part', 'b.center')} AS d FROM parts p JOIN book b USING (chunk) WHERE p.vec_id % 100 = 0),
cells AS (SELECT x.qid, row_number() OVER (PARTITION BY x.qid ORDER BY x.d + y.d, x.code, y.code) AS rank, x.code * {HALF} + y.code AS cell, x.d + y.d AS dist FROM h x JOIN h y ON x.qid = y.qid AND x.chunk = 0 AND y.chunk = 1 QUALIFY rank <= {CELLS})"""


def _multi(b):
    book = pq.train_codebook(b, 2, DIM, HALF, BOOK_ROUNDS, sample=None, digits=6)
    return multi.MultiIndex.build(b, HALF, codebook=book)


@query(_with(_BASE, _HALVES) + "SELECT qid, rank, cell, dist FROM cells")
def multi_index_cells(spark, sf_dir):
    """The cells that the walk visits, in order: those of the sorted product of both codebooks."""
    b = base(spark, sf_dir)
    return _multi(b).cells(asked(b), CELLS)


@query(
    _with(
        _BASE, _Q, _HALVES,
        f"own AS (SELECT p.vec_id, p.chunk, b.code FROM parts p JOIN book b USING (chunk) QUALIFY row_number() OVER (PARTITION BY p.vec_id, p.chunk ORDER BY {sql('l2_sq', 'p.part', 'b.center')}, b.code) = 1)",
        f"placed AS (SELECT x.vec_id, x.code * {HALF} + y.code AS cell FROM own x JOIN own y ON x.vec_id = y.vec_id AND x.chunk = 0 AND y.chunk = 1)",
        f"found AS (SELECT qid, vec_id, {sql('l2_sq', 'qe', 'e')} AS dist FROM cells JOIN placed USING (cell) JOIN q USING (qid) JOIN base USING (vec_id))",
    )
    + f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank, vec_id, dist FROM found QUALIFY rank <= {K}"
)
def multi_index_search(spark, sf_dir):
    """Search of the cells visited, by whole vectors."""
    b = base(spark, sf_dir)
    return _multi(b).search(asked(b), K, CELLS)
