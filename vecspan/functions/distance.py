"""Distances between vectors: Column builders, numpy kernels and the equal SQL text.

All three forms widen to double and add terms from the first component to the last, so that
their values agree to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

METRICS = ("l2_sq", "l1", "cosine")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _fold(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), term), F.lit(0.0), lambda s, x: s + x)


def l2_sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_sq(a, b))


def l1(a: Column, b: Column) -> Column:
    """Manhattan distance."""
    return _fold(a, b, lambda x, y: F.abs(x - y))


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def sq_norm(a: Column) -> Column:
    return dot(a, a)


def cosine(a: Column, b: Column) -> Column:
    """Cosine distance; null where a norm is zero."""
    scale = F.sqrt(sq_norm(a)) * F.sqrt(sq_norm(b))
    return F.when(scale != 0, F.lit(1.0) - dot(a, b) / scale)


def l2_int(a: Column, b: Column) -> Column:
    """Truncated Euclidean distance of integer vectors, accumulated in 64 bits."""
    longs = F.zip_with(a.cast("array<bigint>"), b.cast("array<bigint>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(longs, F.lit(0).cast("bigint"), lambda s, x: s + x).cast("double")).cast("bigint")


def finite(v: Column) -> Column:
    """Whether a vector and all its components are there and finite; others have no distance to anything."""
    return v.isNotNull() & F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def metric(name: str) -> Callable[[Column, Column], Column]:
    """The Column builder of a metric; an unknown name is an error."""
    known = {"l2_sq": l2_sq, "l1": l1, "cosine": cosine}
    if name not in known:
        raise ValueError(f"unknown metric {name!r}; one of {', '.join(METRICS)}")
    return known[name]


def sql(name: str, a: str, b: str) -> str:
    """The same distance as SQL over two DOUBLE[] expressions."""

    def fold(x: str, y: str, term: str) -> str:
        return f"list_sum(list_transform(list_zip({x}, {y}), lambda p: {term}))"

    if name == "l2_sq":
        return fold(a, b, "(p[1] - p[2]) * (p[1] - p[2])")
    if name == "l1":
        return fold(a, b, "abs(p[1] - p[2])")
    if name == "dot":
        return fold(a, b, "p[1] * p[2]")
    if name == "cosine":
        scale = f"(sqrt({sql('dot', a, a)}) * sqrt({sql('dot', b, b)}))"
        return f"CASE WHEN {scale} <> 0 THEN 1.0::DOUBLE - {sql('dot', a, b)} / {scale} END"
    raise ValueError(name)


def exact(x, y, name: str):
    """Distances of paired rows, added in order as the Column form does."""
    import numpy as np

    def total(terms):
        return np.cumsum(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))

    if name == "l2_sq":
        return total((x - y) * (x - y))
    if name == "l1":
        return total(np.abs(x - y))
    scale = np.sqrt(total(x * x)) * np.sqrt(total(y * y))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(scale != 0, 1.0 - total(x * y) / scale, np.nan)


def every(x, y, name: str, step: int = 1024):
    """(rows of x, columns of y): distances of every row of ``x`` to every column of ``y``, terms added in order as the Column form does."""
    import numpy as np

    if y.shape[1] == 1:  # sums down a single column would be pairwise
        return every(x, np.repeat(y, 2, axis=1), name, step)[:, :1]
    out = np.empty((len(x), y.shape[1]))
    for c in range(0, y.shape[1], step):
        at = min(c, y.shape[1] - 2)  # two columns at least
        part = np.ascontiguousarray(y[:, at : c + step])
        terms, sums = np.empty_like(part), out[:, at : c + step]
        for i, q in enumerate(x[:, :, None]):
            if name == "cosine":
                np.add.reduce(np.multiply(part, q, out=terms), axis=0, out=sums[i])
                continue
            np.subtract(part, q, out=terms)
            np.abs(terms, out=terms) if name == "l1" else np.multiply(terms, terms, out=terms)
            np.add.reduce(terms, axis=0, out=sums[i])
    if name == "cosine":
        norms = np.zeros(y.shape[1])
        for component in y:
            norms += component * component
        scale = np.sqrt(np.cumsum(x * x, axis=1)[:, -1:] if x.shape[1] else np.zeros((len(x), 1))) * np.sqrt(norms)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(scale != 0, 1.0 - out / scale, np.nan)
    return out


#: Rows of ``y`` from which ``nearest`` takes its first bound.
HEAD = 8192
#: Largest squared norms between which ``nearest`` starts in single precision: sums neither overflow nor lose all digits.
SINGLE = (1e-20, 1e30)


def nearest(x, y, k: int, name: str, block: int = 1 << 20, bound=None):
    """For each row of ``x`` the k nearest rows of ``y``: (row of x, row of y, distance).

    A matrix product (or plain sums for l1) finds all rows that can be among the k nearest
    within its rounding; only those get exact distances. The k-th of the first HEAD rows bounds
    what is looked at of the others, as does ``bound``, a distance for each row of ``x``: rows beyond it may
    be left out. The product for l2_sq is one of single precision, and again of double precision where
    the former's rounding leaves too many. Ties go to the lower row of ``y``, and rows without a distance are
    left out, as are rows with a component that isn't finite.
    """
    import numpy as np

    use_x, use_y = np.isfinite(x).all(1), np.isfinite(y).all(1)
    if not (use_x.all() and use_y.all()):
        i, j, d = nearest(x[use_x], y[use_y], k, name, block, None if bound is None else bound[use_x])
        return np.flatnonzero(use_x)[i], np.flatnonzero(use_y)[j], d
    rows, cols, dist = [], [], []
    k = min(k, len(y))
    step = max(1, block // max(1, min(len(y), HEAD) * (x.shape[1] if name == "l1" else 1)))
    middle = y.mean(0) if name == "l2_sq" and k else 0.0
    near_y = _Rows(y, name, middle)
    for at in range(0, len(x) if k else 0, step):
        q = x[at : at + step]
        most = None if bound is None else bound[at : at + step]
        few = near_y.within(_Rows(q, name, middle), k, most, np.float32) if name == "l2_sq" else None
        i, j = few or near_y.within(_Rows(q, name, middle), k, most, np.float64)
        d = np.concatenate([exact(q[i[s : s + 16384]], y[j[s : s + 16384]], name) for s in range(0, len(i), 16384)]) if len(i) else np.zeros(0)
        ok = ~np.isnan(d)
        i, j, d = i[ok], j[ok], d[ok]
        by = np.lexsort((j, d, i))
        i, j, d = i[by], j[by], d[by]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        rows.append(i[keep] + at)
        cols.append(j[keep])
        dist.append(d[keep])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


class _Rows:
    """One side of ``nearest``: vectors, from the ``middle`` of a side for l2_sq, and what a product needs of them."""

    def __init__(self, v, name: str, middle):
        self.name, self.v = name, v - middle if name == "l2_sq" else v
        self.sq = (self.v * self.v).sum(1)
        self.wide: dict = {}

    def widened(self, kind):
        """The vectors with their squared norm as a last component: products with (-2 q, 1) are |y - q|^2 - |q|^2."""
        import numpy as np

        if kind not in self.wide:
            self.wide[kind] = np.concatenate([self.v, self.sq[:, None]], 1).astype(kind)
        return self.wide[kind]

    def within(self, q: _Rows, k: int, bound, kind):
        """(row of q, own row) of all that can be among the k nearest of q and within ``bound``; None where single precision can't tell enough of them apart."""
        import numpy as np

        name, n = self.name, len(self.v)
        scale = q.sq.max() + self.sq.max()
        slack = 1e-10
        if name == "l2_sq":
            if kind == np.float32 and not SINGLE[0] < scale < SINGLE[1]:
                return None
            # A sum of so many terms is off by half an epsilon each at most; each factor was rounded too.
            slack = 4 * (q.v.shape[1] + 8) * float(np.finfo(np.float32).eps) * scale if kind == np.float32 else 1e-10 * (scale + 1e-300)
            asked = np.concatenate([-2 * q.v, np.ones((len(q.v), 1))], 1).astype(kind)
            less = q.sq  # what the products lack
        else:
            less = np.zeros(len(q.v))
        most = np.full(len(q.v), np.inf) if bound is None else bound + slack - less
        found, total = [], 0
        for c in range(0, n, HEAD):
            if name == "l2_sq":
                rough = asked @ self.widened(kind)[c : c + HEAD].T
            elif name == "l1":
                rough = np.abs(q.v[:, None, :] - self.v[None, c : c + HEAD, :]).sum(2)
                most = most + 1e-10 * (rough.max() + 1e-300)
            else:
                with np.errstate(divide="ignore", invalid="ignore"):
                    rough = 1 - (q.v @ self.v[c : c + HEAD].T) / (np.sqrt(q.sq)[:, None] * np.sqrt(self.sq[c : c + HEAD]))
                rough = np.where(np.isfinite(rough), rough, np.inf)
            limit = most[:, None].astype(kind)  # single precision: rounded by far less than the slack
            near = np.flatnonzero(rough <= limit)
            if c == 0 and k <= rough.shape[1] and len(near) > 4 * k * len(q.v):
                extra = 1e-10 * (rough.max() + 1e-300) if name == "l1" else slack
                most = np.minimum(most, np.partition(rough, k - 1, axis=1)[:, k - 1] + extra)
                near = np.flatnonzero(rough <= most[:, None].astype(kind))
                if kind == np.float32 and len(near) > 4 * k * len(q.v):
                    return None
            i, j = np.divmod(near, rough.shape[1])
            found.append((i, j + c, rough.ravel()[near]))
            total += len(near)
        i, j, r = (np.concatenate(z) for z in zip(*found, strict=True))
        if len(found) > 1 and name != "l1":  # what is beyond the k-th of all parts goes before the exact distances
            by = np.lexsort((r, i))
            i, j, r = i[by], j[by], r[by]
            start = np.searchsorted(i, np.arange(len(q.v)))
            many = np.bincount(i, minlength=len(q.v))
            kth = np.full(len(q.v), np.inf)
            kth[many >= k] = r[start[many >= k] + k - 1]
            keep = r <= kth[i] + slack
            i, j = i[keep], j[keep]
            if kind == np.float32 and len(i) > 16 * k * len(q.v):
                return None
        return i, j


def totals(name: str, x: list[Column], y: list[Column]) -> Column:
    """The same distance between vectors whose components are columns, which is compiled where arrays are interpreted."""

    def total(terms: list[Column]) -> Column:
        out = F.lit(0.0)
        for t in terms:
            out = out + t
        return out

    if name == "l2_sq":
        return total([(a - b) * (a - b) for a, b in zip(x, y, strict=True)])
    if name == "l1":
        return total([F.abs(a - b) for a, b in zip(x, y, strict=True)])
    scale = F.sqrt(total([a * a for a in x])) * F.sqrt(total([b * b for b in y]))
    return F.when(scale != 0, F.lit(1.0) - total([a * b for a, b in zip(x, y, strict=True)]) / scale)


def total_int(x: list[Column], y: list[Column]) -> Column:
    """``l2_int`` between vectors whose components are bigint columns."""
    out = F.lit(0).cast("bigint")
    for a, b in zip(x, y, strict=True):
        out = out + (a - b) * (a - b)
    return F.sqrt(out.cast("double")).cast("bigint")


def register(spark: SparkSession) -> None:
    """SQL functions l2_sq, l1, cosine_distance and l2_int over two array arguments."""
    fold = "aggregate(zip_with(CAST(a AS ARRAY<DOUBLE>), CAST(b AS ARRAY<DOUBLE>), (x, y) -> {}), 0D, (s, t) -> s + t)"
    dots = "aggregate(transform(CAST({0} AS ARRAY<DOUBLE>), x -> x * x), 0D, (s, t) -> s + t)"
    bodies = {
        "l2_sq": fold.format("(x - y) * (x - y)"),
        "l1": fold.format("abs(x - y)"),
        "cosine_distance": f"1D - {fold.format('x * y')} / nullif(sqrt({dots.format('a')}) * sqrt({dots.format('b')}), 0D)",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    longs = "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0L, (s, t) -> s + t)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION l2_int(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS BIGINT RETURN CAST(sqrt(CAST({longs} AS DOUBLE)) AS BIGINT)")
