"""Temperature mixing of sources, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored

#: Sources whose shares one row may hold; beyond it each bisection step is an aggregation.
MOST_SOURCES = 100_000
#: Rows of a block plan that may be broadcast (about 60 bytes each); beyond it the plan is joined by shuffle.
MOST_PLAN_ROWS = 100_000
BLOCKS, _STEPS, _HOTTEST = 1024, 60, 8.0
#: Parts of a block in which a budget ends.
SUBS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("∅")) for p in parts)))


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _exponent(shares: Column, entropy: float | None, repeats: float | None, cover: bool, scale: float) -> Column:
    """Bisect the exponent over an array of positive shares that sum to 1."""

    def total(f):
        return F.aggregate(shares, F.lit(0.0), lambda s, p: s + f(p))

    def step(too_small):
        return lambda ends, _: F.when(too_small((ends["lo"] + ends["hi"]) / 2), F.struct(((ends["lo"] + ends["hi"]) / 2).alias("lo"), ends["hi"].alias("hi"))).otherwise(F.struct(ends["lo"].alias("lo"), ((ends["lo"] + ends["hi"]) / 2).alias("hi")))

    def bisect(high: float, too_small) -> Column:
        ends = F.struct(F.lit(0.0).alias("lo"), F.lit(high).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), ends, step(too_small), lambda e: e["hi"])

    found = F.lit(0.0)
    if entropy is not None:
        def flat(a: Column) -> Column:  # still more even than wanted
            z, zl = total(lambda p: F.pow(p, a)), total(lambda p: F.pow(p, a) * F.ln(p))
            return F.ln(z) - a * zl / z > entropy * F.ln(F.size(shares))

        found = bisect(_HOTTEST, flat)
    if repeats is not None:
        def often(a: Column) -> Column:  # the smallest source repeats too often
            if cover:
                return F.pow(F.array_max(shares) / F.array_min(shares), 1 - a) > repeats
            return scale * F.pow(F.array_min(shares), a - 1) / total(lambda p: F.pow(p, a)) > repeats

        found = F.greatest(found, bisect(1.0, often))
    if entropy is None and repeats is None:
        found = F.lit(1.0)
    return found


def _exponent_by_steps(shares: DataFrame, entropy, repeats, cover: bool, scale: float) -> float:
    """The same bisection with one aggregation a step, for any number of sources (column p)."""
    import math

    n, low, high = shares.agg(F.count("*"), F.min("p"), F.max("p")).first()

    def sums(a: float) -> tuple[float, float]:
        return tuple(shares.agg(F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.ln("p"))).first())

    def bisect(hi: float, too_small) -> float:
        lo = 0.0
        for _ in range(_STEPS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if too_small(mid) else (lo, mid)
        return hi

    def flat(a: float) -> bool:
        z, zl = sums(a)
        return math.log(z) - a * zl / z > entropy * math.log(n)

    def often(a: float) -> bool:
        return (high / low) ** (1 - a) > repeats if cover else scale * low ** (a - 1) / sums(a)[0] > repeats

    found = bisect(_HOTTEST, flat) if entropy is not None else 0.0
    if repeats is not None:
        found = max(found, bisect(1.0, often))
    return 1.0 if entropy is None and repeats is None else found


def _quotas(sources: DataFrame, count: int, entropy, repeats, cover: bool, scale: float) -> DataFrame:
    """(s, full, rest): whole epochs, and tokens of the last one, of each source with tokens."""
    some = sources.where("t > 0")
    total = some.agg(F.sum("t")).first()[0]
    shares = some.select("s", "t", (F.col("t") / F.lit(total)).alias("p"))
    if count <= MOST_SOURCES:
        solved = shares.agg(F.sort_array(F.collect_list("p")).alias("ps")).select("ps", _exponent(F.col("ps"), entropy, repeats, cover, scale).alias("a"))
        solved = solved.select("a", F.aggregate("ps", F.lit(0.0), lambda z, p: z + F.pow(p, F.col("a"))).alias("z"), F.array_max("ps").alias("top"), F.array_min("ps").alias("low"))
    else:
        a = _exponent_by_steps(shares, entropy, repeats, cover, scale)
        solved = shares.agg(F.sum(F.pow("p", F.lit(a))).alias("z"), F.max("p").alias("top"), F.min("p").alias("low")).withColumn("a", F.lit(a))
    r = solved.first()  # four numbers
    # Where every source is covered, the one with the most budget wanted for a token it has sets the scale.
    unit = max(r.top ** (1 - r.a), r.low ** (1 - r.a)) * r.z if cover else scale
    plan = shares.select("s", "t", F.floor(F.pow("p", F.lit(r.a)) / F.lit(r.z) * F.lit(unit) * F.lit(total) + 1e-6).cast("long").alias("b"))
    if cover:
        plan = plan.withColumn("b", F.greatest("t", "b"))  # rounding must not cost a source its last document
    return plan.select("s", F.expr("b div t").alias("full"), F.expr("b % t").alias("rest"))


def mix(docs: DataFrame, keep: list[str], source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", entropy: float | None = None, repeats: float | None = None, budget: float | str = 1.0, seed: int = 1, blocks: int = BLOCKS, order: bool = True) -> DataFrame:
    """The realised mixture: ``keep`` columns, and with ``order`` also epoch and block_rank.

    Source shares of tokens (words) are raised to an exponent and normalised. The exponent is
    the least one, up to the natural 1 for the second, that has an entropy of at most
    ``entropy`` * ln(sources) and lets no source be read more than ``repeats`` times.
    ``budget``: tokens to realise, as a multiple of all tokens; or "cover", the least with which
    every source is read whole at least once.

    A source's rows are dealt by hash into ``blocks`` blocks; each epoch reads the blocks in a
    permutation of its own. Whole epochs are read while the source's budget lasts; the last one
    stops in the block where the budget ends, after the rows in hash order that still fit. This
    is a sampling operator, and rows beyond a source's budget are left out by its definition.

    A null source is a source of its own, and a null text has no tokens; a source without
    tokens is read once. Hashes are of id and text, so that rows without an id and texts that share
    one are dealt and ordered as other rows are, the same way however the table is partitioned. Rows
    that repeat both count each, and are taken for one another where a budget ends between them. A text of any length is
    read whole. An empty table gives an empty result; other columns may have any names.

    The hot source is one of many (source, block) keys. The plan has a row per source, epoch and
    block; it is broadcast up to MOST_PLAN_ROWS rows, so that texts aren't shuffled but for the
    part of a block in which a budget ends: such a block is cut into SUBS parts in the order of
    its rows' hashes, and rows are only ranked in the part that holds the end.
    """
    cover = budget == "cover"
    names = [f"k{i}" for i in range(len(keep))]
    rows = pick(docs, **dict(zip(names, keep, strict=True)), source=source_col, id=id_col, text=text_col)
    rows = rows.withColumn("block", _number(_hash(F.lit(seed), F.col("source"), F.col("id"), _digest(F.col("text")))) % blocks)
    sized = stored(rows.select(F.col("source").alias("s"), F.col("block").alias("b"), word_count(F.col("text")).alias("n")).groupBy("s", "b").agg(F.sum("n").alias("bt")))
    sources = stored(sized.groupBy("s").agg(F.sum("bt").alias("t")))
    count = sources.where("t > 0").count()
    scale = 1.0 if cover else float(budget)
    free = sources.where("t = 0").select("s", F.lit(1).cast("long").alias("full"), F.lit(0).cast("long").alias("rest"))
    plan = free if not count else _quotas(sources, count, entropy, repeats, cover, scale).unionByName(free)
    by_epoch = sized.join(plan.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2"))).select("s", "b", "bt", "full", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))).alias("epoch"))
    w = Window.partitionBy("s", "epoch").orderBy(_hash(F.lit(seed), F.col("epoch"), F.col("s"), F.col("b")), "b")
    ranked = by_epoch.select("s", "b", "epoch", "full", "rest", "bt", F.row_number().over(w).cast("long").alias("block_rank"), (F.sum("bt").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bt")).alias("before"))
    taken = F.when((F.col("epoch") < F.col("full")) | ((F.col("rest") > 0) & (F.col("before") + F.col("bt") <= F.col("rest"))), F.lit(-1).cast("long")).when((F.col("epoch") == F.col("full")) & (F.col("before") < F.col("rest")), F.col("rest") - F.col("before"))
    ranked = stored(ranked.select("s", "b", "epoch", "block_rank", taken.alias("room")).where("room is not null"))
    held = ranked.limit(MOST_PLAN_ROWS + 1).count() <= MOST_PLAN_ROWS

    def against(part: DataFrame, *on: Column) -> DataFrame:
        few = held and part.limit(MOST_PLAN_ROWS + 1).count() <= MOST_PLAN_ROWS
        match = (F.col("block") == F.col("b")) & F.col("source").eqNullSafe(F.col("s"))
        for c in on:
            match = match & c
        return rows.join(F.broadcast(part) if few else part, match)

    out = [*names, "epoch", "block_rank"] if order else names
    whole = against(ranked.where("room < 0")).select(*out)
    # The blocks in which a budget ends, cut by the first digits of the hash that orders their rows.
    ended = ranked.where("room >= 0")
    row_hash = _hash(F.lit(seed), F.lit("row"), F.col("id"), _digest(F.col("text")))
    sub = (_number(row_hash) / F.lit(2**32 // SUBS)).cast("long")
    sums = against(ended).groupBy("s", "b", "epoch", "block_rank", "room", sub.alias("sub")).agg(F.sum(word_count(F.col("text"))).alias("n"))
    by = Window.partitionBy("s", "epoch", "b").orderBy("sub").rowsBetween(Window.unboundedPreceding, 0)
    subs = sums.withColumn("before", F.sum("n").over(by) - F.col("n")).where("before <= room")
    subs = stored(subs.select("s", "b", "epoch", "block_rank", "sub", F.when(F.col("before") + F.col("n") <= F.col("room"), F.lit(-1).cast("long")).otherwise(F.col("room") - F.col("before")).alias("room")))
    inside = against(subs, sub == F.col("sub"))
    at = Window.partitionBy("s", "epoch", "b", "sub").orderBy(row_hash, "id", _digest(F.col("text"))).rowsBetween(Window.unboundedPreceding, 0)
    last = inside.where("room >= 0").withColumn("upto", F.sum(word_count(F.col("text"))).over(at)).where("upto <= room")
    result = whole.unionByName(inside.where("room < 0").select(*out)).unionByName(last.select(*out))
    return result.toDF(*keep, *(["epoch", "block_rank"] if order else []))
