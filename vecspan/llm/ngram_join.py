"""Jaccard self-join of word n-gram sets by prefix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, discard, packed, pick, release, stored, text_bytes, trimmed, unpacked

#: Bytes of sets, and sets, joined in one tree; larger groups are dealt out in blocks.
BLOCK_BYTES, BLOCK_SETS = 8 << 20, 1024
#: The prefixes of linked sets of n n-grams have n / SPARE in common.
SPARE = 16
#: Groups in which a set looks for its near copies at first.
FIRST_GROUPS = 4
#: Sets of groups that share members, joined in one tree.
CLUSTER_SETS = 4096
#: Rows of what to fetch that may be broadcast (about 30 bytes each); more are joined by shuffle.
MOST_WANTED = 100_000
#: Bytes that the nodes' n-grams may take as bits.
BIT_BYTES = 32 << 20


class PrefixTree:
    """Distinct, globally ordered n-gram sets in a path-compressed trie.

    ``sets``: sorted arrays of small integers that keep the global order, ``kinds`` of them. A
    node holds the n-grams that all sets below share after those of its parent. Nodes are kept
    level by level in arrays.
    """

    def __init__(self, sets, kinds: int):
        import numpy as np

        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">i8").tobytes())
        start, end, label, parent, ends_here = [0], [0], [order[0]], [-1], [-1]
        path = [0]
        before = None
        for k in order:
            x = sets[k]
            common = 0
            if before is not None:
                m = min(len(x), len(before))
                differ = np.flatnonzero(x[:m] != before[:m])
                common = int(differ[0]) if len(differ) else m
            while start[path[-1]] >= common and end[path[-1]] > common and len(path) > 1:
                path.pop()
            top = path[-1]
            if end[top] > common:  # the node keeps what is common; a new one above it takes the place
                start.append(start[top])
                end.append(common)
                label.append(label[top])
                parent.append(parent[top])
                ends_here.append(-1)
                start[top], parent[top] = common, len(start) - 1
                path[-1] = len(start) - 1
            if common < len(x):
                start.append(common)
                end.append(len(x))
                label.append(k)
                parent.append(path[-1])
                ends_here.append(k)
                path.append(len(start) - 1)
            else:
                ends_here[path[-1]] = k
            before = x
        kids: list[list[int]] = [[] for _ in start]
        for node, up in enumerate(parent):
            if up >= 0:
                kids[up].append(node)
        level = [0]
        for node in level:
            level += kids[node]
        at = np.empty(len(level), np.int64)
        at[level] = np.arange(len(level))
        self.end = np.array(end)[level]
        self.size = self.end - np.array(start)[level]
        self.parent = np.array([at[parent[n]] if parent[n] >= 0 else -1 for n in level])
        self.leaf = np.array(ends_here)[level]
        self.kid_count = np.array([len(kids[n]) for n in level])
        self.kid_first = np.array([at[kids[n][0]] if kids[n] else 0 for n in level])
        self.flat = np.concatenate([sets[label[n]][start[n] : end[n]] for n in level])
        self.first = np.cumsum(self.size) - self.size
        self.last = np.where(self.size > 0, self.flat[np.minimum(self.first + self.size, len(self.flat)) - 1], -1)
        self.least, self.most, self.live = np.full(len(level), 1 << 60), np.zeros(len(level), np.int64), np.zeros(len(level), np.int64)
        own = self.leaf >= 0
        self.least[own] = self.most[own] = self.end[own]
        self.live[own] = 1
        for n in range(len(level) - 1, 0, -1):
            up = self.parent[n]
            self.least[up], self.most[up] = min(self.least[up], self.least[n]), max(self.most[up], self.most[n])
            self.live[up] += self.live[n]
        self.home = np.empty(len(sets), np.int64)
        self.home[self.leaf[own]] = np.flatnonzero(own)
        self.sets, self.kinds = sets, kinds
        # Nodes also hold their n-grams as bits where that takes little room, but for those that
        # one set alone has.
        several = np.bincount(np.concatenate(sets), minlength=kinds) > 1
        self.bit = np.where(several, np.cumsum(several) - 1, -1)
        words = -(-int(several.sum()) // 64)
        self.bits = None
        if len(level) * words * 8 <= BIT_BYTES:
            owner, bit = np.repeat(np.arange(len(level)), self.size), self.bit[self.flat]
            owner, bit = owner[bit >= 0], bit[bit >= 0]
            self.bits = np.zeros((len(level), words), np.uint64)
            np.add.at(self.bits, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))

    def remove(self, k: int) -> None:
        at = self.home[k]
        self.leaf[at] = -1
        while at >= 0:
            self.live[at] -= 1
            at = self.parent[at]

    def partners(self, k: int, share: int, of: int) -> list[int]:
        """Sets still in the tree whose Jaccard similarity with set k is at least share / of.

        The overlap of a path is found once for all sets below it; a subtree goes when even its
        remaining n-grams can't reach the share. Paths are followed a level at a time.
        """
        import numpy as np

        def ranges(first, size):
            """All of first[i], first[i] + 1, ... of size[i] each."""
            ends = np.cumsum(size)
            return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)

        x = self.sets[k]
        n, whole, out = len(x), share + of, []
        member = np.zeros(self.kinds + 1, np.int64)
        member[x + 1] = 1
        upto = np.cumsum(member)  # n-grams of x up to each
        if self.bits is not None:
            mine, bit = np.zeros(self.bits.shape[1], np.uint64), self.bit[x]
            bit = bit[bit >= 0]
            np.add.at(mine, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            if self.bits is not None:
                overlap = overlap + np.bitwise_count(self.bits[nodes] & mine).sum(1, dtype=np.int64)
            else:
                size = self.size[nodes]
                hits = np.concatenate([[0], np.cumsum(member[self.flat[ranges(self.first[nodes], size)] + 1])])
                ends = np.cumsum(size)
                overlap = overlap + hits[ends] - hits[ends - size]
            left = np.minimum(n - upto[self.last[nodes] + 1], self.most[nodes] - self.end[nodes])
            keep = (self.live[nodes] > 0) & (overlap + left >= -(-share * (n + self.least[nodes]) // whole))
            nodes, overlap = nodes[keep], overlap[keep]
            found = (self.leaf[nodes] >= 0) & (whole * overlap >= share * (n + self.end[nodes]))
            out += self.leaf[nodes[found]].tolist()
            count = self.kid_count[nodes]
            nodes, overlap = ranges(self.kid_first[nodes], count), np.repeat(overlap, count)
        return out


def linked_forest(raw: list[bytes], share: int = 75, of: int = 100) -> list[tuple[int, int]]:
    """Edges that connect exactly what the links of the sets connect (sets as sorted >u8 bytes)."""
    import numpy as np

    flat, inverse = np.unique(np.concatenate([np.frombuffer(r, ">u8") for r in raw]), return_inverse=True)
    size = np.array([len(r) // 8 for r in raw])
    cuts = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(raw)), size)
    # A set with a link has that share of its n-grams in other sets, too. Others go, until none does.
    stay = np.ones(len(raw), bool)
    while True:
        here = stay[owner]
        held = np.bincount(inverse[here], minlength=len(flat)) > 1
        now = stay & (of * np.bincount(owner[here], held[inverse[here]], len(raw)) >= share * size)
        if (now == stay).all():
            break
        stay = now
    left = np.flatnonzero(stay)
    if len(left) < 2:
        return []
    tree = PrefixTree([inverse[cuts[k] : cuts[k + 1]] for k in left], len(flat))
    edges, open_ = [], set(range(len(left)))
    while len(open_) > 1:
        queue = [open_.pop()]
        tree.remove(queue[0])
        while queue and open_:
            k = queue.pop()
            for other in tree.partners(k, share, of):
                edges.append((int(left[k]), int(left[other])))
                open_.discard(other)
                tree.remove(other)
                queue.append(other)
    return edges


def needed(n, share: int, of: int):
    """N-grams of a set of ``n`` that a linked set has too, at least."""
    return -(-n * share // of)


def spare(n):
    """How many common n-grams the prefixes of two linked sets are made to hold, by the smaller set's size."""
    import numpy as np

    return np.maximum(1, n // SPARE)


def prefix_length(n, share: int, of: int):
    """With prefixes of so many n-grams, linked sets have min(spare(n), spare(m)) of them in common.

    The i-th common n-gram has at least needed(n) - i others of the common ones after it, so it
    is among the first n - needed(n) + i of the set.
    """
    return n - needed(n, share, of) + spare(n)


def _lists(arrays):
    import numpy as np
    import pyarrow as pa

    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)], dtype=np.int32), pa.array(flat))


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: int = 75, of: int = 100, most: int | None = None) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (128-bit hash of the set), grams: the prefix in the global order, or its first ``most``."""
    import pyarrow as pa

    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from .shingles import shingle_sets

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, s, grams = [], [], []
                for x in shingle_sets(*text_bytes(part.column(1)), words):
                    n.append(len(x))
                    s.append(np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64))
                    first = x[: int(prefix_length(len(x), share, of))] if len(x) else x
                    grams.append(first[:most].view(np.int64))
                s = np.array(s, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(s[:, 0]), pa.array(s[:, 1]), _lists(grams)], names=["doc_id", "n_shingles", "s1", "s2", "grams"])

    return rows.mapInArrow(trimmed(run), f"doc_id {kind}, n_shingles long, s1 long, s2 long, grams array<long>")


def _groups(live: DataFrame) -> DataFrame:
    """(t, blocks) of the groups in ``live`` (rep, n_shingles, t); n-grams with the same members make one group."""
    each = live.groupBy("t").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("rep")).alias("p1"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("p2"), F.sum(F.col("n_shingles") * 8).alias("bytes"))
    one = each.where("m > 1").groupBy("m", "p1", "p2").agg(F.min("t").alias("t"), F.min("bytes").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.ceil(F.col("m") / BLOCK_SETS))
    return one.select("t", F.least("m", blocks).cast("int").alias("blocks"))


def _clustered(near: DataFrame) -> DataFrame:
    """``near`` (rep, n_shingles, component, t) without groups of one component and groups that repeat another, with
    the blocks of a group, the cluster of groups that share members, and whether that is small enough to be joined as one.
    """
    c = F.xxhash64("component")
    near = stored(near)
    # Small tables by n-gram are cut off, so that joins with them are plain ones, whose hot n-grams are split at run time.
    several = cut(near.groupBy("t").agg(F.min(c).alias("low"), F.max(c).alias("high")).where("low < high").select("t"))
    near = near.join(several, "t", "left_semi")
    near = stored(near.join(cut(_groups(near)), "t"))
    heads = cut(near.groupBy("t").agg(F.min("rep").alias("head")))
    edges = near.join(heads, "t").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    bound = connected_components(edges).select(F.col("node").alias("rep"), F.xxhash64("component").alias("cluster"))
    sizes = near.select("rep", "n_shingles").distinct().join(bound, "rep").groupBy("cluster").agg(F.count("*").alias("sets"), F.sum(F.col("n_shingles") * 8).alias("bytes"))
    small = (F.col("sets") <= CLUSTER_SETS) & (F.col("bytes") <= BLOCK_BYTES)
    return stored(near.join(bound, "rep").join(sizes.select("cluster", small.alias("small")), "cluster"))


def _texts(docs: DataFrame, wanted: DataFrame, few: bool, id_col: str, text_col: str) -> DataFrame:
    """(rep, text, ...): the texts of ``wanted`` (rep, ...). They travel compressed, or where few are wanted not at all."""
    own = pick(docs, rep=id_col, text=text_col)
    return own.join(F.broadcast(wanted), "rep") if few else packed(own, "rep", "text").join(wanted, "rep")


def _by_whole_sets(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, words: int, share: int, of: int) -> DataFrame:
    """(rep, n_shingles, component, t) of the n-grams by which ``sets`` (rep, n_shingles, component), a rep once, can be linked.

    As by prefixes, but of whole sets in the order of their n-grams' true frequency among them: a
    linked set has needed(n) n-grams in sets of other components, again and again as sets that
    haven't go, and leaves out the most common ones, one fewer than that. Between the rounds a set
    is one row, so that only n-grams are joined row by row, and sets as often as there are sets.
    """
    import pyarrow as pa

    kind = sets.schema["rep"].dataType.simpleString()
    few = sets.limit(MOST_WANTED + 1).count() <= MOST_WANTED
    need = F.ceil(F.col("n_shingles") * share / of)
    texts = _texts(docs, sets.select("rep", F.xxhash64("component").alias("c"), need.alias("need")), few, id_col, text_col)

    def ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from .shingles import shingle_sets

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                column = part.column(1) if few else unpacked(part.column(1))
                for i, x in enumerate(shingle_sets(*text_bytes(column), words)):
                    for cut in range(0, len(x), 1 << 16):
                        t = x[cut : cut + (1 << 16)].view(np.int64)
                        who = pa.array(np.full(len(t), i))
                        yield pa.RecordBatch.from_arrays([*(part.column(c).take(who) for c in (0, 2, 3)), pa.array(t)], names=["rep", "c", "need", "t"])

    tok = stored(texts.mapInArrow(trimmed(ngrams), f"rep {kind}, c long, need long, t long").distinct())
    for _ in range(2):
        several = tok.groupBy("t").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("t")
        left = tok.join(several, "t").groupBy("rep", "c", "need").agg(F.collect_list("t").alias("ts"))
        left = stored(left.where(F.size("ts") >= F.col("need")))
        tok = left.select("rep", "c", "need", F.explode("ts").alias("t"))
    near = tok.join(tok.groupBy("t").agg(F.count("*").alias("m")), "t").groupBy("rep", "need").agg(F.sort_array(F.collect_list(F.struct("m", "t"))).alias("ts"))
    near = near.select("rep", F.slice("ts", F.lit(1), (F.size("ts") - F.col("need") + 1).cast("int")).alias("ts"))
    return near.join(sets, "rep").select("rep", "n_shingles", "component", F.explode("ts").alias("x")).select("rep", "n_shingles", "component", "x.t")


def _forests(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int, share: int, of: int, pairs: bool) -> DataFrame:
    """Edges (a, b) between the nodes of ``wanted`` (rep, node, t, blocks) that connect what links inside the groups connect.

    A group of several blocks is joined block by block with ``pairs``: every two blocks meet.
    Without, each set goes to two blocks drawn by hash, so that links are found in work that
    grows with the group, but not all.
    """
    import pyarrow as pa

    kind = wanted.schema["node"].dataType.simpleString()
    few = wanted.limit(MOST_WANTED + 1).count() <= MOST_WANTED
    wanted = wanted.groupBy("rep").agg(F.collect_list(F.struct("t", "blocks", "node")).alias("groups"))
    texts = _texts(docs, wanted, few, id_col, text_col)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import shingle_sets

        def shipped(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), None, pa.binary()), strict=True)], names=["t", "lo", "hi", "own", "node", "ngrams"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out: list[tuple] = []
                size = 0
                column = part.column(1) if few else unpacked(part.column(1))
                for rep, groups_, x in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), shingle_sets(*text_bytes(column), words), strict=True):
                    raw = x.astype(">u8").tobytes()
                    for g in groups_:
                        b = g["blocks"]
                        d = int.from_bytes(hashlib.blake2b(f"{g['t']}:{rep}".encode(), digest_size=8).digest())
                        home, second = d % b, (d + 1 + (d >> 32) % max(1, b - 1)) % b
                        for o in range(b) if pairs else {home, second}:
                            lo, hi = (min(home, o), max(home, o)) if pairs else (o, o)
                            out.append((g["t"], lo, hi, home, g["node"], raw))
                            size += len(raw)
                            if size > 1 << 21:
                                yield shipped(out)
                                out, size = [], 0
                if out:
                    yield shipped(out)

    sets = texts.mapInArrow(trimmed(fetch), f"t long, lo int, hi int, own int, node {kind}, ngrams binary")
    sets = sets.repartition("t", "lo", "hi").sortWithinPartitions("t", "lo", "hi")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: dict[bytes, int]) -> pa.RecordBatch | None:
            raw = list(rows)
            if len(set(rows.values())) < 2:
                return None
            edges = [(rows[raw[i]], rows[raw[j]]) for i, j in linked_forest(raw, share, of)]
            edges = [e for e in dict.fromkeys(edges) if e[0] != e[1]]
            if edges:
                a, b = zip(*edges, strict=True)
                return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            return None

        held: dict[bytes, int] = {}
        last = None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for t, lo, hi, node, raw in zip(*(part.column(c).to_pylist() for c in (0, 1, 2, 4, 5)), strict=True):
                    if (t, lo, hi) != last:
                        if (out := settle(held)) is not None:
                            yield out
                        held, last = {}, (t, lo, hi)
                    held[raw] = node
        if (out := settle(held)) is not None:
            yield out

    return stored(sets.mapInArrow(trimmed(join), f"a {kind}, b {kind}").distinct())


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: int = 75, of: int = 100, signature: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two texts link when ``of`` * intersection >= ``share`` * union of their sets of distinct
    shingles of ``words`` words; component_id is the least id reachable by links. A text with
    fewer words is one shingle; null texts and texts without words are empty and link with
    nothing. Repeated rows and copies are one class throughout, and rows that share an id are
    linked. A row without an id has the component of the rows with its set of shingles, and a
    null one where none of them has an id; it links with nothing else. Ids may be of any type that
    sorts. A text of any length is one set, held by one task. An empty table gives an empty
    result; other columns, whatever their names, are ignored.

    Method: the global order of n-grams is that of their 64-bit hashes, and texts with equal
    sets are collapsed to the least id. A group is the sets that have one n-gram in common; the
    sets of a group are joined in a prefix tree, which returns a spanning forest of the links.
    Groups are formed twice.

    First by signatures, the first ``signature`` n-grams of a set: sets that share a quarter of
    theirs go to the groups of FIRST_GROUPS of those n-grams, the most common ones left out. That
    joins nearly all near copies, but not surely, in work that grows with the input.

    Then exactly, for links between the components found so far. Prefix filtering: linked sets
    have spare(n) n-grams of their prefixes (prefix_length) in common. N-grams that only one
    component has can't be such, which leaves little. Of the others, ordered from the rarest, a
    set needs spare(needed(n)), as the other set may be so much smaller, and leaves out the last
    ones, one fewer than that: a link still has an n-gram in common. Groups that share members
    are joined as one cluster, so that a set is sent once. Where a cluster is large, its sets are
    filtered anew with all their n-grams in place of prefixes; where what is left is still large,
    its groups are joined each, and large groups in pairs of blocks, so no link is lost.
    """
    prof = stored(profiles(docs, id_col, text_col, words, share, of, signature))
    classes = stored(prof.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles")))
    reps = prof.where("n_shingles > 0").join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).where("doc_id = rep")
    tok = stored(reps.select("rep", "n_shingles", F.size("grams").alias("signed"), F.explode("grams").alias("t")).distinct())
    shared = tok.groupBy("t").agg(F.count("*").alias("m")).where("m > 1")
    least = F.greatest(F.lit(1), F.floor(F.col("signed") / 4).cast("int"))
    near = tok.join(shared, "t").groupBy("rep", "n_shingles", "signed").agg(F.sort_array(F.collect_list(F.struct("m", "t"))).alias("ts")).withColumn("least", least)
    near = near.where(F.size("ts") >= F.col("least"))
    rare = F.transform(F.slice("ts", F.lit(1), F.size("ts") - F.col("least") + 1), lambda x: x["t"])
    near = stored(near.select("rep", "n_shingles", F.explode(F.slice(F.array_sort(rare), 1, FIRST_GROUPS)).alias("t")))
    wanted = stored(near.join(_groups(near), "t").select("rep", F.col("rep").alias("node"), "t", "blocks").distinct())
    found = _forests(docs, wanted, id_col, text_col, words, share, of, pairs=False)
    discard(tok, near, wanted)
    comps = connected_components(found).select(F.col("node").alias("rep"), "component")
    # A representative of two sets counts by the smaller, as what a link has in common is the least of the two.
    own = classes.where("rep is not null").groupBy("rep").agg(F.min("n_shingles").alias("n_shingles"))
    own = stored(own.join(comps, "rep", "left").select("rep", "n_shingles", F.coalesce("component", "rep").alias("component")))
    discard(found)
    release(docs.sparkSession)

    # What links are left run between components.
    whole = profiles(docs, id_col, text_col, words, share, of).where("n_shingles > 0").select(F.col("doc_id").alias("rep"), "s1", "s2", "grams")
    marked = stored(classes.join(own.select("rep", "component"), "rep").select("s1", "s2", "rep", F.xxhash64("component").alias("c")))
    tok = whole.join(marked, ["s1", "s2", "rep"]).select("rep", "c", F.explode("grams").alias("t"))
    several = tok.groupBy("t").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("t")
    need = F.ceil(F.col("n_shingles") * share / of)
    least = F.greatest(F.lit(1), F.floor(need / SPARE).cast("int"))
    tok = stored(tok.select("rep", "t").join(several, "t"))
    release(docs.sparkSession)
    near = tok.join(tok.groupBy("t").agg(F.count("*").alias("m")), "t").groupBy("rep").agg(F.sort_array(F.collect_set(F.struct("m", "t"))).alias("ts"))
    near = near.join(own, "rep").withColumn("least", least).where(F.size("ts") >= F.col("least"))
    near = near.select("rep", "n_shingles", "component", F.explode(F.slice("ts", F.lit(1), F.size("ts") - F.col("least") + 1)).alias("x"))
    near = _clustered(near.select("rep", "n_shingles", "component", "x.t"))
    release(docs.sparkSession)
    once = near.where("small")
    large = near.where("not small").select("rep", "n_shingles", "component").distinct()
    if not large.isEmpty():
        near = _clustered(_by_whole_sets(docs, stored(large), id_col, text_col, words, share, of))
        once = once.unionByName(near.where("small"))
        large = near.where("not small").select("rep", F.col("component").alias("node"), "t", "blocks")
    once = once.select("rep", F.col("component").alias("node"), F.col("cluster").alias("t"), F.lit(1).alias("blocks")).distinct()
    wanted = stored(once.unionByName(large) if "blocks" in large.columns else once)
    found = _forests(docs, wanted, id_col, text_col, words, share, of, pairs=True)
    joined = connected_components(found).select(F.col("node").alias("component"), F.col("component").alias("last"))
    label = own.join(joined, "component", "left").select("rep", F.coalesce("last", "component").alias("component"))
    of_class = classes.join(label, "rep", "left").select("s1", "s2", "component")
    out = prof.select("doc_id", "n_shingles", "s1", "s2").join(of_class, ["s1", "s2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
