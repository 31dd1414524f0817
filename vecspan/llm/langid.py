"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import pick, slices, stored, text_bytes, trimmed

#: Bytes scored at once; longer texts are scored in pieces that see the bytes before them.
_PIECE = 1 << 19


class _Tree:
    """One language's context tree up to order three, compiled to tables of code lengths.

    Bytes are classes: 0 for all that the language hasn't shown, and A-Z share those of a-z. A
    code length depends on four bytes only and is tabulated for each context the language has;
    ``index`` holds, for any three classes, the row of the longest known context.
    """

    def __init__(self, texts: list[bytes]):
        import numpy as np

        raw = np.frombuffer((b"\n\n\n" + b"\n\n\n".join(texts)).lower(), np.uint8)
        kinds = np.unique(raw)
        self.classes = np.zeros(256, np.uint8)
        # A text of all 256 bytes isn't UTF-8, so there is room for class 0.
        self.classes[kinds] = np.arange(1, len(kinds) + 1).astype(np.uint8)
        self.classes[65:91] = self.classes[97:123]
        a = self.size = len(kinds) + 1
        c = self.classes[raw].astype(np.int64)
        rows: list[dict[int, int]] = []
        costs: list = []
        for order in range(4):
            ctx = np.zeros(max(0, len(c) - order), np.int64)
            for k in range(order):
                ctx = ctx * a + c[k : len(c) - order + k]
            keys, counts = np.unique(ctx * a + c[order:], return_counts=True)
            own: dict[int, int] = {}
            heads = np.flatnonzero(np.diff(keys // a, prepend=-1))
            for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(keys)], strict=True):
                at, n = int(keys[i] // a), counts[i:j]
                total = n.sum() + (j - i)
                row = (costs[rows[-1][at % a ** (order - 1)]] if order else np.full(a, 8.0)) - np.log2((j - i) / total)
                row[keys[i:j] % a] = -np.log2(n / total)
                own[at] = len(costs)
                costs.append(row)
            rows.append(own)
        self.costs = np.array(costs, np.float32)
        self.index = np.zeros(a**3, np.uint16 if len(costs) < 1 << 16 else np.int32)
        for order in range(4):
            for ctx, row in rows[order].items():
                self.index[ctx :: a**order] = row

    def code(self, data, s, s1, s2):
        """Bits of each byte; ``s``, ``s1``, ``s2``: places of texts' first, second and third bytes."""
        import numpy as np

        a, line = self.size, self.classes[10]
        c = self.classes[data]
        pad = np.concatenate([np.full(3, line, np.uint8), c])
        p3, p2, p1 = pad[:-3].copy(), pad[1:-2].copy(), pad[2:-1].copy()
        p1[s] = p2[s] = p3[s] = line
        p2[s1] = p3[s1] = line
        p3[s2] = line
        return self.costs[self.index[(p3.astype(np.int32) * a + p2) * a + p1], c]


class ByteTrees:
    """A context tree of each language up to order three, compiled to tables of code lengths.

    The statistics are frozen after training. A byte's exact code length under a language walks
    from the longest context seen to shorter ones: where the byte was seen, -log2(c / (t + q)),
    else the escape -log2(q / (t + q)) and on to the next shorter context (t bytes of q kinds;
    the escape estimate of PPM method C), and at last 8 bits. A language's tables take about 3 MB.
    """

    def __init__(self, texts_by_lang: dict[str, list[bytes]]):
        self.langs = sorted(texts_by_lang)
        self.trees = [_Tree(texts_by_lang[k]) for k in self.langs]

    def bits(self, data, offsets):
        """Code length of each text under each language, in bits: (texts, languages)."""
        import numpy as np

        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for i, j in slices(offsets, _PIECE):
            lo, hi = int(offsets[i]), int(offsets[j])
            if lo == hi:
                continue
            full = i + np.flatnonzero(np.diff(offsets[i : j + 1]) > 0)
            for at in range(lo, hi, _PIECE):  # more than one only where a long text stands alone
                begin, end = max(lo, at - 3), min(hi, at + _PIECE)
                part = data[begin:end]
                s = (offsets[full] - begin).astype(np.int64)
                s = s[s >= 0]
                s1, s2 = s[s + 1 < len(part)] + 1, s[s + 2 < len(part)] + 2
                # A start within two bytes of the one before is set by its own lines.
                for x, tree in enumerate(self.trees):
                    bits = tree.code(part, s, s1, s2)
                    if at == lo:
                        out[full, x] = np.add.reduceat(bits, s, dtype=np.float64)
                    else:
                        out[i, x] += bits[at - begin :].sum(dtype=np.float64)
        return out


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train: Column | None = None, per_lang: int = 400, most_bytes: int = 1 << 16, most_rows: int = 40_000) -> ByteTrees:
    """Context trees from a bounded sample of labelled rows.

    The bound is documented: of the rows that ``train`` admits and that have a language and a
    text of at most ``most_bytes`` bytes, the ``per_lang`` of each language that come first by a
    hash of id and text, or where there are so many languages an equal share of ``most_rows``. More
    languages than that are an error. Rows are counted and drawn one by one, whether they have an
    id, share one or have none; rows that repeat both id and text count once. Nothing else about
    the model depends on the size of the input.
    """
    docs = docs if train is None else docs.where(train)
    docs = pick(docs, id=id_col, lang=lang_col, text=text_col).withColumn("lang", F.col("lang").cast("string"))
    ok = F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes)
    draw = F.pmod(F.xxhash64(F.col("id").isNull(), "id", "text"), F.lit(1 << 40)) / float(1 << 40)
    rows = docs.where(ok).select("lang", "text", draw.alias("draw"))
    sizes = stored(rows.select("lang", "draw").distinct().groupBy("lang").agg(F.count("*").alias("n")))
    langs = sizes.limit(most_rows + 1).count()
    if langs > most_rows:
        raise ValueError(f"{lang_col} has over {most_rows} values")
    per_lang = min(per_lang, most_rows // max(1, langs))
    # A share by hash of which per_lang rows or more are all but certain comes first, so that a
    # language's rows don't meet in one task; rows that share is short of don't matter.
    some = rows.join(F.broadcast(sizes), "lang").where(F.col("draw") * F.col("n") <= 1.5 * per_lang)
    once = some.groupBy("lang", "draw").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    by: dict[str, list[bytes]] = defaultdict(list)
    # At most per_lang rows of each language, of most_bytes each.
    for r in once.withColumn("r", rank).where(F.col("r") <= per_lang).select("lang", "text").toLocalIterator():
        by[r.lang].append(r.text.encode("utf-8"))
    return ByteTrees({k: sorted(v) for k, v in by.items()})


def identify(docs: DataFrame, model: ByteTrees, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """``keep`` columns (the id by default) with the prediction, its score and the bits a byte of every row.

    The language with the shortest code for the whole text wins (ties: the first by name);
    score is its posterior under equal priors. Null, empty and letterless texts, and every text
    where no language was learned, get ``und`` with score 0. Repeated rows, with or without an id,
    give a row each; texts of any length are read whole, in pieces; an empty table gives an empty
    result. ``keep`` may have any names but the three new ones.
    """
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    keep = keep or [id_col]
    if set(keep) & set(names):
        raise ValueError(f"{', '.join(sorted(set(keep) & set(names)))}: names of new columns")
    rows = pick(docs, **{f"k{i}": c for i, c in enumerate(keep)}, text=text_col)
    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]), StructField("lang", StringType()), StructField("score", DoubleType()), StructField("bits", DoubleType())])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            texts = batch.column(batch.num_columns - 1)
            data, offsets = text_bytes(texts)
            letters = np.array([bool(x) and any(map(str.isalpha, x)) for x in (t.as_py() for t in texts)], bool)
            lang, score, rate = np.full(len(letters), "und", dtype=object), np.zeros(len(letters)), np.zeros(len(letters))
            if m.langs:
                bits = m.bits(data, offsets)
                best = bits.argmin(1)
                low = bits[np.arange(len(best)), best]
                post = 1 / np.exp2(np.clip(low[:, None] - bits, -1000, 0)).sum(1)
                lang[letters] = np.array(m.langs, dtype=object)[best[letters]]
                score[letters] = post[letters]
                rate = low / np.maximum(1, np.diff(offsets))
            cols = [*(batch.column(k) for k in range(len(keep))), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(rate)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(trimmed(run), schema).toDF(*keep, *names)
