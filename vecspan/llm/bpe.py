"""BPE encoding and decoding with a public vocabulary file."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import pick, trimmed

#: Words kept per worker in each of two generations: when the newer is full it becomes the older,
#: so that words in use stay. It bounds memory, not results.
MEMO_WORDS = 100_000
#: Symbols of a word from which on they are held in arrays: about 80 bytes a symbol with the queue.
LONG_WORD = 4096


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class WordBpe:
    """The lower-casing, word-end BPE of a tokenizer file.

    Texts are put in NFC, lower-cased one character at a time and cut into words; white space is
    dropped. Special tokens inside a text are found before all that and give their own ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        import regex

        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        #: (left id, right id) -> (rank, id of the merged symbol)
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        chars = byte_chars()
        self.inner = [self.vocab.get(c) for c in chars]
        self.final = [self.vocab.get(c + self.suffix) for c in chars]
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")")
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one word: a queue of merge ranks over a doubly linked list of symbols."""
        raw = word.encode("utf-8")
        ids = [*(self.inner[b] for b in raw[:-1]), self.final[raw[-1]]]
        ids = [i for i in ids if i is not None]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        if n > LONG_WORD:
            ids, before, after = (array("i", x) for x in (ids, before, after))
        # A rank stands for one pair of symbols, so (rank, place) in one number says which pair was offered.
        merges, queue = self.merges, []
        for i in range(n - 1):
            if m := merges.get((ids[i], ids[i + 1])):
                queue.append(m[0] << 32 | i)
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            i = top & 0xFFFFFFFF
            j = after[i]
            m = merges.get((ids[i], ids[j])) if j >= 0 else None
            if m is None or m[0] != top >> 32:
                continue  # stale: it or a neighbour has merged since
            ids[i] = m[1]
            after[i] = k = after[j]
            after[j] = -2  # no longer in the list
            if k >= 0:
                before[k] = i
                if m := merges.get((ids[i], ids[k])):
                    heapq.heappush(queue, m[0] << 32 | i)
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], ids[i]))):
                heapq.heappush(queue, m[0] << 32 | h)
        return tuple(x for x, a in zip(ids, after, strict=True) if a != -2)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo = self.memo
        parts = self.cut.split(text) if self.special and "<|" in text else [text]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            # Sigma is lowered without regard to its place in the word.
            low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for w in self.words.findall(low):
                ids = memo.get(w)
                if ids is None:
                    ids = self.older.get(w)
                    if ids is None:
                        ids = self.word(w)
                    if len(w) <= 64:
                        if len(memo) >= MEMO_WORDS:
                            self.older, self.memo = memo, {}
                            memo = self.memo
                        memo[w] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings, joined by a blank as for a file that names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What a row can give, and its type.
_OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_texts(docs: DataFrame, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the chosen outputs of every row: n_tokens, ids, decoded, ids_sha256 (of the
    ids as little-endian unsigned 32-bit integers), decoded_sha256.

    Whole texts and whole words of any length; null and empty texts give no tokens and decode to
    the empty text. Repeated rows, with or without an id, give a row each; an empty table gives an
    empty result; other columns, whatever their names, are ignored.
    """
    import pyarrow as pa

    path = path or default_path()
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    decodes = any(o.startswith("decoded") for o in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = loaded(path)
        bpe.older = {}
        types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found: dict[str, list] = {o: [] for o in outputs}
                for x in part.column(1):
                    ids = bpe.encode(x.as_py() or "")
                    text = bpe.decode(ids) if decodes else ""
                    for o in outputs:
                        if o == "n_tokens":
                            v = len(ids)
                        elif o == "ids":
                            v = ids
                        elif o == "decoded":
                            v = text
                        else:
                            raw = np.asarray(ids, dtype="<u4").tobytes() if o == "ids_sha256" else text.encode("utf-8")
                            v = hashlib.sha256(raw).hexdigest()
                        found[o].append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, types.get(o, pa.string())) for o, v in found.items())], names=["doc_id", *outputs])

    return rows.mapInArrow(trimmed(run), ", ".join([f"doc_id {kind}", *(f"{o} {_OUTPUTS[o]}" for o in outputs)]))
