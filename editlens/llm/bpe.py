"""BPE encoding and decoding in batched merge rounds.

The distinct words of a slice of texts lie side by side in one flat array of symbols. A round looks
up the pairs of neighbours of all words by binary search over the sorted keys of the vocabulary's merges,
takes the lowest rank of each word, merges the places that have it, and sets words without a pair aside; the rounds
end when no word is left. A word's rounds don't depend on the words beside it, so every batch gives the same ids.

All places of the lowest rank are merged in one round, from the left, if the vocabulary's order allows it: no
pair that holds a merged symbol may rank before the merge that makes the symbol. A vocabulary
that breaks this is merged at the leftmost place only.

The text rules of the file (normal forms, split pattern, special tokens) come first and give each distinct word of a slice
once (``tokens.TextRules``). Truncation and padding are not applied.
A file's tokens are decoded as its library does where it names no decoder: joined by spaces.

Defined cases: null and empty texts have no ids and decode to the empty text; null ids decode to the empty text, ids out
of range and null entries are left out; repeated rows and ties are rows like any other; result columns replace columns of
the same name, other columns pass through; an empty table gives no rows. Texts are encoded whole, however long.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import TextRules, byte_signs, public_path, slices, spread

#: Ids that are decoded at a time.
DECODE_IDS = 1 << 20
NONE = np.iinfo(np.int64).max


class Merges:
    """The merges of a vocabulary as arrays sorted by pair key."""

    def __init__(self, pairs: list[tuple[int, int, int]], size: int):
        """``pairs``: (left, right, made) ids in rank order; a pair named twice has its last rank."""
        rank = {(a, b): (i, m) for i, (a, b, m) in enumerate(pairs)}
        self.size = size
        keys = np.array([a * size + b for a, b in rank], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank, self.made = (np.array([v[i] for v in rank.values()], np.int64)[order] for i in (0, 1))
        latest = np.full(size, -1, np.int64)                # last merge that makes a symbol
        np.maximum.at(latest, self.made, self.rank)
        self.in_order = bool((self.rank > np.maximum(latest[self.keys // size], latest[self.keys % size])).all())

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, place in the arrays) of each pair; rank ``NONE`` if there is no such merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE), at

    def run(self, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words that lie one after the other in ``symbols`` -> (flat ids, ids of each word)."""
        word = np.repeat(np.arange(len(lens)), lens)
        done_word, done_id = [], []
        # rank of each symbol's pair with the next one of its word, and where its merge stands
        rank, at = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
        look = np.flatnonzero(word[1:] == word[:-1])
        while len(symbols) and len(self.keys):
            rank[look], at[look] = self.find(symbols[look], symbols[look + 1])
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbols))))
            over = low == NONE
            if over.any():
                done_word.append(word[over])
                done_id.append(symbols[over])
            hit = (rank == low) & ~over
            if self.in_order:
                hit = _apart(hit)
            else:
                hits = np.flatnonzero(hit)
                hit[hits[1:][word[hits[1:]] == word[hits[:-1]]]] = False
            made = np.flatnonzero(hit)
            symbols[made] = self.made[at[made]]
            stay = ~over
            stay[made + 1] = False
            symbols, word, rank, at, hit = (x[stay] for x in (symbols, word, rank, at, hit))
            # only the pairs around a merged symbol are new
            rank[hit] = NONE
            look = np.flatnonzero((hit[:-1] | hit[1:]) & (word[1:] == word[:-1]))
        words, ids = np.concatenate([*done_word, word]), np.concatenate([*done_id, symbols])
        return ids[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(lens))


def _apart(hit: np.ndarray) -> np.ndarray:
    """Of places next to each other (a symbol paired with itself, over and over) every other one, from the left."""
    at = np.flatnonzero(hit)
    if not len(at):
        return hit
    start = np.append(True, np.diff(at) > 1)
    run = np.flatnonzero(start)
    nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    out = np.zeros(len(hit), bool)
    out[at[nth % 2 == 0]] = True
    return out


class Coder:
    """Encoder and decoder of one vocabulary file, made once per worker."""

    _made: dict[str, Coder] = {}

    @classmethod
    def of(cls, path: str) -> Coder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        library = Tokenizer.from_file(path)
        spec = json.loads(library.to_str())
        model, vocab = spec["model"], spec["model"]["vocab"]
        if spec.get("decoder") or model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only byte-level BPE files without a decoder or a prefix are understood")
        self.rules = TextRules(library, spec)
        end, signs = model.get("end_of_word_suffix") or "", byte_signs()
        self.within = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + end] for s in signs], np.int64)
        size = max([*vocab.values(), *self.rules.special.values()], default=0) + 1
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], size)
        token = dict.fromkeys(range(size)) | {i: t for t, i in vocab.items()} | {i: t for t, i in self.rules.special.items()}
        self.token = pa.array([token[i] for i in range(size)], pa.string())
        self.known = pc.is_valid(self.token).to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat int32 ids, offsets by text)."""
        words, use, ends = self.rules.words(texts)
        # a special token is one symbol that no merge holds; the sign of a piece's end has none
        coded = [w.encode() if w[0] != "\n" else b" " * (len(w) > 1) for w in words]
        lens = np.fromiter(map(len, coded), np.int64, len(coded))
        flat, stop = np.frombuffer(b"".join(coded), np.uint8), np.cumsum(lens)
        symbols = self.within[flat]
        some = stop[lens > 0] - 1
        symbols[some] = self.last[flat[some]]
        for i, w in enumerate(words):
            if w[0] == "\n" and len(w) > 1:
                symbols[stop[i] - 1] = self.rules.special[w[1:]]
        ids, n = self.merges.run(symbols, lens)
        at, n_use = (np.cumsum(n) - n)[use], n[use]
        return ids[spread(at, n_use)].astype(np.int32), np.append(0, np.cumsum(n_use))[ends]

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of a list array of ids."""
        ids = ids.cast(pa.large_list(pa.int64()))
        flat = ids.flatten()
        good = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False)
        fine = (good >= 0) & (good < len(self.known))
        fine[fine] = self.known[good[fine]]
        n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(fine)])
        offsets = before[np.concatenate([[0], np.cumsum(n)])]
        tokens = self.token.take(pa.array(good[fine]))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), " ")


def _schema(df: DataFrame, drop: str, name: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    cols = [c for c in df.columns if c not in (drop, name)]
    return cols, T.StructType([df.schema[c] for c in cols] + [T.StructField(name, kind)])


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """All columns of ``df`` but the text, plus its ids (array<int>)."""
    path = path or public_path()
    cols, schema = _schema(df, text, ids, T.ArrayType(T.IntegerType()))

    def run(batches):
        coder = Coder.of(path)
        for batch in batches:
            for part in slices(batch, text):
                flat, off = coder.encode(part.column(text))
                made = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in cols] + [made], names=[*cols, ids])
    return df.select(*cols, text).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """All columns of ``df``, plus the decoded text of its ids."""
    path = path or public_path()
    cols, schema = _schema(df, text, text, T.StringType())

    def run(batches):
        coder = Coder.of(path)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                base = size[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(size, base + DECODE_IDS, side="right")))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in cols] + [coder.decode(part.column(ids))],
                                                 names=[*cols, text])
                lo = hi
    return df.select(*cols).mapInArrow(run, schema)
