"""Token ids of whole texts by a public tokenizer, a batch at a time.

The tokenizer drops white space and never merges across it, so a text's ids are the ids of the words of its
pieces between spaces and line ends, in order. Each distinct piece of a slice is split once (``TextRules``) and each distinct word
encoded once; what a worker has met lately stays in a cache bounded by bytes. Ids are gathered with numpy.
Pieces of plain Latin letters, digits and signs (where normalising is lower-casing and nothing else) are split together by the
file's own pattern; every other piece goes through the library's normaliser and splitter.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Texts of about so many bytes are gathered at a time; a cache of a worker takes about so many bytes, of
#: entries whose text has at most so many signs.
SLICE_BYTES, CACHE_BYTES, CACHED = 4 << 20, 128 << 20, 64
#: Python's own bytes for an entry: the string, the value, the place in the table.
ENTRY = 200
#: Signs that the text rules only lower-case: printable ASCII, Latin letters without a dotted capital I.
PLAIN = r"^[!-~À-įı-ɏ]+$"


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_signs() -> list[str]:
    """The sign that stands for each byte in the file: printable Latin-1 for itself, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Halves:
    """A cache of about ``size`` bytes: when the young half is full it becomes the old one, and what
    was not asked for again is dropped. Long keys are not kept."""

    def __init__(self, size: int):
        self.half, self.young, self.old, self.used = size // 2, {}, {}, 0

    def get(self, key: str) -> bytes | None:
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> bytes:
        if len(key) <= CACHED:
            if self.used >= self.half:
                self.old, self.young, self.used = self.young, {}, 0
            self.young[key] = value
            self.used += ENTRY + len(key) + len(value)
        return value


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places of all ranges ``starts[i] .. starts[i] + lens[i]``, one after the other."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


class TextRules:
    """Normaliser, special tokens and splitter of a tokenizers file: from texts to distinct words and back."""

    def __init__(self, library, spec: dict):
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or len(t["content"].split()) != 1
               or t["content"] != t["content"].strip() for t in spec["added_tokens"]):
            raise ValueError("special tokens must stand for exactly their own signs")
        self.normal, self.splitter = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(f"{pattern}|\\n").findall
        self.byte = {c: b for b, c in enumerate(byte_signs())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def _odd(self, piece: str) -> list[str]:
        """Words of any piece; a special token is a word after a line end."""
        out = []
        for part in self.special_at.split(piece) if self.special_at else [piece]:
            if part in self.special:
                out.append("\n" + part)
            elif part:
                out += [bytes(map(self.byte.__getitem__, w)).decode() for w, _ in self.splitter(self.normal(part))]
        return out

    def words(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct words, place there of each word of all texts in order, ends of the texts in that order)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        named = coded.dictionary
        plain = pc.or_(pc.match_substring_regex(named, PLAIN), pc.equal(named, ""))
        for t in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(named, t)))
        plain = plain.to_numpy(zero_copy_only=False)
        # a line end stands after each piece, plain pieces first
        found = self.split("\n".join([*named.filter(pa.array(plain)).to_pylist(), ""]).lower())
        for piece in named.filter(pa.array(~plain)).to_pylist():
            found += self._odd(piece)
            found.append("\n")
        seq = pa.array(found, pa.string()).dictionary_encode()
        distinct, use = seq.dictionary.to_pylist(), seq.indices.to_numpy().astype(np.int64)
        ends = np.flatnonzero(use == distinct.index("\n")) if "\n" in distinct else np.empty(0, np.int64)
        order = np.empty(len(plain), np.int64)                  # place of a piece among those just split
        order[np.append(np.flatnonzero(plain), np.flatnonzero(~plain))] = np.arange(len(plain))
        starts = np.append(0, ends[:-1] + 1)[order] if len(ends) else ends
        lens = ends[order] - starts if len(ends) else ends
        at = coded.indices.to_numpy(zero_copy_only=False)
        word_ends = np.append(0, np.cumsum(lens[at]))
        return distinct, use[spread(starts[at], lens[at])], word_ends[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]


class Encoder:
    """``batch(texts)`` -> (flat uint32 ids, offsets by text). One per worker and file."""

    _made: dict[tuple[str, int], Encoder] = {}

    @classmethod
    def of(cls, path: str, cache_bytes: int = CACHE_BYTES) -> Encoder:
        if (path, cache_bytes) not in cls._made:
            cls._made[path, cache_bytes] = cls(path, cache_bytes)
        return cls._made[path, cache_bytes]

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        whole = Tokenizer.from_file(path)
        self.model = whole.model
        self.rules = TextRules(whole, json.loads(whole.to_str()))
        self.sign = byte_signs()
        self.seen = Halves(cache_bytes)                     # little-endian ids of words

    def word(self, w: str) -> bytes:
        if w[0] == "\n":
            ids = [self.rules.special[w[1:]]] if len(w) > 1 else []
        else:
            signs = w if w.isascii() and w.isprintable() else "".join(map(self.sign.__getitem__, w.encode()))
            ids = [t.id for t in self.model.tokenize(signs)]
        return self.seen.put(w, np.array(ids, "<u4").tobytes())

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, use, ends = self.rules.words(texts)
        made = [self.seen.get(w) or self.word(w) for w in words]
        lens = np.fromiter(map(len, made), np.int64, len(made)) // 4
        flat, n = np.frombuffer(b"".join(made), "<u4"), lens[use]
        return flat[spread((np.cumsum(lens) - lens)[use], n)], np.append(0, np.cumsum(n))[ends]


def slices(batch: pa.RecordBatch, text: str):
    """Parts of ``batch`` with about ``SLICE_BYTES`` of text each (one row at least)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        base = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, base + SLICE_BYTES, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def documents(batch: pa.RecordBatch, text: str, path: str, end_id: int, cache_bytes: int = CACHE_BYTES):
    """(part of the batch, flat ids with ``end_id`` after each text, offsets) for each slice."""
    enc = Encoder.of(path, cache_bytes)
    for part in slices(batch, text):
        ids, off = enc.batch(part.column(text))
        rows = np.arange(part.num_rows)
        full = np.insert(ids, off[1:], np.uint32(end_id))
        yield part, full.astype("<u4", copy=False), off + np.concatenate([rows, [part.num_rows]])
