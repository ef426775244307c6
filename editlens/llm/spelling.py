"""Spelling variants: words one edit apart, found over a reduced alphabet, and the frequent form of each.

Letters are hashed to a few symbols (code point modulo the number of symbols), so words become short words over a small
alphabet whose full one-edit neighbourhoods can be written out: one symbol replaced, deleted or inserted, and
the reduced word itself (an edit may stay within a symbol). Near words always have neighbouring reduced words. The
neighbourhoods are joined with the reduced vocabulary, and candidates are verified on the original strings. Reduced words
travel as 64-bit polynomial codes. A candidate that only shares a code fails verification; the one loss that
codes allow, two different reduced words with one code, has a chance of about V^2 / 2^65 for a vocabulary of V words.

Each edge of the first neighbourhoods is written from one of its ends (a deletion from the longer word stands for the
insertion into the shorter one, a replacement goes to the larger symbol). Reduced words that more than
``max_bucket`` words share are left out there; their words meet all others again over more
symbols, with neighbourhoods written in full, and at last over the letters themselves, where no two words share
a reduced word. So no bucket is joined pair by pair and none is dropped.

Defined cases: null texts and ids read as empty (a null id is the empty text in the hash); repeated rows count as often as
they occur; ties of frequency go to the smaller word in code-point order; a text of any length is one row until its
words are counted, which Spark combines before the shuffle; extra columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words are runs of these letters; the second name is the alphabet of lower-cased words.
RUN = "A-Za-zÀ-ÿ"
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
UPPER, LOWER = ("".join(map(chr, range(ord(a), ord(a) + 26))) for a in "Aa")
#: Symbols of the alphabet, coarse to fine; None: the letters themselves.
ALPHABETS = (6, 24, None)
#: Odd multiplier of the polynomial codes.
BASE = 0x9E3779B97F4A7C15


def vocabulary(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 7, min_count: int = 2,
               misspell: int | None = None) -> DataFrame:
    """(word, n): lower-cased runs of letters with their count. ``misspell``: in one of so many runs of a document, by
    its hash, a letter is deleted, which plants variants."""
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"([{RUN}]{{{min_length},}})"), 1))
    runs = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if misspell:
        size = F.length("word")
        h = F.crc32(F.concat("id", F.lit(":"), "word"))
        at = (h % size).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, size))
        runs = runs.select(F.when(h % misspell == 0, shorter).otherwise(F.col("word")).alias("word")).where(F.length("word") >= min_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def by_length(words: list[str], symbols: int | None):
    """(places in ``words``, matrix of symbols) for each length."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    s = (points if symbols is None else points % symbols + 1).astype(np.uint64)
    starts = np.cumsum(lens) - lens
    for n in np.unique(lens).tolist():
        rows = np.flatnonzero(lens == n)
        yield rows, s[starts[rows][:, None] + np.arange(n)]


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, BASE, np.uint64)), dtype=np.uint64)


def codes(words: list[str], symbols: int | None) -> np.ndarray:
    """Code of each word's reduced form: its symbols as digits of a polynomial, modulo 2^64."""
    out = np.zeros(len(words), np.uint64)
    for rows, s in by_length(words, symbols):
        out[rows] = (s * powers(s.shape[1])[s.shape[1] - 1::-1]).sum(axis=1, dtype=np.uint64)
    return out.view(np.int64)


def neighbours(words: list[str], symbols: int | None, full: bool) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``words``, code) of each word one edit away from a reduced word; every code once a word.
    Without ``full`` replacements go to larger symbols only and nothing is inserted."""
    where, found = [], []
    letters = np.array(LETTERS if symbols is None else range(1, symbols + 1), np.uint64)

    def add(rows, code, keep):
        r, _ = np.nonzero(keep)
        where.append(rows[r])
        found.append(code[keep])

    for rows, s in by_length(words, symbols):
        m, n = s.shape
        p = powers(n)
        # symbols at their weight in a word as long, one shorter (the last place is not used) and one longer
        here, shorter, longer = (s * p[np.maximum(np.arange(n - 1 + d, d - 1, -1), 0)] for d in (0, -1, 1))
        total = here.sum(axis=1, dtype=np.uint64)[:, None]
        none = np.zeros((m, 1), np.uint64)
        after = total - np.concatenate([none, np.cumsum(here, axis=1, dtype=np.uint64)], axis=1)   # of places i and later
        before = np.concatenate([none, np.cumsum(shorter, axis=1, dtype=np.uint64)], axis=1)       # of places before i, one less long
        last_of_run = np.append(s[:, 1:] != s[:, :-1], np.ones((m, 1), bool), axis=1)
        add(rows, before[:, :n] + after[:, 1:], last_of_run)                                        # deleted
        grown = np.concatenate([none, np.cumsum(longer, axis=1, dtype=np.uint64)], axis=1)          # of places before i, one longer
        for t in letters:
            put = t * p[np.arange(n - 1, -1, -1)]
            add(rows, total - here + put, (s != t) if full else (s < t))                            # replaced
            if full:                                                                                # inserted before i, or at the end
                add(rows, grown + t * p[np.arange(n, -1, -1)] + after, np.append(s != t, np.ones((m, 1), bool), axis=1))
    if not where:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(where), np.concatenate(found).view(np.int64)


def _coded(vocab: DataFrame, symbols: int | None) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(codes(b.column("word").to_pylist(), symbols))],
                                             names=["word", "n", "code"])
    return vocab.select("word", "n").mapInArrow(run, "word string, n long, code long")


def _edges(reduced: DataFrame, symbols: int | None, full: bool) -> DataFrame:
    """``reduced`` (code, word, n_words) -> (code, near), the code itself included if words share it."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                b = batch.slice(lo, 2000)
                own = b.column("code").to_numpy()
                at, near = neighbours(b.column("word").to_pylist(), symbols, full)
                shared = own[b.column("n_words").to_numpy() > 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own[at], shared])), pa.array(np.concatenate([near, shared]))],
                                                 names=["code", "near"])
    return reduced.select("code", "word", "n_words").mapInArrow(run, "code long, near long")


def near_pairs(vocab: DataFrame, alphabets=ALPHABETS, max_bucket: int = 64) -> DataFrame:
    """``vocab`` (word, n), words distinct and not empty -> (a, a_n, b, b_n): every pair of words exactly one inserted,
    deleted or replaced code point apart, once."""
    found, source = None, None
    for symbols in alphabets:
        coded = written(_coded(vocab, symbols), "spelling-coded")
        sizes = coded.groupBy("code").agg(F.min("word").alias("word"), F.count(F.lit(1)).alias("n_words"))
        reduced = written(sizes, "spelling-reduced")
        hot = reduced.where(F.col("n_words") > max_bucket).select("code") if symbols is not None else reduced.where("false").select("code")
        more = not hot.isEmpty()
        cool = coded.join(hot, "code", "left_anti") if more else coded
        reduced = reduced.where(F.col("n_words") <= max_bucket) if more else reduced
        # the words whose neighbourhoods are written: all, or those that were crowded over fewer symbols
        mine = reduced if source is None else reduced.join(
            cool.join(source, "word", "left_semi").select("code").distinct(), "code", "left_semi")
        edges = _edges(mine, symbols, full=source is not None)
        pairs = edges.join(reduced.select(F.col("code").alias("near")), "near")
        a = cool.select("code", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = cool.select(F.col("code").alias("near"), F.col("word").alias("b"), F.col("n").alias("b_n"))
        met = pairs.join(a, "code").join(b, "near")
        if source is None:
            met = met.where((F.col("near") != F.col("code")) | (F.col("a") < F.col("b")))
        met = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")
        # pairs of crowded words are seen from both ends or over several alphabets: once each
        found = met if found is None else _ordered(found).union(_ordered(met)).distinct()
        if not more:
            return found
        source = written(coded.join(hot, "code", "left_semi").select("word"), "spelling-crowded")
    return found


def _ordered(pairs: DataFrame) -> DataFrame:
    swap = F.col("b") < F.col("a")
    return pairs.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
                          for x, y in (("a", "b"), ("a_n", "b_n"), ("b", "a"), ("b_n", "a_n"))])


def group_variants(vocab: DataFrame, times: int = 10, alphabets=ALPHABETS, max_bucket: int = 64) -> DataFrame:
    """``vocab`` (word, n) -> (word, form, root, n, n_near, form_n). A word's form is its most frequent near word, if
    that is ``times`` as frequent; its root is where the forms end."""
    vocab = written(vocab.select("word", "n"), "spelling-vocabulary")
    ends = F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("near")).alias("near")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("n"), F.col("a").alias("near")).alias("near"))))
    best = (near_pairs(vocab, alphabets, max_bucket).select(ends.alias("e")).select("e.*")
            .groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("best")))
    fits = -F.col("best.n") >= times * F.col("n")
    forms = written(vocab.join(best, "word", "left").select(
        "word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, -F.col("best.n")).alias("form_n")), "spelling-forms")
    # forms grow by ``times`` at each step, so the chains are short; each round doubles what a word has followed
    ends = forms.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        nxt = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = written(ends.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                             F.col("further").isNotNull().alias("went")), "spelling-roots")
        if ends.where("went").isEmpty():
            break
        ends = ends.select("word", "root")
    return (forms.join(ends.select("word", "root"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
