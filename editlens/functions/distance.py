"""Sequence distances on token lists (C11 word edit distance, LCS for ROUGE-L).

LCS has no JVM built-in; it runs as an Arrow pandas UDF whose per-row work is an
O(n*m) numpy DP (one vector step per token, running maximum along the row).

Word-level Levenshtein uses no UDF: each row's distinct tokens form a small
vocabulary, every token becomes one code point (from U+4E00 upward, past the
surrogates), and the built-in ``levenshtein`` runs on the two encoded strings: up to
1,092,096 distinct tokens per pair, more fail with an error. Functions return Spark SQL
expression text over column names (see ``ngrams``); ``*_col`` wrap it as Columns.
"""

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE_CODE_POINT = 19968          # U+4E00
SURROGATES = (0xD800, 0x800)      # first, and how many: code points that stand for no character


def _encode(tokens: str, vocab: str) -> str:
    first, n = SURROGATES
    places = f"transform({tokens}, t -> {BASE_CODE_POINT} + array_position({vocab}, t))"
    return (f"concat_ws('', transform({places}, at -> decode(unhex(lpad(hex(at + if(at >= {first}, {n}, 0)), 8, '0')), "
            f"'UTF-32')))")


def word_edit_distance(a: str, b: str, vocab: str | None = None) -> str:
    """C11 ``word_level_edit_distance``: insert/delete/substitute cost 1 per token.

    ``vocab`` may name a staged ``array_distinct(concat(a, b))`` column."""
    a = f"coalesce({a}, cast(array() as array<string>))"
    b = f"coalesce({b}, cast(array() as array<string>))"
    vocab = vocab or f"array_distinct(concat({a}, {b}))"
    return f"levenshtein({_encode(a, vocab)}, {_encode(b, vocab)})"


def lcs_length(a: str, b: str) -> str:
    """Longest common subsequence length of two token arrays (row-wise DP: the DP
    row over ``b`` is carried by ``aggregate`` over ``a``)."""
    inner = (f"aggregate(sequence(1, greatest(size({b}), 1)), array(0), (row, j) -> if(j > size({b}), row, "
             f"concat(row, array(if(element_at({b}, j) = tok, element_at(prev, j) + 1, "
             f"greatest(element_at(prev, j + 1), element_at(row, j)))))))")
    return f"element_at(aggregate({a}, array_repeat(0, size({b}) + 1), (prev, tok) -> {inner}), -1)"


def _lcs_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    """Bit-parallel LCS: one integer holds a bit for each token of ``b``, one step for each token of ``a``."""
    out = []
    for x, y in zip(a, b):
        if x is None or y is None or not len(x) or not len(y):
            out.append(0)
            continue
        places: dict = {}
        for i, t in enumerate(y):
            places[t] = places.get(t, 0) | 1 << i
        full = (1 << len(y)) - 1
        open_ = full
        for t in x:
            hit = open_ & places.get(t, 0)
            open_ = ((open_ + hit) | (open_ - hit)) & full
        out.append(len(y) - open_.bit_count())
    return pd.Series(out, dtype="int64")


_UDF: dict = {}


def lcs_length_udf(a, b) -> Column:
    """LCS length of two token arrays (Arrow pandas UDF, O(n*m) per row)."""
    if "lcs" not in _UDF:
        _UDF["lcs"] = F.pandas_udf(_lcs_batch, "long")
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return _UDF["lcs"](a, b)


def _lcs_texts_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    split = lambda s: [None if t is None else t.split(" ") for t in s]      # noqa: E731
    return _lcs_batch(split(a), split(b))


def lcs_texts_udf(a, b) -> Column:
    """``lcs_length_udf`` of two texts split on single spaces: what enters the UDF is short."""
    if "texts" not in _UDF:
        _UDF["texts"] = F.pandas_udf(_lcs_texts_batch, "long")
    return _UDF["texts"](a, b)


def rouge_from_lcs(lcs: str, n_cand: str, n_ref: str, beta: float = 1.2) -> str:
    """ROUGE-L F-score from columns of the LCS length and the two sizes."""
    lcs = f"cast({lcs} as double)"
    p, r = f"({lcs} / {n_cand})", f"({lcs} / {n_ref})"
    b2 = beta * beta
    return f"if({p} != 0 and {r} != 0, ((1 + {b2}D) * {p} * {r}) / ({r} + {b2}D * {p}), 0.0D)"


def rouge_l(cand: str, ref: str, beta: float = 1.2) -> str:
    """ROUGE-L F-score of one candidate against one reference token array."""
    lcs = f"cast({lcs_length(ref, cand)} as double)"
    p, r = f"({lcs} / size({cand}))", f"({lcs} / size({ref}))"
    b2 = beta * beta
    return f"if({p} != 0 and {r} != 0, ((1 + {b2}D) * {p} * {r}) / ({r} + {b2}D * {p}), 0.0D)"


def word_edit_distance_col(a: str, b: str) -> Column:
    return F.expr(word_edit_distance(a, b))


def lcs_length_col(a: str, b: str) -> Column:
    return F.expr(lcs_length(a, b))
