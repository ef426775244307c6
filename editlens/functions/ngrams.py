"""N-gram multiset functions and per-sentence metric statistics (C9, C10, A11 BLEU).

A sentence is small (a comment), so its n-gram multisets are handled per row:
no explode, no shuffle. Functions return Spark SQL expression text over
column names; callers stage them with ``selectExpr`` so that each n-gram bag and
its count map (``map<gram, count>``) is computed once per row and only referenced
afterwards. A gram is its tokens joined by one space (tokens never contain one).

The counts behind SARI, GLEU and BLEU come from Arrow UDFs over the sentences' texts (tokens joined by one
space): tokens become numbers of the row, an n-gram one number, and numpy counts them. So no gram ever is a
string, and a row enters and leaves the UDF as a few texts and numbers.
"""

import numpy as np
import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F


def ngrams(t: str, n: int) -> str:
    """All contiguous n-grams of token array ``t``, in order (a bag)."""
    return (f"if(size({t}) >= {n}, transform(sequence(1, size({t}) - {n} + 1), "
            f"i -> array_join(slice({t}, i, {n}), ' ')), cast(array() as array<string>))")


def count_map(bag: str) -> str:
    """``Counter(bag)`` as ``map<string, int>``."""
    return (f"map_from_entries(transform(array_distinct({bag}), "
            f"g -> struct(g, size(filter({bag}, x -> x = g)))))")


def _get(m: str, g: str = "g") -> str:
    return f"coalesce(try_element_at({m}, {g}), 0)"


def clipped_matches(mh: str, mr: str) -> str:
    """O7 ``sum((Counter(h) & Counter(r)).values())`` from two count maps."""
    return f"aggregate(map_keys({mh}), 0L, (a, g) -> a + least({mh}[g], {_get(mr)}))"


def gleu_matches(mh: str, mr: str, ms: str) -> str:
    """C9 GLEU numerator: max(sum(h & r) - sum(h & (s without keys of r)), 0)."""
    minus = f"aggregate(map_keys({mh}), 0L, (a, g) -> a + if(try_element_at({mr}, g) is null, " \
            f"least({mh}[g], {_get(ms)}), 0))"
    return f"greatest({clipped_matches(mh, mr)} - {minus}, 0L)"


def gleu_from_sums(c: str, r: str, ms: list[str], ds: list[str]) -> str:
    """A7 ``gleu``: 0 if any statistic is 0, else exp(min(0, 1-r/c) + mean log(m/d))."""
    zero = " or ".join(f"{x} = 0" for x in [c, r, *ms, *ds])
    logs = " + ".join(f"ln(cast({m} as double) / {d_})" for m, d_ in zip(ms, ds))
    return f"if({zero}, 0.0D, exp(least(0.0D, 1 - cast({r} as double) / {c}) + ({logs}) / {len(ms)}))"


def _f1(p: str, r: str) -> str:
    return f"if(({p}) > 0 or ({r}) > 0, 2 * ({p}) * ({r}) / (({p}) + ({r})), 0.0D)"


def _ratio(num: str, den: str) -> str:
    return f"if(({den}) > 0, ({num}) / ({den}), 0.0D)"


def sari_ngram(ms: str, mc: str, mr: str, nr: str) -> tuple[str, str, str]:
    """C10 ``SARIngram`` from count maps of source, candidate and all references
    (bag-sum, O8); source/candidate counts are multiplied by ``nr`` (number of
    references). Returns (keep F1, delete precision, add F1) expression texts."""
    S = lambda g="g": f"({ms}[{g}] * {nr})"                          # noqa: E731
    C = lambda g="g": f"({_get(mc, g)} * {nr})"                      # noqa: E731
    R = lambda g="g": _get(mr, g)                                    # noqa: E731
    has = lambda m: f"try_element_at({m}, g) is not null"            # noqa: E731
    sk = f"map_keys({ms})"
    keep_n = f"size(filter({sk}, g -> {has(mc)}))"
    good = f"filter({sk}, g -> {has(mc)} and {has(mr)})"
    all_n = f"size(filter({sk}, g -> {has(mr)}))"
    kt1 = f"aggregate({good}, 0.0D, (a, g) -> a + least({S()}, {C()}, {R()}) / least({S()}, {C()}))"
    kt2 = f"aggregate({good}, 0.0D, (a, g) -> a + least({S()}, {C()}, {R()}) / least({S()}, {R()}))"
    keep = _f1(_ratio(kt1, keep_n), _ratio(kt2, all_n))
    del_keys = f"filter({sk}, g -> {S()} > {C()})"
    dt1 = (f"aggregate(filter({del_keys}, g -> {S()} - {C()} > {R()}), 0.0D, "
           f"(a, g) -> a + ({S()} - {C()} - {R()}) / ({S()} - {C()}))")
    delete_p = _ratio(dt1, f"size({del_keys})")
    add_keys = f"filter(map_keys({mc}), g -> try_element_at({ms}, g) is null)"
    add_good = f"cast(size(filter({add_keys}, g -> {has(mr)})) as double)"
    add_all = f"size(filter(map_keys({mr}), g -> try_element_at({ms}, g) is null))"
    add = _f1(_ratio(add_good, f"size({add_keys})"), _ratio(add_good, add_all))
    return keep, delete_p, add


def bleu_from_sums(testlen: str, reflen: str, guesses: list[str], corrects: list[str]) -> str:
    """Corpus BLEU-N from summed statistics (smoothing constants 1e-15 / 1e-9,
    brevity penalty from the closest = only reference length)."""
    prod = " * ".join(f"(({c} + 1e-15D) / ({g} + 1e-9D))" for g, c in zip(guesses, corrects))
    ratio = f"(({testlen} + 1e-15D) / ({reflen} + 1e-9D))"
    return f"pow({prod}, {1.0 / len(guesses)}D) * if({ratio} < 1, exp(1 - 1 / {ratio}), 1.0D)"


def sari_sentences(df, src_text: str, cand_text: str, ref_texts: str, out: str = "sari"):
    """C10 ``SARIsent`` over a DataFrame: texts lower-cased and split on single
    spaces; score = mean of keep, delete and add, each averaged over n = 1..4.
    ``ref_texts`` is an array of reference strings (their n-grams are bag-summed)."""
    return df.withColumn(out, sari_udf(F.expr(f"lower({src_text})"), F.expr(f"lower({cand_text})"),
                                       F.expr(f"transform({ref_texts}, t -> lower(t))")))


# --- counts of numbered grams (Arrow UDFs) ------------------------------------------
def gram_tables(sides: list[list[list[str]]], n_max: int = 4):
    """For n = 1..``n_max`` the counts of every distinct n-gram (column) in each side (row); a side is a list of
    token lists whose bags are summed (O8)."""
    vocab: dict = {}
    rows = [(i, np.array([vocab.setdefault(t, len(vocab)) for t in x], np.int64)) for i, side in enumerate(sides) for x in side]
    grams = [x for _, x in rows]
    for n in range(1, n_max + 1):
        if n > 1:           # the number of a gram: that of its first n - 1 tokens, then its last token
            grams = [g[:-1] * max(len(vocab), 1) + x[n - 1:] for g, (_, x) in zip(grams, rows)]
        found, number = np.unique(np.concatenate([np.empty(0, np.int64), *grams]), return_inverse=True)
        at = np.cumsum([0, *map(len, grams)])
        grams = [number[a:b] for a, b in zip(at, at[1:])]
        out = np.zeros((len(sides), len(found)), np.int64)
        for (i, _), g in zip(rows, grams):
            out[i] += np.bincount(g, minlength=len(found))
        yield out


def _mean(num: float, den: int) -> float:
    return num / den if den > 0 else 0.0


def _harmonic(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p > 0 or r > 0 else 0.0


def sari_counts(c: np.ndarray, nr: int) -> tuple[float, float, float]:
    """C10 ``SARIngram`` (keep F1, delete precision, add F1) from counts in source, candidate and ``nr`` references."""
    s, k, r = c[0] * nr, c[1] * nr, c[2]
    both, kept = (s > 0) & (k > 0), (s > 0) & (r > 0)
    good = both & (r > 0)
    least = np.minimum(s, k)[good]
    hit = np.minimum(least, r[good])
    keep = _harmonic(_mean(float((hit / least).sum()), int(both.sum())),
                     _mean(float((hit / np.minimum(s, r)[good]).sum()), int(kept.sum())))
    gone = s > k
    lost = (s - k)[gone]
    over = lost - r[gone]
    dele = _mean(float((over[over > 0] / lost[over > 0]).sum()), len(lost))
    new = (k > 0) & (s == 0)
    right = int((new & (r > 0)).sum())
    return keep, dele, _harmonic(_mean(right, int(new.sum())), _mean(right, int(((r > 0) & (s == 0)).sum())))


def _tokens(text) -> list[list[str]]:
    """The token lists of a side: none for null."""
    return [] if text is None else [text.split(" ")]


def _sari_batch(src: pd.Series, cand: pd.Series, refs: pd.Series) -> pd.Series:
    out = []
    for s, c, r in zip(src, cand, refs):
        if r is None:
            out.append(0.0)
            continue
        parts = [sari_counts(t, len(r)) for t in gram_tables([_tokens(s), _tokens(c), [x for t in r for x in _tokens(t)]])]
        keep, dele, add = (sum(p[i] for p in parts) for i in range(3))
        out.append((keep / 4 + dele / 4 + add / 4) / 3)
    return pd.Series(out, dtype="float64")


def _gleu_batch(hyp: pd.Series, ref: pd.Series, src: pd.Series) -> pd.Series:
    return pd.Series([[max(int(np.minimum(c[0], c[1]).sum() - np.minimum(c[0], c[2])[c[1] == 0].sum()), 0)
                       for c in gram_tables([_tokens(h), _tokens(r), _tokens(s)])] for h, r, s in zip(hyp, ref, src)], dtype=object)


def _clipped_batch(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    filled = lambda x: [[t for t in y if t] for y in _tokens(x)]        # noqa: E731
    return pd.Series([[int(c.min(axis=0).sum()) for c in gram_tables([filled(h), filled(r)])] for h, r in zip(hyp, ref)], dtype=object)


_UDF: dict = {}


def _udf(name: str, fn, kind: str):
    if name not in _UDF:
        _UDF[name] = F.pandas_udf(fn, kind)
    return _UDF[name]


def sari_udf(src, cand, refs) -> Column:
    """C10 ``SARIsent`` of texts split on single spaces; ``refs``: an array of them. Null texts have no grams, null ``refs`` score 0."""
    return _udf("sari", _sari_batch, "double")(src, cand, refs)


def gleu_udf(hyp, ref, src) -> Column:
    """C9 GLEU numerators for n = 1..4 of texts split on single spaces."""
    return _udf("gleu", _gleu_batch, "array<long>")(hyp, ref, src)


def clipped_udf(hyp, ref) -> Column:
    """O7 clipped matches for n = 1..4 of texts split on single spaces, empty tokens left out."""
    return _udf("clipped", _clipped_batch, "array<long>")(hyp, ref)
