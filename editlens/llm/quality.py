"""Quality rules, line first [native].

Every line of a text is judged by itself; failing lines are removed; then the document is
rejected if too large a part of its word characters went with them, or if a base rule fails.

Line rules (a line without a word is no text: it is kept as layout and never counts as loss):

* punctuation  - the line, without closing quotes or brackets, ends neither in ``. ! ? : ;``
                 nor ``…``, and is longer than a heading (``max_heading_words``);
* shouting     - no lower-case letter, but at least ``min_shout_letters`` upper-case ones;
* symbols      - more than ``max_symbol_share`` of the line's word characters are ``#*$%&|<>``;
* navigation   - at least ``min_nav_items`` separators ``|``, ``»``, ``>`` or ``·`` standing alone
                 between words (menus, bread crumbs);
* boilerplate  - one of the fixed phrases of web page furniture (``BOILERPLATE``).

Null and empty texts have no words: they fail the base rule. Ties and repeated rows are judged
row by row and so always alike; extra columns pass through ``apply_rules`` untouched, and columns
of the same name as a result are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: Phrases that only page furniture holds.
BOILERPLATE = [
    "lorem ipsum", "javascript is disabled", "enable javascript", "cookie policy", "accept cookies",
    "accept all cookies", "privacy policy", "terms of use", "terms of service", "click here",
    "read more", "sign in to", "log in to", "subscribe to our newsletter", "share this",
    "skip to content", "back to top",
]

RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
           "n_failed_lines", "lost_chars", "base_failed", "kept", "clean_text")

END_PUNCT = r"""[.!?:;…]["'”’»)\]]*[\x20\x09-\x0D]*\z"""
NAV = "[|»>·]"
SYMBOLS = r"[#*$%&|<>]"


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _chars(line: Column) -> Column:
    """Code points of a line that belong to words."""
    return F.length(F.regexp_replace(line, r"[\x20\x09-\x0D]+", ""))


def line_fails(line: Column, max_heading_words: int, min_shout_letters: int, max_symbol_share: float,
               min_nav_items: int) -> Column:
    """Cheap tests come first: a rule that counts runs only where its sign occurs at all."""
    no_end = ~line.rlike(END_PUNCT) & (F.size(words(line)) > max_heading_words)
    shout = ~line.rlike(r"\p{Ll}") & line.rlike(r"(?:\p{Lu}[^\p{Lu}]*){%d}" % min_shout_letters)
    symbols = line.rlike(SYMBOLS) & (F.regexp_count(line, F.lit(SYMBOLS)) > max_symbol_share * _chars(line))
    nav = line.rlike(NAV) & (F.size(F.filter(words(line), lambda w: w.rlike(f"^{NAV}\\z"))) >= min_nav_items)
    boiler = let(F.lower(line), lambda s: reduce(or_, [s.contains(p) for p in BOILERPLATE]))
    return _has_word(line) & (no_end | shout | symbols | nav | boiler)


def repeat_words(ws: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the text.

    Windows are hashed; a text whose hashes all differ has none. Otherwise the hashes are sorted, equal
    windows are neighbours, and their starts in order each cover up to three new words."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - 2), lambda i: F.xxhash64(
        F.element_at(ws, i), F.element_at(ws, i + 1), F.element_at(ws, i + 2)))

    def window(i):
        return F.array_join(F.slice(ws, i, 3), " ")

    def twin(x, y):                             # equal hash, then equal words
        return F.coalesce((x["h"] == y["h"]) & (window(x["i"]) == window(y["i"])), F.lit(False))

    def starts(z):
        same = F.filter(z, lambda x, k: twin(x, F.get(z, k - 1)) | twin(x, F.get(z, k + 1)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(p):
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last")),
                           lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
                           lambda a: a["n"])

    def by_hash(h):
        pairs = F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(1), F.size(h)).alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(pairs, lambda z: let(starts(z), covered)))
    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(let(hashes, by_hash)).cast("long")


def apply_rules(df: DataFrame, text: str = "text", min_words: int = 50, max_repeat_pct: int = 50,
                max_lost_share: float = 0.5, max_heading_words: int = 12, min_shout_letters: int = 20,
                max_symbol_share: float = 0.1, min_nav_items: int = 4) -> DataFrame:
    """All columns of ``df`` plus ``RESULTS``; ``clean_text`` is the text without its failing lines."""
    fails = lambda s: line_fails(s, max_heading_words, min_shout_letters, max_symbol_share, min_nav_items)

    def of_words(x):
        return let(words(x), lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            repeat_words(ws).alias("n_repeat_words")))

    def of_lines(x):
        lines = F.transform(F.split(x, "\n"), lambda s: F.struct(s.alias("s"), fails(s).alias("bad")))

        def results(ls):
            bad = F.filter(ls, lambda r: r["bad"])
            full = F.filter(ls["s"], _has_word)
            return F.struct(
                let(full, lambda t: F.size(t) - F.size(F.array_distinct(t))).cast("long").alias("n_dup_lines"),
                F.size(ls).cast("long").alias("n_lines"),
                F.size(bad).cast("long").alias("n_failed_lines"),
                F.aggregate(bad, F.lit(0).cast("long"), lambda a, r: a + _chars(r["s"])).alias("lost_chars"),
                F.array_join(F.filter(ls, lambda r: ~r["bad"])["s"], "\n").alias("clean_text"))
        return let(lines, results)

    keep = [c for c in df.columns if c not in RESULTS]
    x = F.coalesce(F.col(text), F.lit(""))
    # one generated row: no later filter makes Spark evaluate the rules a second time
    r = F.explode(F.array(F.struct(of_words(x).alias("w"), of_lines(x).alias("l"),
                                   F.regexp_count(x, F.lit(SYMBOLS)).cast("long").alias("n_symbols")))).alias("__r")
    out = df.select(*keep, r).select(*keep, "__r.w.*", "__r.n_symbols", "__r.l.*")
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    lost = F.col("lost_chars") > F.lit(max_lost_share) * F.col("word_chars")
    return out.withColumns({"base_failed": base, "kept": ~(base | lost)})
