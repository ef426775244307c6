"""Tokenisers and token-list functions (C1-C8, C16) as Column expressions.

Everything is built from ``regexp_replace`` / ``split`` / higher-order array
functions, so it runs JVM-side inside whole-stage codegen; no Python UDF.
NLTK is not reproduced: of its rewrites only the double-quote rule is applied
(after punctuation padding every ``"`` starts a token and becomes two backticks).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CON = "<con>"
# ASCII punctuation padded by the comment tokenisers (underscore
# excluded; identifiers are split on it separately).
PUNCT_RE = r"""([-!"#$%&'()*+,./:;<=>?@\[\\\]^`{|}~])"""
# Characters stripped from both ends by the GLEU normaliser.
GLEU_STRIP = " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~_"
# GLEU connector clean-up, applied in this order.
GLEU_CON_RULES = [
    (" <con> ,", " ,"), (" <con> #", " #"), (" <con> (", " ("), ("( <con> ", "( "),
    (" <con> )", " )"), (") <con> ", ") "), (" <con> {", " {"), (" <con> }", " }"),
    (" <con> @", " @"), ("# <con> ", "# "), (" <con> ", ""),
]
WS = r"(?U)\s+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nonempty(arr: Column) -> Column:
    return F.filter(arr, lambda t: t != F.lit(""))


def camel_spaced(s: Column) -> Column:
    """C1 core: a space before each uppercase run and before ``[A-Z][a-z]``."""
    return F.regexp_replace(F.regexp_replace(s, "([A-Z]+)", " $1"), "([A-Z][a-z])", " $1")


def camel_case_split(s) -> Column:
    """``HTTPServerError2xx`` -> [HTTP, Server, Error2xx]."""
    return nonempty(F.split(F.trim(camel_spaced(_c(s))), WS))


def identifier_split(s, keep_underscore: bool = True, lower: bool = False) -> Column:
    """C2 ``tokenize_identifier_raw``: split on ``_+`` (kept as tokens or dropped), then C1."""
    padded = (F.regexp_replace(_c(s), "(_+)", " $1 ") if keep_underscore
              else F.regexp_replace(_c(s), "_+", " "))
    toks = nonempty(F.split(camel_spaced(padded), WS))
    return F.transform(toks, F.lower) if lower else toks


def join_con(pieces: Column) -> Column:
    """``" <con> ".join(pieces).split()``."""
    return nonempty(F.split(F.array_join(pieces, f" {CON} "), " "))


def identifier_tokens(s, with_con: bool = False) -> Column:
    """C2 ``tokenize_identifier``: with ``<con>`` glue, or lower-cased without underscores."""
    if with_con:
        return join_con(identifier_split(s, keep_underscore=True))
    return identifier_split(s, keep_underscore=False, lower=True)


def _word_pieces(w: Column) -> Column:
    padded = F.regexp_replace(F.regexp_replace(w, PUNCT_RE, " $1 "), '"', "``")
    return identifier_split(padded, keep_underscore=True)


def tokenize_with_con(text) -> Column:
    """C3 ``tokenize_text_with_con``: per whitespace word, pad punctuation, split
    identifiers, and glue the pieces of one word with ``<con>``. Null -> []."""
    words = nonempty(F.split(F.coalesce(_c(text), F.lit("")), WS))
    return F.flatten(F.transform(words, lambda w: join_con(_word_pieces(w))))


def tokenize_text(text) -> Column:
    """C4 ``tokenize_text``: lower-cased tokens without ``<con>`` and underscores."""
    padded = F.regexp_replace(F.regexp_replace(F.coalesce(_c(text), F.lit("")), PUNCT_RE, " $1 "),
                              '"', "``")
    return identifier_split(padded, keep_underscore=False, lower=True)


def tokenize_string_literal(lit, with_con: bool = False) -> Column:
    """C4 literal variant: drop the first and last character (the quotes) first."""
    s = _c(lit)
    body = F.when(F.length(s) >= 2, s.substr(F.lit(2), F.length(s) - 2)).otherwise(F.lit(""))
    return tokenize_with_con(body) if with_con else tokenize_text(body)


def strip_tokens(arr, drop=("", CON), lower: bool = False) -> Column:
    """C5 helper: drop ``''`` / ``<con>`` tokens, optionally lower-case."""
    out = F.filter(_c(arr), lambda t: ~t.isin(*drop))
    return F.transform(out, F.lower) if lower else out


def is_alpha(tok: Column) -> Column:
    """Python ``str.isalpha``: non-empty and letters only (Unicode aware)."""
    return tok.rlike(r"^\p{L}+$")


def detokenize(tokens) -> Column:
    """C6 ``recover_desc``: join with spaces and remove ``" <con> "``."""
    return F.regexp_replace(F.array_join(_c(tokens), " "), " <con> ", "")


def normalized_text(text, ignore_case: bool = True) -> Column:
    """C7 core: tokens (C3) joined without separator, ``<con>`` removed."""
    s = F.replace(F.array_join(tokenize_with_con(text), ""), F.lit(CON), F.lit(""))
    return F.lower(s) if ignore_case else s


def comments_equal(ref, pred, ignore_case: bool = True) -> Column:
    """C7 ``comments_equal``: normalised texts are equal."""
    return normalized_text(ref, ignore_case) == normalized_text(pred, ignore_case)


def recall_at_k(ref, preds, k: int, ignore_case: bool = True) -> Column:
    """C7 ``comments_recall``: any of the first ``k`` predictions equals the reference."""
    r = normalized_text(ref, ignore_case)
    return F.exists(F.slice(_c(preds), 1, k), lambda p: normalized_text(p, ignore_case) == r)


def gleu_text(tokens) -> Column:
    """The text that ``gleu_normalize`` splits."""
    s = F.array_join(_c(tokens), " ")
    for a, b in GLEU_CON_RULES:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.btrim(s, F.lit(GLEU_STRIP))
    return F.lower(s)


def gleu_normalize(tokens) -> Column:
    """C8 GLEU ``split``: connector clean-up, strip punctuation at both ends,
    lower-case, split on single spaces (an empty result is one empty token)."""
    return F.split(gleu_text(tokens), " ")


def change_types(triples) -> Column:
    """C16 ``analyze_change_type_info``: distinct ``type:prefix`` of the
    (type, significance, content) triples whose significance is not NONE;
    prefix = content before the first ``:``, trimmed. Null -> []."""
    arr = F.coalesce(_c(triples), F.array().cast("array<struct<change_type:string,"
                                                 "significance:string,content:string>>"))
    kept = F.filter(arr, lambda t: t["significance"] != F.lit("NONE"))
    return F.array_distinct(F.transform(
        kept, lambda t: F.concat(t["change_type"], F.lit(":"),
                                 F.trim(F.substring_index(t["content"], ":", 1)))))


def composite_key(*cols, sep: str = "@@") -> Column:
    """``id@@index`` string key."""
    return F.concat_ws(sep, *[_c(c).cast("string") for c in cols])


def file_stem(sample_id, index) -> Column:
    """Name ``id`` when index is 0, else ``id_index``."""
    return F.when(_c(index) != 0, F.concat_ws("_", _c(sample_id).cast("string"), _c(index).cast("string"))) \
        .otherwise(_c(sample_id).cast("string"))


def output_fallback(output, source, marker: str = "new comment:") -> Column:
    """Text after the last marker, trimmed; null / empty -> the source text."""
    tail = F.element_at(F.split(_c(output), marker), -1)
    return F.coalesce(F.nullif(F.trim(tail), F.lit("")), _c(source))
