"""DuckDB SQL fragments for oracles (independent re-statements of the formulas)."""

from __future__ import annotations

PUNCT = r"""([-!"#$%&''()*+,./:;<=>?@\[\\\]^`{|}~])"""
GLEU_STRIP = " !\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~_"
GLEU_RULES = [
    (" <con> ,", " ,"), (" <con> #", " #"), (" <con> (", " ("), ("( <con> ", "( "),
    (" <con> )", " )"), (") <con> ", ") "), (" <con> {", " {"), (" <con> }", " }"),
    (" <con> @", " @"), ("# <con> ", "# "), (" <con> ", ""),
]


def nonempty(lst: str) -> str:
    return f"list_filter({lst}, lambda t: t <> '')"


def lower_all(lst: str) -> str:
    return f"list_transform({lst}, lambda t: lower(t))"


def camel(s: str) -> str:
    return (f"regexp_replace(regexp_replace({s}, '([A-Z]+)', ' \\1', 'g'), "
            f"'([A-Z][a-z])', ' \\1', 'g')")


def ident_split(s: str, keep_underscore: bool = True) -> str:
    pad = (f"regexp_replace({s}, '(_+)', ' \\1 ', 'g')" if keep_underscore
           else f"regexp_replace({s}, '_+', ' ', 'g')")
    return nonempty(f"regexp_split_to_array({camel(pad)}, '\\s+')")


def c3(text: str) -> str:
    """tokenize_text_with_con."""
    pieces = ident_split(f"replace(regexp_replace(w, '{PUNCT}', ' \\1 ', 'g'), '\"', '``')")
    joined = nonempty(f"string_split(array_to_string({pieces}, ' <con> '), ' ')")
    words = nonempty(f"regexp_split_to_array(coalesce({text}, ''), '\\s+')")
    return f"flatten(list_transform({words}, lambda w: {joined}))"


def norm_text(text: str) -> str:
    return f"lower(replace(array_to_string({c3(text)}, ''), '<con>', ''))"


def detok(lst: str) -> str:
    return f"replace(array_to_string({lst}, ' '), ' <con> ', '')"


def c8(lst: str) -> str:
    s = f"array_to_string({lst}, ' ')"
    for a, b in GLEU_RULES:
        s = f"replace({s}, '{a}', '{b}')"
    return f"string_split(lower(trim({s}, '{GLEU_STRIP}')), ' ')"


def grams(lst: str, n: str) -> str:
    return f"list_transform(range(1, len({lst}) - {n} + 2), lambda i: array_to_string({lst}[i:i + {n} - 1], ' '))"


def enc(lst: str, vocab: str) -> str:
    return f"array_to_string(list_transform({lst}, lambda t: chr(32 + list_position({vocab}, t))), '')"


def word_ed(a: str, b: str, vocab: str | None = None) -> str:
    """Word edit distance by the textbook DP (rows carried by ``list_reduce``); no
    vocabulary limit. ``vocab`` is accepted for call compatibility and unused."""
    return (f"cast(list_reduce(range(1, len({a}) + 1), lambda prev, i: list_reduce(range(1, len({b}) + 1), "
            f"lambda row, j: list_append(row, least(prev[j + 1] + 1, row[j] + 1, "
            f"prev[j] + case when {a}[i] = {b}[j] then 0 else 1 end)), [i]), range(0, len({b}) + 1))[-1] as integer)")


def lcs(a: str, b: str) -> str:
    return (f"list_reduce({a}, lambda prev, tok: list_reduce(range(1, len({b}) + 1), lambda row, j: "
            f"list_append(row, case when {b}[j] = tok then prev[j] + 1 else greatest(prev[j + 1], row[j]) end), [0]), "
            f"list_transform(range(0, len({b}) + 1), lambda i: 0))[-1]")
