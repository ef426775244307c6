"""Edit-sequence features (W9, W10, W11, C5, C19, C21, C13, C13b -> E6).

The edit sequence is kept in long form ``(key, pos, src, dst, op)``. Counting
features are grouped aggregates with map-side combine; neighbouring elements are
found with an equi-join on ``(key, pos - 1)`` (unique keys: no skew). Only the
connector merge (W11) needs a running group id, a window per edit pair whose size
is bounded by the method length.
"""


import pandas as pd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["sample_id", "index"]
CON = "<con>"
# Python's string.punctuation (the reference tests substring membership).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Branch keywords of the re-aimed cyclomatic complexity.
BRANCH_RE = r"\b(if|for|while|case|catch)\b"


def is_connector(src="src", dst="dst"):
    return (F.col(src) == CON) | (F.col(dst) == CON)


def with_prev(seq: DataFrame, key=KEY) -> DataFrame:
    """Attach the previous element's ``op`` and connector flag via ``(key, pos-1)``."""
    prev = seq.select(*key, (F.col("pos") + 1).alias("pos"), F.col("op").alias("prev_op"),
                      is_connector().alias("prev_con"))
    return seq.join(prev, [*key, "pos"], "left")


def modified_chunks(seq: DataFrame, key=KEY) -> DataFrame:
    """W9 NMC: number of maximal runs of non-``equal`` ops."""
    d = with_prev(seq, key)
    start = (F.col("op") != "equal") & (F.col("prev_op").isNull() | (F.col("prev_op") == "equal"))
    return d.groupBy(*key).agg(F.count_if(start).alias("NMC"))


def merge_connectors(seq: DataFrame, key=KEY) -> DataFrame:
    """W11 ``get_token_change_seq``: an element next to ``<con>`` is glued to its
    predecessor; merged groups get their op recomputed (equal / insert / delete /
    replace). Leading / trailing connectors are dropped, adjacent ones collapsed."""
    d = with_prev(seq, key).withColumn("__con", is_connector())
    start = ~(F.col("__con") | F.coalesce(F.col("prev_con"), F.lit(False)))
    w = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("grp", F.sum(start.cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.when(~F.col("__con"), F.struct("pos", "src", "dst", "op"))))
    g = d.groupBy(*key, "grp").agg(parts.alias("__p"), F.count(F.lit(1)).alias("__n"))
    src = F.array_join(F.transform("__p", lambda x: x["src"]), "")
    dst = F.array_join(F.transform("__p", lambda x: x["dst"]), "")
    g = g.where(F.size("__p") > 0).select(*key, F.col("__p")[0]["pos"].alias("pos"), src.alias("src"),
                                          dst.alias("dst"), F.col("__p")[0]["op"].alias("__op0"), "__n")
    op = (F.when(F.col("__n") == 1, F.col("__op0"))
          .when(F.col("src") == F.col("dst"), "equal").when(F.col("src") == "", "insert")
          .when(F.col("dst") == "", "delete").otherwise("replace"))
    return g.select(*key, "pos", "src", "dst", op.alias("op"))


def count_features(seq: DataFrame, prefix: str, key=KEY) -> DataFrame:
    """C19 NMS/NMT (# non-equal, non-connector) and NNSRP/NNTRP (# distinct such triples)."""
    mod = (F.col("op") != "equal") & ~is_connector()
    return seq.groupBy(*key).agg(
        F.count_if(mod).alias(f"{prefix}_modified"),
        F.count_distinct(F.when(mod, F.struct("src", "dst", "op"))).alias(f"{prefix}_distinct"))


def _symbol(tok):
    return (tok == "") | (tok == CON) | (F.instr(F.lit(PUNCTUATION), tok) > 0)


def desc_consistency(code: DataFrame, desc: DataFrame, out: str, key=KEY) -> DataFrame:
    """C19 NSOD / NTOD (+ J11): code source tokens that also appear among the
    description's source tokens but not among the code's new tokens, punctuation
    and connectors excluded. Exploded equi-joins on (key, token)."""
    code_src = code.select(*key, F.col("src").alias("tok")).distinct()
    desc_src = desc.select(*key, F.col("src").alias("tok")).distinct()
    code_dst = code.select(*key, F.col("dst").alias("tok")).distinct()
    cons = code_src.join(desc_src, [*key, "tok"], "left_semi").where(~_symbol(F.col("tok")))
    kept = cons.join(code_dst, [*key, "tok"], "left_anti")
    return kept.groupBy(*key).agg(F.count(F.lit(1)).alias(out))


def method_texts(seq: DataFrame, key=KEY, tokens_per_line: int = 6) -> DataFrame:
    """Old / new method text of each pair: tokens in order, ``tokens_per_line``
    tokens per line (connectors and empty tokens dropped)."""
    keep = lambda c: F.when((F.col(c) != "") & (F.col(c) != CON), F.struct("pos", F.col(c).alias("t")))  # noqa
    g = seq.groupBy(*key).agg(F.array_sort(F.collect_list(keep("src"))).alias("s"),
                              F.array_sort(F.collect_list(keep("dst"))).alias("d"))

    def lines(arr):
        toks = F.transform(arr, lambda x: x["t"])
        return F.array_join(F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil(F.size(toks) / tokens_per_line) - 1, F.lit(0))),
            lambda i: F.array_join(F.slice(toks, i * tokens_per_line + 1, tokens_per_line), " ")), "\n")

    return g.select(*key, lines("s").alias("src_method"), lines("d").alias("dst_method"))


def branch_complexity(text) -> F.Column:
    """C21 re-aimed: 1 + branch keywords + ``&&`` + ``||`` + ``?`` occurrences."""
    t = F.coalesce(text, F.lit(""))
    cnt = lambda s: (F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))) / len(s)
    return (1 + F.regexp_count(t, F.lit(BRANCH_RE)) + cnt("&&") + cnt("||") + cnt("?")).cast("int")


# Tokens of C-like text that decide its flow or nest it. Strings, signs and comments are read over first.
LITERAL_RE = r'"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'|//[^\n]*+|/\*[\s\S]*?\*/'
HEADER_RE = r"\b\w+\s*\([^(){};]*\)\s*\{"
CONTROL_RE = r"^(?:if|for|while|switch|catch|synchronized)\b"
FLOW_RE = r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?"


def function_complexity(text) -> F.Column:
    """1 + branch keywords, ``&&``, ``||`` and ``?`` of the first function of a C-like text, 0 if it has none.

    One pass from the left takes strings, characters and comments out, the next one cuts the rest into tokens: names with
    parameters and an open brace, braces, and tokens that branch. A name that is no control keyword opens the function,
    and the brace that brings the depth back closes it (or the end of the text). Null texts have no function."""
    code = F.regexp_replace(F.coalesce(text, F.lit("")), LITERAL_RE, " ")
    tokens = F.regexp_extract_all(code, F.lit(f"({HEADER_RE}|[{{}}]|{FLOW_RE})"), 1)
    zero = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("base"), F.lit(0).alias("cc"), F.lit(False).alias("done"))

    def step(s, t):
        header = t.rlike("^" + HEADER_RE + "$")
        opens = header & ~t.rlike(CONTROL_RE) & (s["base"] < 0)
        inside = (s["base"] >= 0) & ~s["done"]
        depth = s["depth"] + F.when(header | (t == "{"), 1).when(t == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when(opens, s["depth"]).otherwise(s["base"]).alias("base"),
                        F.when(opens, 1 + F.regexp_count(t, F.lit(FLOW_RE))).when(inside, s["cc"] + F.regexp_count(t, F.lit(FLOW_RE)))
                        .otherwise(s["cc"]).cast("int").alias("cc"),
                        (s["done"] | (inside & (t == "}") & (depth <= s["base"]))).alias("done"))
    return F.aggregate(tokens, zero, step, lambda s: s["cc"])


def function_complexity_delta(src, dst) -> F.Column:
    """0 unless both texts have a function."""
    a, b = function_complexity(src), function_complexity(dst)
    return F.when((a > 0) & (b > 0), F.abs(a - b)).otherwise(0)


def cc_delta(src, dst) -> F.Column:
    return F.abs(branch_complexity(src) - branch_complexity(dst))


# ---- line diff ---------------------------------------------------------------
def line_multiset_diff(texts: DataFrame, key=KEY) -> DataFrame:
    """C13b (scalable sibling): lines exploded, per (key, line) count in old and new;
    added = sum(max(new-old, 0)), removed = sum(max(old-new, 0)), NML = max."""
    lines = lambda c, side: texts.select(*key, F.explode(F.split(F.col(c), "\n")).alias("line"),
                                         F.lit(side).alias("side"))
    long = lines("src_method", "s").unionByName(lines("dst_method", "d"))
    per = long.groupBy(*key, "line").agg(F.count_if(F.col("side") == "s").alias("ns"),
                                         F.count_if(F.col("side") == "d").alias("nd"))
    agg = per.groupBy(*key).agg(F.sum(F.greatest(F.col("nd") - F.col("ns"), F.lit(0))).alias("added"),
                                F.sum(F.greatest(F.col("ns") - F.col("nd"), F.lit(0))).alias("removed"))
    return agg.select(*key, F.col("added").cast("long"), F.col("removed").cast("long"),
                      F.greatest("added", "removed").cast("long").alias("NML"))
