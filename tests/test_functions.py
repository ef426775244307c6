"""Golden and property tests for the scalar functions."""

import math

from pyspark.sql import functions as F

from editlens.functions import distance as D
from editlens.functions import ngrams as N
from editlens.functions import tokens as T


def one(spark, col, data, schema):
    return spark.createDataFrame(data, schema).select(col.alias("x")).collect()[0]["x"]


def test_camel_split(spark):
    assert one(spark, T.camel_case_split("s"), [("HTTPServerError2xx",)], "s string") == \
        ["HTTP", "Server", "Error2xx"]


def test_identifier_keep_underscore(spark):
    assert one(spark, T.identifier_split("s"), [("__init__",)], "s string") == ["__", "init", "__"]


def test_tokenize_with_con(spark):
    got = one(spark, T.tokenize_with_con("s"), [("getValue() is fine",)], "s string")
    assert got == ["get", "<con>", "Value", "<con>", "(", "<con>", ")", "is", "fine"]
    assert one(spark, T.tokenize_with_con("s"), [(None,)], "s string") == []


def test_word_edit_distance_golden(spark):
    d = one(spark, D.word_edit_distance_col("a", "b"),
            [(["the", "quick", "fox"], ["a", "quick", "brown", "fox"])], "a array<string>, b array<string>")
    assert d == 2


def _py_ed(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def _py_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


def test_ed_and_lcs_match_dp(spark):
    import random
    rnd = random.Random(7)
    rows = []
    for _ in range(60):
        a = [rnd.choice("abcdef") for _ in range(rnd.randint(0, 9))]
        b = [rnd.choice("abcdef") for _ in range(rnd.randint(0, 9))]
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select("a", "b", D.word_edit_distance_col("a", "b").alias("ed"), D.lcs_length_udf("a", "b").alias("lcs2"),
                    D.word_edit_distance_col("b", "a").alias("ed2"), D.lcs_length_col("a", "b").alias("lcs")).collect()
    for r in got:
        assert r["ed"] == _py_ed(r["a"], r["b"]) == r["ed2"]
        assert r["lcs"] == _py_lcs(r["a"], r["b"]) == r["lcs2"]
        assert (r["ed"] == 0) == (r["a"] == r["b"])


def test_sari_golden(spark):
    s = "About 95 species are currently accepted ."
    cands = ["About 95 you now get in .", "About 95 species are now agreed .",
             "About 95 species are currently agreed ."]
    refs = ["About 95 species are currently known .", "About 95 species are now accepted .",
            "95 species are now accepted ."]
    df = spark.createDataFrame([(s, c, refs) for c in cands], "s string, c string, r array<string>")
    got = [r["x"] for r in N.sari_sentences(df, "s", "c", "r", "x").orderBy("c").collect()]
    got = [dict(zip(cands, [None] * 3))] and [r["x"] for r in sorted(
        N.sari_sentences(df, "s", "c", "r", "x").collect(), key=lambda r: cands.index(r["c"]))]
    want = [0.2682782412, 0.5889995423, 0.5071608865]
    for g, w in zip(got, want):
        assert math.isclose(g, w, abs_tol=1e-9)


def test_sari_identical(spark):
    df = spark.createDataFrame([("a b c", "a b c", ["a b c"])], "s string, c string, r array<string>")
    assert math.isclose(N.sari_sentences(df, "s", "c", "r").collect()[0]["sari"], 0.25)


def test_ngrams_short(spark):
    assert one(spark, F.expr(N.ngrams("a", 3)), [(["x", "y"],)], "a array<string>") == []
    assert one(spark, F.expr(N.ngrams("a", 2)), [(["x", "y", "z"],)], "a array<string>") == ["x y", "y z"]


def test_change_types(spark):
    rows = [([("T1", "NONE", "K1 : a"), ("T2", "LOW", " K2 : b:c"), ("T2", "HIGH", "K2:z")],)]
    got = one(spark, T.change_types("t"), rows,
              "t array<struct<change_type:string,significance:string,content:string>>")
    assert sorted(got) == ["T2:K2"]
    assert one(spark, T.change_types("t"), [(None,)],
               "t array<struct<change_type:string,significance:string,content:string>>") == []


def test_output_fallback(spark):
    df = spark.createDataFrame([("x new comment: y new comment:  z ", "s"), (None, "s"), ("new comment:  ", "s")],
                               "o string, s string")
    assert [r[0] for r in df.select(T.output_fallback("o", "s")).collect()] == ["z", "s", "s"]
