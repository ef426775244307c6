"""Corpus evaluation of generated comments (A3-A11, P5, P11 -> E3).

Per row: exact match (C7), word edit distances (C11), SARI (C10), GLEU and BLEU
statistics (C9) and ROUGE-L, as column expressions and Arrow UDFs over texts. Per level and overall:
one ``rollup(level)`` aggregate (grouping sets ``(level), ()``) whose partial
aggregation runs map-side, so the four reports of the reference (three levels and
``-1`` = all) come from a single scan instead of four.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import ngrams as N
from ..functions import tokens as T


def _lower_all(arr: Column) -> Column:
    return F.transform(arr, F.lower)


def eval_rows(df: DataFrame, ref_tokens: str, src_tokens: str, pred_text: str, ref_text: str,
              level: str = "level", key=("sample_id", "index"), ignore_case: bool = True) -> DataFrame:
    """Per-row evaluation inputs and scores.

    ``ref_tokens`` / ``src_tokens``: token lists of the reference and source comment;
    ``pred_text``: first generated comment (tokenised with C3); ``ref_text``: raw
    reference comment (exact match). Expressions are staged so that every text is
    made once per row. Rows cost CPU: callers spread them before they are widened.
    """
    low = _lower_all if ignore_case else (lambda a: a)
    k = [f"`{c}`" for c in key]
    d = df.select(*key, F.col(level).cast("int").alias("level"),
                  low(T.nonempty(F.col(ref_tokens))).alias("ref_l"),
                  low(T.nonempty(F.col(src_tokens))).alias("src_l"),
                  low(T.tokenize_with_con(F.col(pred_text))).alias("pred_l"),
                  T.normalized_text(F.col(ref_text), ignore_case).alias("__ref_norm"),
                  *([] if ignore_case else [T.normalized_text(F.col(pred_text), False).alias("__pred_norm")]))
    # With ignore_case the prediction's normalised text is its lower-cased C3
    # tokens joined without <con> -- pred_l already holds them
    pred_norm = (F.replace(F.array_join("pred_l", ""), F.lit(T.CON), F.lit("")) if ignore_case
                 else F.col("__pred_norm"))
    d = d.withColumn("acc", (F.col("__ref_norm") == pred_norm).cast("int")).drop("__ref_norm", "__pred_norm")
    detok = lambda c: f"regexp_replace(array_join({c}, ' '), ' <con> ', '')"     # noqa: E731
    ws = lambda s: f"filter(split({s}, '(?U)\\\\s+'), t -> t != '')"             # noqa: E731
    d = d.selectExpr("*", "array_distinct(concat(pred_l, ref_l)) as v1", "array_distinct(concat(src_l, ref_l)) as v2",
                     *[f"{detok(f'{x}_l')} as {x}_t" for x in ("src", "pred", "ref")])
    d = d.select("*", *[T.gleu_text(f"{x}_l").alias(f"{x}_g") for x in ("src", "pred", "ref")],
                 *[F.expr(ws(f"{x}_t")).alias(f"{x}_b") for x in ("pred", "ref")])
    # what passes the UDFs is short: texts and numbers (a row waits beside its UDF, on disk if need be)
    sizes = {"n_gh": "split(pred_g, ' ')", "n_gr": "split(ref_g, ' ')", "n_bh": "pred_b", "n_br": "ref_b",
             "n_rc": "split(pred_t, ' ')", "n_rr": "split(ref_t, ' ')"}
    d = d.selectExpr(
        *k, "level", "acc", "pred_l", "ref_l", "src_l",
        f"{D.word_edit_distance('pred_l', 'ref_l', 'v1')} as ed_hyp",
        f"{D.word_edit_distance('src_l', 'ref_l', 'v2')} as ed_src",
        *[f"{x}_t" for x in ("src", "pred", "ref")], *[f"{x}_g" for x in ("src", "pred", "ref")],
        "array_join(pred_b, ' ') as pred_b", "array_join(ref_b, ' ') as ref_b", *[f"size({x}) as {n}" for n, x in sizes.items()])
    d = d.select(
        *key, "level", "acc", "pred_l", "ref_l", "src_l", "ed_hyp", "ed_src", *sizes,
        N.sari_udf(F.lower("src_t"), F.lower("pred_t"), F.array(F.lower("ref_t"))).alias("sari"),
        N.gleu_udf("pred_g", "ref_g", "src_g").alias("gm"), N.clipped_udf("pred_b", "ref_b").alias("bm"),
        D.lcs_texts_udf("ref_t", "pred_t").alias("lcs"))
    gleu_fields = (["'c', cast(n_gh as bigint)", "'r', cast(n_gr as bigint)"] + [f"'m{n}', gm[{n - 1}]" for n in range(1, 5)]
                   + [f"'d{n}', cast(greatest(n_gh + 1 - {n}, 0) as bigint)" for n in range(1, 5)])
    bleu_fields = (["'testlen', cast(n_bh as bigint)", "'reflen', cast(n_br as bigint)"]
                   + [f"'guess{n}', cast(greatest(n_bh - {n} + 1, 0) as bigint)" for n in range(1, 5)]
                   + [f"'correct{n}', bm[{n - 1}]" for n in range(1, 5)])
    return d.selectExpr(
        *k, "level", "acc", "pred_l", "ref_l", "src_l", "ed_hyp", "ed_src", "sari",
        f"named_struct({', '.join(gleu_fields)}) as gleu", f"named_struct({', '.join(bleu_fields)}) as bleu",
        f"{D.rouge_from_lcs('lcs', 'n_rc', 'n_rr')} as rouge_l")


def eval_report(rows: DataFrame) -> DataFrame:
    """E3 report: one row per level and ``level = -1`` for all rows (P5)."""
    n = F.count(F.lit(1))
    aggs = [
        n.alias("n"), F.sum("acc").alias("correct"),
        F.avg("ed_hyp").alias("aed"), F.avg("ed_src").alias("src_distance"),
        F.count_if(F.col("ed_hyp") < F.col("ed_src")).alias("reduced"),
        F.count_if(F.col("ed_hyp") > F.col("ed_src")).alias("increased"),
        F.avg("sari").alias("sari"), F.avg("rouge_l").alias("rouge_l"),
        *[F.sum(f"gleu.{f}").alias(f"g_{f}") for f in ["c", "r", "m1", "m2", "m3", "m4", "d1", "d2", "d3", "d4"]],
        *[F.sum(f"bleu.{f}").alias(f"b_{f}") for f in
          ["testlen", "reflen", "guess1", "guess2", "guess3", "guess4",
           "correct1", "correct2", "correct3", "correct4"]],
    ]
    agg = (rows.rollup("level").agg(*aggs, F.grouping("level").alias("__g"))
           .withColumn("level", F.when(F.col("__g") == 1, F.lit(-1)).otherwise(F.col("level")).cast("int")))
    gleu = F.expr(N.gleu_from_sums("g_c", "g_r", [f"g_m{i}" for i in range(1, 5)],
                                   [f"g_d{i}" for i in range(1, 5)]))
    bleu = F.expr(N.bleu_from_sums("b_testlen", "b_reflen", [f"b_guess{i}" for i in range(1, 5)],
                                   [f"b_correct{i}" for i in range(1, 5)]))
    acc = F.col("correct") / F.col("n")
    return agg.select(
        "level", F.col("n").cast("long").alias("n"), F.col("correct").cast("long").alias("correct"),
        acc.alias("accuracy"), acc.alias("recall"),
        (F.col("reduced") / F.col("n")).alias("ess_ratio"),
        (F.col("increased") / F.col("n")).alias("increased_ratio"),
        "sari", "aed", "src_distance", (F.col("aed") / F.col("src_distance")).alias("red"),
        gleu.alias("gleu"), bleu.alias("bleu_4"), "rouge_l")


def edit_distance_rows(rows: DataFrame) -> DataFrame:
    """Per-row labels of the edit-distance evaluation."""
    delta = F.col("ed_hyp") - F.col("ed_src")
    return rows.select("sample_id", "index", "level", "ed_hyp", "ed_src",
                       F.when(delta < 0, 1).otherwise(0).alias("correct_labeled"),
                       delta.alias("edit_distance_reduced_num"))


def edit_sign_histogram(rows: DataFrame) -> DataFrame:
    """A5: counts of sign(ed_hyp - ed_src) per level."""
    return (rows.groupBy("level", F.signum(F.col("ed_hyp") - F.col("ed_src")).cast("int").alias("sign"))
            .agg(F.count(F.lit(1)).alias("n")))


def format_report(report: DataFrame) -> DataFrame:
    """The reference's display strings (percentages with 2 decimals, round 3)."""
    pct = lambda c: F.format_string("%.2f%%", F.col(c) * 100)
    return report.select(
        F.col("level").alias("ChangeLevel"),
        pct("accuracy").alias("Accuracy"),
        F.format_string("(%d/%d)", "correct", "n").alias("correct_count_1"),
        pct("recall").alias("Recall_5"),
        F.format_string("(%d/%d)", "correct", "n").alias("correct_count_5"),
        pct("ess_ratio").alias("ESS_ratio"), pct("sari").alias("SARI"),
        F.round("aed", 3).alias("AED"), F.round("red", 3).alias("RED"),
        F.format_string("%.2f", F.col("gleu") * 100).alias("GLEU"),
        F.format_string("%.2f", F.col("bleu_4") * 100).alias("Bleu_4"),
        F.format_string("%.2f", F.col("rouge_l") * 100).alias("ROUGE_L"))
