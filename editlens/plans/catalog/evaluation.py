"""E3 evaluation and its parts (C3-C11, A3-A11, P5, P11) over fx_samples.

Prediction records: ``hyp_toks`` joined by spaces is the generated comment,
``ref_toks`` the reference, ``src_toks`` the old comment, ``level`` the change level.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...fixtures import Tables, samples
from ...functions import tokens as T
from ...operators.evaluation import (edit_distance_rows, edit_sign_histogram, eval_report, eval_rows,
                                     format_report)
from ...oracle import with_fx
from ...registry import register
from . import duck as d


def _rows(spark, sf_dir):
    # the raw texts are spread over all tasks: a row's scores cost more than its way
    raw = Tables(spark, sf_dir).conversations.select("conv_id", "turn", "role", "text")
    s = samples(raw.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    s = s.withColumn("pred_text", F.array_join("hyp_toks", " ")).withColumn("ref_text", F.array_join("ref_toks", " "))
    return eval_rows(s, "ref_toks", "src_toks", "pred_text", "ref_text")


# ---- DuckDB: per-row statistics, long-form n-gram counts ----------------------
_SIDES = [("S", "s_w"), ("C", "c_w"), ("R", "r_w"), ("GS", "gs"), ("GR", "gr"), ("GH", "gh"),
          ("BH", "bh"), ("BR", "br")]
_B0 = f"""b0 as (select sample_id, "index", cast(level as int) as level,
  {d.lower_all(d.nonempty('ref_toks'))} as ref_l,
  {d.lower_all(d.nonempty('src_toks'))} as src_l,
  {d.lower_all(d.c3("array_to_string(hyp_toks, ' ')"))} as pred_l,
  case when {d.norm_text("array_to_string(ref_toks, ' ')")} = {d.norm_text("array_to_string(hyp_toks, ' ')")}
       then 1 else 0 end as acc
 from fx_samples)"""
_B1 = f"""b1 as (select *, list_distinct(list_concat(pred_l, ref_l)) as v1, list_distinct(list_concat(src_l, ref_l)) as v2,
  string_split(lower({d.detok('src_l')}), ' ') as s_w, string_split(lower({d.detok('pred_l')}), ' ') as c_w,
  string_split(lower({d.detok('ref_l')}), ' ') as r_w,
  {d.c8('src_l')} as gs, {d.c8('ref_l')} as gr, {d.c8('pred_l')} as gh,
  {d.nonempty(f"regexp_split_to_array({d.detok('pred_l')}, '\\s+')")} as bh,
  {d.nonempty(f"regexp_split_to_array({d.detok('ref_l')}, '\\s+')")} as br,
  string_split({d.detok('pred_l')}, ' ') as rc, string_split({d.detok('ref_l')}, ' ') as rr
 from b0)"""
_B2 = f"""b2 as (select *, {d.word_ed('pred_l', 'ref_l', 'v1')} as ed_hyp, {d.word_ed('src_l', 'ref_l', 'v2')} as ed_src,
  {d.lcs('rr', 'rc')} as lcs from b1)"""
_NG = ("ng as (select sample_id, \"index\", n, side, unnest(g) as gram from (\n" + "\n union all ".join(
    f"select sample_id, \"index\", n, '{s}' as side, {d.grams(c, 'n')} as g from b1, range(1, 5) t(n)"
    for s, c in _SIDES) + "))")
_CN = ("cn as (select sample_id, \"index\", n, gram, " + ", ".join(
    f"count(*) filter (where side = '{s}') as n_{s}" for s, _ in _SIDES) + " from ng group by all)")
_PER_N = """per_n as (select sample_id, "index", n,
  count(*) filter (where n_S > 0 and n_C > 0) as keep_n,
  coalesce(sum(least(n_S, n_C, n_R) / least(n_S, n_C)) filter (where n_S > 0 and n_C > 0 and n_R > 0), 0) as kt1,
  count(*) filter (where n_S > 0 and n_R > 0) as keepall_n,
  coalesce(sum(least(n_S, n_C, n_R) / least(n_S, n_R)) filter (where n_S > 0 and n_C > 0 and n_R > 0), 0) as kt2,
  count(*) filter (where n_S > n_C) as del_n,
  coalesce(sum((n_S - n_C - n_R) / (n_S - n_C)) filter (where n_S > n_C and n_S - n_C > n_R), 0) as dt1,
  count(*) filter (where n_C > 0 and n_S = 0) as add_n,
  count(*) filter (where n_C > 0 and n_S = 0 and n_R > 0) as add_good,
  count(*) filter (where n_R > 0 and n_S = 0) as add_all,
  greatest(sum(least(n_GH, n_GR)) - sum(least(n_GH, case when n_GR > 0 then 0 else n_GS end)), 0) as gm,
  sum(least(n_BH, n_BR)) as bc
 from cn group by all)"""
_PN = """pn as (select k.sample_id, k."index", k.n,
  case when coalesce(keep_n, 0) > 0 then kt1 / keep_n else 0 end as kp,
  case when coalesce(keepall_n, 0) > 0 then kt2 / keepall_n else 0 end as kr,
  case when coalesce(del_n, 0) > 0 then dt1 / del_n else 0 end as dp,
  case when coalesce(add_n, 0) > 0 then add_good / add_n else 0 end as ap,
  case when coalesce(add_all, 0) > 0 then add_good / add_all else 0 end as ar,
  coalesce(gm, 0) as gm, coalesce(bc, 0) as bc
 from (select sample_id, "index", n from b1, range(1, 5) t(n)) k left join per_n using (sample_id, "index", n))"""
_F1 = "case when {p} > 0 or {r} > 0 then 2 * {p} * {r} / ({p} + {r}) else 0 end"
_ROWSTAT = ("rs as (select sample_id, \"index\", sum(" + _F1.format(p="kp", r="kr") + " + dp + "
            + _F1.format(p="ap", r="ar") + ") / 12 as sari, "
            + ", ".join(f"cast(sum(gm) filter (where n = {i}) as bigint) as m{i}, "
                        f"cast(sum(bc) filter (where n = {i}) as bigint) as bc{i}"
                        for i in range(1, 5)) + " from pn group by all)")
_ROWS = """rows as (select b2.sample_id, b2."index", level, acc, ed_hyp, ed_src, sari,
  case when lcs > 0 then ((1 + 1.44) * (lcs / len(rc)) * (lcs / len(rr))) / ((lcs / len(rr)) + 1.44 * (lcs / len(rc)))
       else 0 end as rouge_l,
  len(gh) as gc, len(gr) as gr_len, m1, m2, m3, m4,
  greatest(len(gh), 0) as d1, greatest(len(gh) - 1, 0) as d2, greatest(len(gh) - 2, 0) as d3, greatest(len(gh) - 3, 0) as d4,
  len(bh) as testlen, len(br) as reflen,
  greatest(len(bh), 0) as bg1, greatest(len(bh) - 1, 0) as bg2, greatest(len(bh) - 2, 0) as bg3, greatest(len(bh) - 3, 0) as bg4,
  bc1, bc2, bc3, bc4
 from b2 join rs using (sample_id, "index"))"""
_CTES = ",\n".join([_B0, _B1, _B2, _NG, _CN, _PER_N, _PN, _ROWSTAT, _ROWS])

_GLEU = ("case when least(gc, gr_len, m1, m2, m3, m4, d1, d2, d3, d4) = 0 then 0.0 else "
         "exp(least(0, 1 - gr_len / gc) + (ln(m1 / d1) + ln(m2 / d2) + ln(m3 / d3) + ln(m4 / d4)) / 4) end")
_BLEU = ("pow(((bc1 + 1e-15) / (bg1 + 1e-9)) * ((bc2 + 1e-15) / (bg2 + 1e-9)) * ((bc3 + 1e-15) / (bg3 + 1e-9))"
         " * ((bc4 + 1e-15) / (bg4 + 1e-9)), 0.25) * case when (testlen + 1e-15) / (reflen + 1e-9) < 1 "
         "then exp(1 - 1 / ((testlen + 1e-15) / (reflen + 1e-9))) else 1 end")
_SUMS = ("select cast(coalesce(level, -1) as int) as level, count(*) as n, cast(sum(acc) as bigint) as correct, "
         "avg(acc) as accuracy, avg(ed_hyp) as aed, avg(ed_src) as src_distance, "
         "count(*) filter (where ed_hyp < ed_src) / count(*) as ess_ratio, "
         "count(*) filter (where ed_hyp > ed_src) / count(*) as increased_ratio, "
         "avg(sari) as sari, avg(rouge_l) as rouge_l, "
         + ", ".join(f"sum({c}) as {c}" for c in ["gc", "gr_len", "m1", "m2", "m3", "m4", "d1", "d2", "d3", "d4",
                                                  "testlen", "reflen", "bg1", "bg2", "bg3", "bg4",
                                                  "bc1", "bc2", "bc3", "bc4"])
         + " from rows group by grouping sets ((level), ())")
_E3 = with_fx("fx_samples", f"""select level, n, correct, accuracy, accuracy as recall, ess_ratio, increased_ratio,
  sari, aed, src_distance, aed / src_distance as red, {_GLEU} as gleu, {_BLEU} as bleu_4, rouge_l
from ({_SUMS}) s""", _CTES)


@register("e3_eval_report", _E3)
def e3_eval_report(spark, sf_dir):
    return eval_report(_rows(spark, sf_dir))


def _pct(c: str, sign: str = "%") -> str:
    return f"printf('%.2f', round({c} * 100, 2)) || '{sign}'"


@register("p11_eval_report_formatted", f"""select level as ChangeLevel, {_pct('accuracy')} as Accuracy,
  '(' || correct || '/' || n || ')' as correct_count_1, {_pct('recall')} as Recall_5, '(' || correct || '/' || n || ')' as correct_count_5,
  {_pct('ess_ratio')} as ESS_ratio, {_pct('sari')} as SARI, round(aed, 3) as AED, round(red, 3) as RED, {_pct('gleu', '')} as GLEU,
  {_pct('bleu_4', '')} as Bleu_4, {_pct('rouge_l', '')} as ROUGE_L from ({_E3})""")
def p11_eval_report_formatted(spark, sf_dir):
    return format_report(eval_report(_rows(spark, sf_dir)))


@register("a6_edit_distance_rows", with_fx("fx_samples", """select sample_id, "index", level, ed_hyp, ed_src,
  case when ed_hyp - ed_src < 0 then 1 else 0 end as correct_labeled, ed_hyp - ed_src as edit_distance_reduced_num
 from rows""", _CTES))
def a6_edit_distance_rows(spark, sf_dir):
    return edit_distance_rows(_rows(spark, sf_dir))


@register("a5_edit_sign_histogram", with_fx("fx_samples", """select level, cast(sign(ed_hyp - ed_src) as int) as sign,
  count(*) as n from rows group by all""", _CTES))
def a5_edit_sign_histogram(spark, sf_dir):
    return edit_sign_histogram(_rows(spark, sf_dir))


@register("a10_sari_rows", with_fx("fx_samples", "select sample_id, \"index\", sari from rows", _CTES))
def a10_sari_rows(spark, sf_dir):
    return _rows(spark, sf_dir).select("sample_id", "index", "sari")


@register("a11_rouge_l_rows", with_fx("fx_samples", "select sample_id, \"index\", rouge_l from rows", _CTES))
def a11_rouge_l_rows(spark, sf_dir):
    return _rows(spark, sf_dir).select("sample_id", "index", "rouge_l")


@register("c9_gleu_stats_rows", with_fx("fx_samples", """select sample_id, "index", gc as c, gr_len as r,
  m1, m2, m3, m4, d1, d2, d3, d4 from rows""", _CTES))
def c9_gleu_stats_rows(spark, sf_dir):
    return _rows(spark, sf_dir).select("sample_id", "index", "gleu.*")


@register("c11_word_edit_distance", with_fx("fx_samples", "select sample_id, \"index\", ed_hyp, ed_src from rows",
                                            _CTES))
def c11_word_edit_distance(spark, sf_dir):
    return _rows(spark, sf_dir).select("sample_id", "index", "ed_hyp", "ed_src")


@register("c3_tokenize_with_con", with_fx("fx_samples", f"""select sample_id, "index",
  {d.c3("array_to_string(hyp_toks, ' ')")} as tokens from fx_samples"""))
def c3_tokenize_with_con(spark, sf_dir):
    s = samples(Tables(spark, sf_dir).conversations)
    return s.select("sample_id", "index", T.tokenize_with_con(F.array_join("hyp_toks", " ")).alias("tokens"))


@register("c7_comments_equal", with_fx("fx_samples", """select sample_id, "index", acc from b0""", _B0))
def c7_comments_equal(spark, sf_dir):
    return _rows(spark, sf_dir).select("sample_id", "index", "acc")


@register("c8_gleu_normalize", with_fx("fx_samples", "select sample_id, \"index\", gh as tokens from b1",
                                       ",\n".join([_B0, _B1])))
def c8_gleu_normalize(spark, sf_dir):
    return _rows(spark, sf_dir).select("sample_id", "index", T.gleu_normalize("pred_l").alias("tokens"))


@register("c6_detokenize", with_fx("fx_samples", f"select sample_id, \"index\", {d.detok('pred_l')} as text from b0",
                                   _B0))
def c6_detokenize(spark, sf_dir):
    return _rows(spark, sf_dir).select("sample_id", "index", T.detokenize("pred_l").alias("text"))


# ---- corpus aggregates (A3, A4, A7, A9, A18) ------------------------------------------
@register("a3_accuracy_by_level", with_fx("fx_samples", """select cast(coalesce(level, -1) as int) as level,
  count(*) as n, cast(sum(acc) as bigint) as correct, avg(acc) as accuracy
  from rows group by grouping sets ((level), ())""", _CTES))
def a3_accuracy_by_level(spark, sf_dir):
    return eval_report(_rows(spark, sf_dir)).select("level", "n", "correct", "accuracy")


@register("a4_edit_distance_summary", with_fx("fx_samples", """select cast(coalesce(level, -1) as int) as level,
  avg(ed_hyp) as aed, avg(ed_src) as src_distance, avg(ed_hyp) / avg(ed_src) as red,
  count(*) filter (where ed_hyp < ed_src) / count(*) as ess_ratio,
  count(*) filter (where ed_hyp > ed_src) / count(*) as increased_ratio
  from rows group by grouping sets ((level), ())""", _CTES))
def a4_edit_distance_summary(spark, sf_dir):
    return eval_report(_rows(spark, sf_dir)).select("level", "aed", "src_distance", "red", "ess_ratio",
                                                    "increased_ratio")


@register("a7_gleu_corpus", with_fx("fx_samples", f"select level, {_GLEU} as gleu from ({_SUMS}) s", _CTES))
def a7_gleu_corpus(spark, sf_dir):
    return eval_report(_rows(spark, sf_dir)).select("level", "gleu")


@register("a9_score_stats", with_fx("fx_samples", """select avg(sari) as mean, stddev_pop(sari) as std,
  avg(sari) - 1.959963984540054 * stddev_pop(sari) as ci_lo, avg(sari) + 1.959963984540054 * stddev_pop(sari) as ci_hi
  from rows""", _CTES))
def a9_score_stats(spark, sf_dir):
    from ...operators.stats import mean_std_ci
    return mean_std_ci(_rows(spark, sf_dir), "sari")


_A18 = """select role as method, cast(level as int) as level, cast(sample_id % 5 * 2 + 1 as int) as sample_k,
  avg(acc) as accuracy from rows join (select sample_id, "index", role from fx_samples) using (sample_id, "index")
  where role = (select min(role) from fx_samples) group by all"""


@register("a18_accuracy_by_k", with_fx("fx_samples", _A18, _CTES))
def a18_accuracy_by_k(spark, sf_dir):
    s = samples(Tables(spark, sf_dir).conversations)
    r = _rows(spark, sf_dir).join(s.select("sample_id", "index", "role"), ["sample_id", "index"])
    first = s.agg(F.min("role").alias("method"))                 # one row: the first method (O2)
    r = r.join(F.broadcast(first), F.col("role") == F.col("method"))
    return (r.groupBy("method", F.col("level").cast("int").alias("level"),
                      (F.col("sample_id") % 5 * 2 + 1).cast("int").alias("sample_k"))
            .agg(F.avg("acc").alias("accuracy")))


@register("c10_sari_sentence", with_fx("fx_samples", "select sample_id, \"index\", sari from rows", _CTES))
def c10_sari_sentence(spark, sf_dir):
    """C10 per sentence (multi-reference form; one reference here)."""
    from ...functions.ngrams import sari_sentences
    r = _rows(spark, sf_dir)
    det = lambda c: f"regexp_replace(array_join({c}, ' '), ' <con> ', '')"        # noqa: E731
    r = r.selectExpr("sample_id", "`index`", f"{det('src_l')} as s", f"{det('pred_l')} as c",
                     f"array({det('ref_l')}) as refs")
    return sari_sentences(r, "s", "c", "refs").select("sample_id", "index", "sari")
