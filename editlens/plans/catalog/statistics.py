"""Ranking windows, scaling, classifier metrics and statistics
(W1-W4, W12, W14, A12-A22, P12) and the composed jobs E4, E5, E7."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...fixtures import KEY, Tables, changes, features, predictions, raters
from ...operators import classify as C
from ...operators import joins as J
from ...operators import ranking as R
from ...operators import stats as S
from ...operators.scaling import (ALL_COLUMNS, CONTENT_COLUMNS, GROUPS, minmax_scaled, scaled_sum,
                                  standard_scaled, standard_stats)
from ...oracle import with_fx
from ...registry import register
from ..labeling import labels_table
from .labeling import _e1_sql
from .relational import _CT_PER_KEY, _change_types_per_key

K = 'sample_id, "index"'


def _feat(spark, sf_dir):
    return features(Tables(spark, sf_dir).lineitem)


def _e1(spark, sf_dir):
    return labels_table(spark, sf_dir)


_E1_CTE = f"e1 as ({_e1_sql()})"


def _stats_sql(cols):
    return ", ".join(f"min({c}) as mn_{c}, max({c}) as mx_{c}" for c in cols)


def _scaled_sum_sql(cols):
    return "round(" + " + ".join(
        f"(case when mx_{c} > mn_{c} then ({c} - mn_{c}) / (mx_{c} - mn_{c}) else 0.0e0 end)" for c in cols) + ", 9)"


_SIZE = f"sz as (select {K}, {_scaled_sum_sql(GROUPS['size'])} as size_score from fx_features, " \
        f"(select {_stats_sql(GROUPS['size'])} from fx_features) st)"


# ---- scaling ------------------------------------------------------------------
@register("a21_minmax_scale", with_fx("fx_features", f"""select {K}, {', '.join(
    f'case when mx_{c} > mn_{c} then ({c} - mn_{c}) / (mx_{c} - mn_{c}) else 0.0e0 end as {c}' for c in ALL_COLUMNS)}
  from fx_features, (select {_stats_sql(ALL_COLUMNS)} from fx_features) st"""))
def a21_minmax_scale(spark, sf_dir):
    scaled, _ = minmax_scaled(_feat(spark, sf_dir), ALL_COLUMNS)
    return scaled


@register("a22_standard_scale", with_fx("fx_features", f"""select {K}, {', '.join(
    f'({c} - mu_{c}) / case when sd_{c} > 0 then sd_{c} else 1 end as {c}' for c in CONTENT_COLUMNS)}
  from fx_features, (select {', '.join(f'avg({c}) as mu_{c}, stddev_pop({c}) as sd_{c}' for c in CONTENT_COLUMNS)}
                     from fx_features where sample_id % 10 < 8) st where sample_id % 10 >= 8"""))
def a22_standard_scale(spark, sf_dir):
    f = _feat(spark, sf_dir).select(*KEY, *CONTENT_COLUMNS)
    st = standard_stats(f.where(F.col("sample_id") % 10 < 8), CONTENT_COLUMNS)
    return standard_scaled(f.where(F.col("sample_id") % 10 >= 8), CONTENT_COLUMNS, st)


# ---- ranking --------------------------------------------------------------------
@register("w1_rank_min", with_fx("fx_features", f"""select {K}, size_score,
  cast(rank() over (order by size_score desc) as int) as rank from sz""", _SIZE))
def w1_rank_min(spark, sf_dir):
    d = scaled_sum(_feat(spark, sf_dir).select(*KEY, *GROUPS["size"]), GROUPS["size"], "size_score")
    return R.rank_min(d.select(*KEY, "size_score"), "size_score", ascending=False)


def _w2_sql(p=0.15):
    dims = ", ".join(f"{_scaled_sum_sql(GROUPS[d])} as {d}_score" for d in ("size", "structure", "content"))
    sc = f"sc as (select {K}, {dims} from fx_features, (select {_stats_sql(ALL_COLUMNS)} from fx_features) st)"
    rk = ("rk as (select *, round(size_score + 2 * structure_score - content_score, 9) as score from sc), "
          "rr as (select *, cast(rank() over (order by score desc) as int) as rank, count(*) over () as n from rk)")
    body = (f"select {K}, size_score, structure_score, content_score, score, rank, "
            f"case when rank <= ceil(n * {p}) then 1 when rank > n - ceil(n * {p}) then 0 end as label from rr")
    return with_fx("fx_features", body, sc + ",\n" + rk)


@register("w2_weighted_label", _w2_sql())
def w2_weighted_label(spark, sf_dir):
    f = _feat(spark, sf_dir)
    out = R.weighted_dims_label(f, 0.15)
    return out.select(*KEY, "size_score", "structure_score", "content_score", "score", "rank", "label")


@register("w3_top_bottom_flags", with_fx("fx_features", f"""select {K}, size_score,
  row_number() over (order by size_score desc, sample_id, "index") <= ceil(count(*) over () * 0.2) as top,
  row_number() over (order by size_score asc, sample_id, "index") <= ceil(count(*) over () * 0.2) as bottom
  from sz""", _SIZE))
def w3_top_bottom_flags(spark, sf_dir):
    d = scaled_sum(_feat(spark, sf_dir).select(*KEY, *GROUPS["size"]), GROUPS["size"], "size_score")
    return R.top_bottom_flags(d.select(*KEY, "size_score"), "size_score",
                              [("top", 0.2, True), ("bottom", 0.2, False)])


@register("w4_label_by_dims", with_fx("fx_features", f"""select {K}, size_score,
  case when row_number() over (order by size_score asc, sample_id, "index") <= ceil(count(*) over () * 0.2) then 0
       when row_number() over (order by size_score desc, sample_id, "index") <= ceil(count(*) over () * 0.2) then 2
       else 1 end as label from sz""", _SIZE))
def w4_label_by_dims(spark, sf_dir):
    d = w3_top_bottom_flags(spark, sf_dir)
    return d.select(*KEY, "size_score", R.three_way_label(F.col("top"), F.col("bottom"), "label"))


_RK = f"r as (select {K}, size_score, cast(rank() over (order by size_score desc) as int) as rank from sz)"


@register("w12_rank_quantile_label", with_fx("fx_features", """select sample_id, "index", size_score, rank,
  case when rank <= (select quantile_cont(rank, 0.2) from r) then 1 else 0 end as label from r""", _SIZE + ",\n" + _RK))
def w12_rank_quantile_label(spark, sf_dir):
    d = scaled_sum(_feat(spark, sf_dir).select(*KEY, *GROUPS["size"]), GROUPS["size"], "size_score")
    return R.label_by_rank_quantile(d.select(*KEY, "size_score"), "size_score", 0.2, top=True)


@register("w12_rank_quantile_bottom", with_fx("fx_features", """select sample_id, "index", size_score, rank,
  case when rank >= (select quantile_cont(rank, 0.8) from r) then 1 else 0 end as label from r""", _SIZE + ",\n" + _RK))
def w12_rank_quantile_bottom(spark, sf_dir):
    d = scaled_sum(_feat(spark, sf_dir).select(*KEY, *GROUPS["size"]), GROUPS["size"], "size_score")
    return R.label_by_rank_quantile(d.select(*KEY, "size_score"), "size_score", 0.2, top=False)


_FOLDS = f"""folds as (select {K}, y, cast((row_number() over (partition by y
  order by md5(concat('42|', sample_id, '|', "index")), sample_id, "index") - 1) % 10 as int) as fold from fx_predictions)"""


@register("w14_stratified_folds", with_fx("fx_predictions", f"select {K}, y, fold from folds", _FOLDS))
def w14_stratified_folds(spark, sf_dir):
    p = predictions(_feat(spark, sf_dir)).select(*KEY, "y")
    return R.stratified_folds(p, "y", 10)


# ---- classifier metrics ---------------------------------------------------------
_REPORT = """conf as (select y as t, yhat as p, count(*) as c from fx_predictions group by all),
cls as (select t as cls from conf union select p from conf),
per as (select cls.cls, coalesce((select sum(c) from conf where t = cls.cls and p = cls.cls), 0) as tp,
   coalesce((select sum(c) from conf where t = cls.cls), 0) as support,
   coalesce((select sum(c) from conf where p = cls.cls), 0) as predicted from cls),
pm as (select cls, tp, support, case when predicted > 0 then tp / predicted else 0 end as precision,
   case when support > 0 then tp / support else 0 end as recall from per),
pf as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from pm)"""


@register("a12_classification_report", with_fx("fx_predictions", """
select cast(cls as varchar) as cls, precision, recall, f1, cast(support as bigint) as support from pf
union all select 'macro avg', avg(precision), avg(recall), avg(f1), cast(sum(support) as bigint) from pf
union all select 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support),
  cast(sum(support) as bigint) from pf""", _REPORT))
def a12_classification_report(spark, sf_dir):
    return C.classification_report(predictions(_feat(spark, sf_dir)))


_AUC_LONG = f"""lg as (select cls, round(case cls when 0 then p0 when 1 then p1 else p2 end, 9) as score,
  cast(y = cls as int) as pos from fx_predictions, range(0, 3) t(cls)),
rk as (select *, rank() over (partition by cls order by score) + (count(*) over (partition by cls, score) - 1) / 2.0 as ar
  from lg)"""


@register("a13_ovr_auc", with_fx("fx_predictions", """select cast(cls as varchar) as cls,
  (sum(ar) filter (where pos = 1) - count(*) filter (where pos = 1) * (count(*) filter (where pos = 1) + 1) / 2.0)
  / (count(*) filter (where pos = 1) * count(*) filter (where pos = 0)) as auc from rk group by cls""", _AUC_LONG))
def a13_ovr_auc(spark, sf_dir):
    p = predictions(_feat(spark, sf_dir))
    long = p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), F.round(f"p{c}", 9).alias("score"),
                                                 (F.col("y") == c).alias("pos")) for c in range(3)])).alias("e")) \
        .select("e.*")
    return S.ovr_auc(long, "cls", "score", "pos").select(F.col("cls").cast("string").alias("cls"), "auc")


_KAPPA = """lg as (unpivot fx_raters on label, a, b, c into name rater value v),
pairs as (select x.rater as r1, y.rater as r2, x.v as v1, y.v as v2, count(*) as c
  from lg x join lg y using (item_id) group by all),
tot as (select r1, r2, sum(c) as n, coalesce(sum(c) filter (where v1 = v2), 0) as agree from pairs group by all),
m1 as (select r1, r2, v1 as v, sum(c) as c1 from pairs group by all),
m2 as (select r1, r2, v2 as v, sum(c) as c2 from pairs group by all),
pe as (select r1, r2, sum(c1 * c2) as pe_num from m1 join m2 using (r1, r2, v) group by all)"""


@register("a14_cohens_kappa", with_fx("fx_raters", """select r1, r2,
  case when pe_num / (n * n) < 1 then (agree / n - pe_num / (n * n)) / (1 - pe_num / (n * n)) end as kappa
  from tot left join pe using (r1, r2)""", _KAPPA))
def a14_cohens_kappa(spark, sf_dir):
    return C.cohen_kappa_matrix(raters(Tables(spark, sf_dir).labels), "item_id", ["label", "a", "b", "c"])


@register("a19_cluster_majority", with_fx("fx_predictions", f"""select {K}, yhat as cluster, y, m.mapped_label
  from fx_predictions join (select cluster, arg_max(y, c * 10 - y) as mapped_label from
     (select yhat as cluster, y, count(*) as c from fx_predictions group by all) group by cluster) m on m.cluster = yhat"""))
def a19_cluster_majority(spark, sf_dir):
    p = predictions(_feat(spark, sf_dir)).select(*KEY, F.col("yhat").alias("cluster"), "y")
    return C.cluster_majority(p, "cluster", "y")


_GRID = f"""{_FOLDS}, grid as (select p.param, f.fold, avg(case when (case when (f.sample_id + f."index" + p.param) % 5 = 0
  then (f.y + 1) % 3 else f.y end) = f.y then 1.0 else 0.0 end) as score from folds f, range(0, 3) p(param) group by all)"""


@register("a20_grid_leaderboard", with_fx("fx_predictions", """select param, avg(score) as mean_test_score,
  stddev_pop(score) as std_test_score, count(fold) as n_splits,
  cast(rank() over (order by avg(score) desc) as int) as rank_test_score from grid group by param""", _GRID))
def a20_grid_leaderboard(spark, sf_dir):
    folds = R.stratified_folds(predictions(_feat(spark, sf_dir)).select(*KEY, "y"), "y", 10)
    grid = spark.range(0, 3).select(F.col("id").alias("param"))
    pred = F.when((F.col("sample_id") + F.col("index") + F.col("param")) % 5 == 0,
                  (F.col("y") + 1) % 3).otherwise(F.col("y"))
    scores = (folds.crossJoin(F.broadcast(grid))            # 3 parameter sets
              .groupBy("param", "fold").agg(F.avg(F.when(pred == F.col("y"), 1.0).otherwise(0.0)).alias("score")))
    return C.leaderboard(scores, "param", "fold", "score").select(
        "param", "mean_test_score", "std_test_score", "n_splits", F.col("rank_test_score").cast("int"))


# ---- significance (A15, A16 -> E5) ---------------------------------------------------
def _significance(spark, sf_dir, with_p: bool):
    e1 = _e1(spark, sf_dir)
    long = e1.unpivot([*KEY, "label"], ALL_COLUMNS, "feature", "value")
    t = S.value_table(long, ["feature"], "value", "label", (0, 2))
    out = S.mann_whitney_cliffs(t, ["feature"])
    return S.two_sided_p(out) if with_p else out


_SIG = f"""lg as (select feature, value, label from (unpivot (select label, {', '.join(ALL_COLUMNS)} from e1)
  on {', '.join(ALL_COLUMNS)} into name feature value value) where label in (0, 2)),
vt as (select feature, value, count(*) filter (where label = 0) as n0, count(*) filter (where label = 2) as n1,
  count(*) as cnt from lg group by all),
vp as (select *, coalesce(sum(cnt) over w, 0) as lt, coalesce(sum(n1) over w, 0) as lt1 from vt
  window w as (partition by feature order by value rows between unbounded preceding and 1 preceding)),
ag as (select feature, sum(n0 * (lt + (cnt + 1) / 2.0)) as r0, sum(n0) as n0, sum(n1) as n1,
  sum(cnt * cnt * cnt - cnt) as ties, sum(n0 * lt1) as gt, sum(n0 * (n1 + lt1)) as ge from vp group by feature),
mw as (select feature, r0 - n0 * (n0 + 1) / 2.0 as u1, n0, n1, ties, gt, ge, n0 + n1 as n from ag)"""


@register("e5_significance", with_fx("fx_features", """select feature, u1 as u_stat,
  (greatest(u1, n0 * n1 - u1) - n0 * n1 / 2.0 - 0.5) / sqrt(n0 * n1 / 12.0 * ((n + 1) - ties / (n * (n - 1)))) as z,
  (gt - (n0 * n1 - ge)) / (n0 * n1) as cliffs_delta,
  case when abs((gt - (n0 * n1 - ge)) / (n0 * n1)) < 0.147 then 'negligible'
       when abs((gt - (n0 * n1 - ge)) / (n0 * n1)) < 0.33 then 'small'
       when abs((gt - (n0 * n1 - ge)) / (n0 * n1)) < 0.474 then 'medium' else 'large' end as magnitude
  from mw""", _E1_CTE + ",\n" + _SIG))
def e5_significance(spark, sf_dir):
    return _significance(spark, sf_dir, with_p=False)


_Z = """(greatest(u1, n0 * n1 - u1) - n0 * n1 / 2.0 - 0.5) / sqrt(n0 * n1 / 12.0 * ((n + 1) - ties / (n * (n - 1))))"""


@register("a15_mann_whitney_p", with_fx("fx_features", """select feature, u_stat, z, cliffs_delta, magnitude,
  case when not isnan(z) then least(1.0, greatest(0.0, case when z < 0 then 2 - e else e end)) end as p_value from (
  select *, case when x < 2 then 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda k: pow(-1, k) * pow(x, 2 * k + 1) / (factorial(least(k, 30)::int)
      * list_product(list_transform(range(31, greatest(k, 30) + 1), lambda j: j::double)) * (2 * k + 1))))
    else exp(-x * x) / sqrt(pi()) / (x + list_reduce(list_prepend(0.0::double, list_transform(range(0, 200), lambda i: (200 - i)::double)), lambda t, k: k / 2 / (x + t))) end as e
  from (select *, abs(z) / sqrt(2) as x from (select feature, u1 as u_stat, """ + _Z + """ as z, (gt - (n0 * n1 - ge)) / (n0 * n1) as cliffs_delta,
  case when abs((gt - (n0 * n1 - ge)) / (n0 * n1)) < 0.147 then 'negligible'
       when abs((gt - (n0 * n1 - ge)) / (n0 * n1)) < 0.33 then 'small'
       when abs((gt - (n0 * n1 - ge)) / (n0 * n1)) < 0.474 then 'medium' else 'large' end as magnitude from mw)))""", _E1_CTE + ",\n" + _SIG))
def a15_mann_whitney_p(spark, sf_dir):
    return _significance(spark, sf_dir, with_p=True)


# ---- box summary (P9 -> A17) -------------------------------------------------------
@register("a17_box_summary", with_fx("fx_features", f"""select label, Feature, q[1] as q1, q[2] as median, q[3] as q3,
  min(Value) filter (where Value between q[1] - 1.5 * (q[3] - q[1]) and q[3] + 1.5 * (q[3] - q[1])) as whisker_lo,
  max(Value) filter (where Value between q[1] - 1.5 * (q[3] - q[1]) and q[3] + 1.5 * (q[3] - q[1])) as whisker_hi,
  count(*) filter (where not (Value between q[1] - 1.5 * (q[3] - q[1]) and q[3] + 1.5 * (q[3] - q[1]))) as outliers,
  count(*) as n
  from lg join (select label, Feature, quantile_cont(Value, [0.25, 0.5, 0.75]) as q from lg group by all)
  using (label, Feature) group by label, Feature, q""", _E1_CTE + f""",
lg as (unpivot (select label, {', '.join(CONTENT_COLUMNS)} from e1) on {', '.join(CONTENT_COLUMNS)}
  into name Feature value Value)"""))
def a17_box_summary(spark, sf_dir):
    long = _e1(spark, sf_dir).unpivot(["label"], CONTENT_COLUMNS, "Feature", "Value")
    return S.box_summary(long, ["label", "Feature"], "Value")


# ---- composed: E4 enrichment, E7 validation set ----------------------------------
_E4 = f"""select {K}, struct_pack({', '.join(f'{c} := e1.{c}' for c in ALL_COLUMNS)}) as features,
  e1.label as change_level_label, ct.ChangeType from e1 join ct using (sample_id, "index")"""


@register("e4_enriched_records", with_fx(("fx_features", "fx_changes"), _E4, _E1_CTE + ",\n" + _CT_PER_KEY))
def e4_enriched_records(spark, sf_dir):
    e1 = _e1(spark, sf_dir)
    ct = _change_types_per_key(changes(Tables(spark, sf_dir).events))
    rec = e1.select(*KEY, F.struct(*ALL_COLUMNS).alias("features"), F.col("label").alias("change_level_label"))
    joined, _ = J.inner_with_skips(rec, ct)
    return joined


@register("e4_skipped", with_fx(("fx_features", "fx_changes"), f"""select {K} from e1 anti join ct using (sample_id, "index")""",
                                _E1_CTE + ",\n" + _CT_PER_KEY))
def e4_skipped(spark, sf_dir):
    e1 = _e1(spark, sf_dir).select(*KEY)
    _, skipped = J.inner_with_skips(e1, _change_types_per_key(changes(Tables(spark, sf_dir).events)))
    return skipped


_E7 = f"""samp as (select {K}, label from (select *, row_number() over (partition by label
  order by md5(concat('42|', sample_id, '|', "index")), sample_id, "index") as rn from e1) where rn <= 384),
val as (select s.sample_id, s."index", s.cluster_label, p.yhat as manual_label
  from (select {K}, min(label) as cluster_label from samp group by all) s
  left join fx_predictions p using (sample_id, "index")),
lg as (unpivot val on cluster_label, manual_label into name rater value v),
pairs as (select x.rater as r1, y.rater as r2, x.v as v1, y.v as v2, count(*) as c
  from lg x join lg y using (sample_id, "index") group by all),
tot as (select r1, r2, sum(c) as n, coalesce(sum(c) filter (where v1 = v2), 0) as agree from pairs group by all),
m1 as (select r1, r2, v1 as v, sum(c) as c1 from pairs group by all),
m2 as (select r1, r2, v2 as v, sum(c) as c2 from pairs group by all),
pe as (select r1, r2, sum(c1 * c2) as pe_num from m1 join m2 using (r1, r2, v) group by all)"""


def _validation_set(spark, sf_dir):
    f = _feat(spark, sf_dir)
    e1 = labels_table(spark, sf_dir)
    samp = R.stratified_sample(e1.select(*KEY, "label"), "label", 384)
    parts = [samp.where(F.col("label") == c) for c in (0, 1, 2)]
    val = J.priority_label(e1.select(*KEY), parts)                       # J5
    manual = predictions(f).select(*KEY, F.col("yhat").alias("manual_label"))
    return J.left_merge(val, manual)                                      # J1


@register("e7_validation_kappa", with_fx(("fx_features", "fx_predictions"), """select r1, r2,
  case when pe_num / (n * n) < 1 then (agree / n - pe_num / (n * n)) / (1 - pe_num / (n * n)) end as kappa
  from tot left join pe using (r1, r2)""", _E1_CTE + ",\n" + _E7))
def e7_validation_kappa(spark, sf_dir):
    val = _validation_set(spark, sf_dir).withColumn("item", F.concat_ws("@@", "sample_id", "index"))
    return C.cohen_kappa_matrix(val, "item", ["cluster_label", "manual_label"])


@register("e7_validation_set", with_fx(("fx_features", "fx_predictions"),
                                       "select sample_id, \"index\", cluster_label, manual_label from val",
                                       _E1_CTE + ",\n" + _E7))
def e7_validation_set(spark, sf_dir):
    return _validation_set(spark, sf_dir)


@register("a16_cliffs_delta", with_fx("fx_features", """select feature, (gt - (n0 * n1 - ge)) / (n0 * n1) as cliffs_delta,
  case when abs((gt - (n0 * n1 - ge)) / (n0 * n1)) < 0.147 then 'negligible'
       when abs((gt - (n0 * n1 - ge)) / (n0 * n1)) < 0.33 then 'small'
       when abs((gt - (n0 * n1 - ge)) / (n0 * n1)) < 0.474 then 'medium' else 'large' end as magnitude
  from mw""", _E1_CTE + ",\n" + _SIG))
def a16_cliffs_delta(spark, sf_dir):
    """Cliff's delta of label 0 vs label 2 per feature, from the T1 table (no pairs)."""
    return _significance(spark, sf_dir, with_p=False).select("feature", "cliffs_delta", "magnitude")


@register("j10_rater_pairs", with_fx("fx_raters", "select r1, r2, v1, v2, c from pairs", _KAPPA))
def j10_rater_pairs(spark, sf_dir):
    """Every ordered rater pair per item (self join on the item id after unpivot),
    counted per (rater pair, value pair)."""
    wide = raters(Tables(spark, sf_dir).labels)
    long = wide.unpivot(["item_id"], ["label", "a", "b", "c"], "rater", "v")
    a = long.select("item_id", F.col("rater").alias("r1"), F.col("v").alias("v1"))
    b = long.select("item_id", F.col("rater").alias("r2"), F.col("v").alias("v2"))
    return a.join(b, "item_id").groupBy("r1", "r2", "v1", "v2").agg(F.count(F.lit(1)).alias("c"))


@register("p12_nested_record", with_fx(("fx_features", "fx_changes"), _E4, _E1_CTE + ",\n" + _CT_PER_KEY))
def p12_nested_record(spark, sf_dir):
    """Features nested as a struct, the change-level label and the change types
    attached to each sample record."""
    return e4_enriched_records(spark, sf_dir)
