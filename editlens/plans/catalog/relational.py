"""Projections, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...fixtures import KEY, Tables, changes, features, predictions, samples
from ...functions import ngrams as N
from ...functions import tokens as T
from ...operators import joins as J
from ...operators.ranking import sample_shortfall, stratified_sample
from ...operators.scaling import CONTENT_COLUMNS, SIZE_COLUMNS, STRUCTURE_COLUMNS, feature_group
from ...oracle import with_fx
from ...registry import register

K = 'sample_id, "index"'


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


def _feat(spark, sf_dir):
    return features(_t(spark, sf_dir).lineitem)


def _pred(spark, sf_dir):
    return predictions(_feat(spark, sf_dir))


def _samples(spark, sf_dir):
    return samples(_t(spark, sf_dir).conversations)


def _changes(spark, sf_dir):
    return changes(_t(spark, sf_dir).events)


# ---- projections ------------------------------------------------------------
@register("p1_feature_group", with_fx("fx_features", f"select {K}, {', '.join(SIZE_COLUMNS)} from fx_features"))
def p1_feature_group(spark, sf_dir):
    return feature_group(_feat(spark, sf_dir), "size")


@register("p2_drop_columns", with_fx("fx_features",
                                     f"select {K}, {', '.join(SIZE_COLUMNS + STRUCTURE_COLUMNS)} from fx_features"))
def p2_drop_columns(spark, sf_dir):
    return _feat(spark, sf_dir).drop(*CONTENT_COLUMNS)


@register("p3_rename_narrow", with_fx("fx_predictions",
                                      f"select {K}, yhat as size_label, p2 as size_score from fx_predictions"))
def p3_rename_narrow(spark, sf_dir):
    return (_pred(spark, sf_dir).select(*KEY, "yhat", "p2")
            .withColumnsRenamed({"yhat": "size_label", "p2": "size_score"}))


@register("p4_cast_int", with_fx("fx_features", f"""select {K}, cast(codeChangeNum as int) as codeChangeNum,
  cast(refactoringTypeNum as int) as refactoringTypeNum from fx_features"""))
def p4_cast_int(spark, sf_dir):
    return _feat(spark, sf_dir).select(*KEY, *[F.col(c).cast("int").alias(c)
                                             for c in ("codeChangeNum", "refactoringTypeNum")])


@register("p5_level_rollup", with_fx("fx_samples", """select cast(coalesce(level, -1) as int) as level,
  count(*) as n, avg(len(ref_toks)) as avg_len from fx_samples group by grouping sets ((level), ())"""))
def p5_level_rollup(spark, sf_dir):
    s = _samples(spark, sf_dir)
    r = s.rollup("level").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("ref_toks")).alias("avg_len"),
                              F.grouping("level").alias("g"))
    return r.select(F.when(F.col("g") == 1, -1).otherwise(F.col("level")).cast("int").alias("level"), "n", "avg_len")


@register("p6_filter_label", with_fx("fx_predictions", f"select {K}, y, yhat from fx_predictions where y = 0"))
def p6_filter_label(spark, sf_dir):
    return _pred(spark, sf_dir).where(F.col("y") == 0).select(*KEY, "y", "yhat")


@register("p7_composite_key", with_fx("fx_samples", """select concat_ws('@@', sample_id, "index") as key,
  case when "index" <> 0 then concat_ws('_', sample_id, "index") else cast(sample_id as varchar) end as name
  from fx_samples"""))
def p7_composite_key(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return s.select(T.composite_key("sample_id", "index").alias("key"), T.file_stem("sample_id", "index").alias("name"))


_RAW_OUT = ("case when sample_id % 5 = 0 then null when sample_id % 5 = 1 then '  ' "
            "else concat('old: x new comment: ', array_join(hyp_toks, ' '), ' ') end")


@register("p8_output_fallback", with_fx("fx_samples", f"""select {K},
  coalesce(nullif(trim(string_split(raw, 'new comment:')[-1]), ''), array_to_string(src_toks, ' ')) as new_comment
  from (select *, {_RAW_OUT.replace('array_join', 'array_to_string')} as raw from fx_samples)"""))
def p8_output_fallback(spark, sf_dir):
    s = _samples(spark, sf_dir).withColumn("raw", F.expr(_RAW_OUT))
    return s.select(*KEY, T.output_fallback("raw", F.array_join("src_toks", " ")).alias("new_comment"))


@register("p9_melt", with_fx("fx_features", f"""select {K}, Feature, Value from
  (unpivot (select {K}, {', '.join(CONTENT_COLUMNS)} from fx_features) on {', '.join(CONTENT_COLUMNS)}
   into name Feature value Value)"""))
def p9_melt(spark, sf_dir):
    return _feat(spark, sf_dir).unpivot(KEY, CONTENT_COLUMNS, "Feature", "Value")


@register("p10_transpose", with_fx("fx_features", f"""select Feature, avg(Value) as mean, min(Value) as min,
  max(Value) as max from (unpivot (select {', '.join(CONTENT_COLUMNS)} from fx_features) on {', '.join(CONTENT_COLUMNS)}
  into name Feature value Value) group by Feature"""))
def p10_transpose(spark, sf_dir):
    long = _feat(spark, sf_dir).unpivot(KEY, CONTENT_COLUMNS, "Feature", "Value")
    stats = long.groupBy("Feature").agg(F.avg("Value").alias("mean"), F.min("Value").alias("min"),
                                        F.max("Value").alias("max"))
    # dict-of-metrics -> long (feature, stat, value) rows -> one row per feature
    tall = stats.unpivot(["Feature"], ["mean", "min", "max"], "stat", "value")
    return tall.groupBy("Feature").pivot("stat", ["mean", "min", "max"]).agg(F.first("value"))


# ---- joins ------------------------------------------------------------------
@register("j1_left_merge", with_fx("fx_predictions", f"""select f.sample_id, f."index", f.NMT, p.yhat
  from fx_features f left join (select * from fx_predictions where yhat <> y) p using (sample_id, "index")"""))
def j1_left_merge(spark, sf_dir):
    f = _feat(spark, sf_dir)
    p = predictions(f).where(F.col("yhat") != F.col("y")).select(*KEY, "yhat")
    return J.left_merge(f.select(*KEY, "NMT"), p)


_CT_PER_KEY = """ct as (select sample_id, "index", coalesce(list_sort(list_distinct(list(change_type || ':' ||
  trim(split_part(content, ':', 1))) filter (where significance <> 'NONE'))), []::varchar[]) as ChangeType
  from fx_changes group by all)"""


def _change_types_per_key(ch):
    """C16 in long form: one distinct ``type:prefix`` set per key (collect_set combines
    map-side and holds distinct values only, so a key repeated many times stays small)."""
    ct = F.concat("change_type", F.lit(":"), F.trim(F.substring_index("content", ":", 1)))
    return (ch.groupBy(*KEY)
            .agg(F.array_sort(F.collect_set(F.when(F.col("significance") != "NONE", ct))).alias("ChangeType")))


@register("j2_enrich_inner", with_fx(("fx_features", "fx_changes"), f"""select {K}, f.NMT, len(ct.ChangeType) as n_types
  from fx_features f join ct using (sample_id, "index")""", _CT_PER_KEY))
def j2_enrich_inner(spark, sf_dir):
    joined, _ = J.inner_with_skips(_feat(spark, sf_dir).select(*KEY, "NMT"), _change_types_per_key(_changes(spark, sf_dir)))
    return joined.select(*KEY, "NMT", F.size("ChangeType").cast("long").alias("n_types"))


@register("j2_skipped_keys", with_fx(("fx_features", "fx_changes"), f"""select {K} from fx_features f
  where not exists (select 1 from fx_changes c where c.sample_id = f.sample_id and c."index" = f."index")"""))
def j2_skipped_keys(spark, sf_dir):
    _, skipped = J.inner_with_skips(_feat(spark, sf_dir).select(*KEY), _changes(spark, sf_dir).select(*KEY))
    return skipped


_REF_LAST = f"""refs as (select {K}, arg_max(event_id, event_id) as event_id, arg_max(change_type, event_id) as change_type
  from fx_changes group by all)"""


@register("j3_strict_lookup", with_fx("fx_changes", f"""select p.sample_id, p."index", p.pred_event,
  r.event_id as ref_event, r.change_type from (select {K}, event_id as pred_event from fx_changes where event_id % 3 = 0) p
  join refs r using (sample_id, "index")""", _REF_LAST))
def j3_strict_lookup(spark, sf_dir):
    ch = _changes(spark, sf_dir)
    preds = ch.where(F.col("event_id") % 3 == 0).select(*KEY, F.col("event_id").alias("pred_event"))
    refs = ch.select(*KEY, "event_id", "change_type")
    return J.strict_lookup(preds, refs, "event_id").select(*KEY, "pred_event", F.col("event_id").alias("ref_event"), "change_type")


@register("j4_first_match", with_fx("fx_changes", f"""select p.sample_id, p."index", p.pred_event,
  r.event_id as ref_event, r.change_type from (select {K}, event_id as pred_event from fx_changes where event_id % 3 = 0) p
  join (select {K}, arg_min(event_id, event_id) as event_id, arg_min(change_type, event_id) as change_type
        from fx_changes group by all) r using (sample_id, "index")"""))
def j4_first_match(spark, sf_dir):
    ch = _changes(spark, sf_dir)
    preds = ch.where(F.col("event_id") % 3 == 0).select(*KEY, F.col("event_id").alias("pred_event"))
    j = J.first_match(preds, ch.select(*KEY, "event_id", "change_type"), "event_id")
    return j.select(*KEY, "pred_event", F.col("event_id").alias("ref_event"), "change_type")


_A2 = f"""samp as (select {K}, y from (select *, row_number() over (partition by y
  order by md5(concat('42|', sample_id, '|', "index")), sample_id, "index") as rn from fx_predictions) where rn <= 384)"""


@register("a2_stratified_sample", with_fx("fx_predictions", f"select {K}, y from samp", _A2))
def a2_stratified_sample(spark, sf_dir):
    return stratified_sample(_pred(spark, sf_dir).select(*KEY, "y"), "y", 384)


@register("a2_sample_shortfall", with_fx("fx_predictions", """select y, count(*) as rows from fx_predictions
  group by y having count(*) < 384"""))
def a2_sample_shortfall(spark, sf_dir):
    return sample_shortfall(_pred(spark, sf_dir), "y", 384)


@register("j5_priority_label", with_fx("fx_predictions", f"""select f.sample_id, f."index", f.NMT, s.cluster_label
  from fx_features f join (select {K}, min(y) as cluster_label from samp group by all) s using (sample_id, "index")""",
                                       _A2))
def j5_priority_label(spark, sf_dir):
    f = _feat(spark, sf_dir)
    samp = stratified_sample(predictions(f).select(*KEY, "y"), "y", 384)
    parts = [samp.where(F.col("y") == c) for c in (0, 1, 2)]
    return J.priority_label(f.select(*KEY, "NMT"), parts)


@register("j6_anti_resume", with_fx("fx_samples", f"""select {K}, role from fx_samples s where not exists
  (select 1 from fx_samples d where d.sample_id < 50 and d.sample_id = s.sample_id and d."index" = s."index")"""))
def j6_anti_resume(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return J.anti_resume(s.select(*KEY, "role"), s.where(F.col("sample_id") < 50))


@register("j7_semi_flag", with_fx("fx_predictions", f"""select {K}, case when yhat <> y then 2 else y end as label
  from fx_predictions"""))
def j7_semi_flag(spark, sf_dir):
    p = _pred(spark, sf_dir)
    ids = p.where(F.col("yhat") != F.col("y"))
    return J.semi_flag(p.select(*KEY, "y"), ids, 2, "y", "label").select(*KEY, "label")


@register("j11_token_intersect", with_fx("fx_samples", f"""select {K},
  list_sort(list_distinct(list_filter(ref_toks, lambda x: list_contains(hyp_toks, x)))) as common from fx_samples"""))
def j11_token_intersect(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return s.select(*KEY, F.array_sort(F.array_intersect("ref_toks", "hyp_toks")).alias("common"))


# ---- sort / set ---------------------------------------------------------------
@register("o1_topk_sorted", with_fx("fx_features", f"""select {K}, NMS from fx_features
  order by NMS desc, sample_id, "index" limit 25"""))
def o1_topk_sorted(spark, sf_dir):
    """Top-k report: the limit is the feature (TakeOrderedAndProject, partial top-k per task)."""
    return (_feat(spark, sf_dir).select(*KEY, "NMS")
            .orderBy(F.col("NMS").desc(), "sample_id", "index").limit(25))


@register("o2_sorted_distinct", with_fx("fx_changes", "select distinct change_type from fx_changes order by 1"))
def o2_sorted_distinct(spark, sf_dir):
    return _changes(spark, sf_dir).select("change_type").distinct().orderBy("change_type")


@register("o3_key_intersection", with_fx("fx_features", f"""select {K} from fx_features where NMT >= 2
  intersect select {K} from fx_features where CC_delta >= 5
  intersect select {K} from fx_features where codeChangeNum >= 6"""))
def o3_key_intersection(spark, sf_dir):
    f = _feat(spark, sf_dir)
    return J.key_intersection(f.where(F.col("NMT") >= 2), f.where(F.col("CC_delta") >= 5),
                              f.where(F.col("codeChangeNum") >= 6))


@register("o4_change_type_union", with_fx("fx_changes", "select distinct unnest(ChangeType) as change from ct",
                                          _CT_PER_KEY))
def o4_change_type_union(spark, sf_dir):
    ct = _change_types_per_key(_changes(spark, sf_dir))
    return ct.select(F.explode("ChangeType").alias("change")).distinct()


@register("o5_set_ops", with_fx("fx_samples", f"""select {K},
  list_sort(list_distinct(list_filter(ref_toks, lambda x: not list_contains(hyp_toks, x)))) as removed,
  list_sort(list_distinct(list_filter(ref_toks, lambda x: list_contains(hyp_toks, x)))) as kept,
  list_sort(list_distinct(list_concat(ref_toks, hyp_toks))) as all_tokens from fx_samples"""))
def o5_set_ops(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return s.select(*KEY, F.array_sort(F.array_except("ref_toks", "hyp_toks")).alias("removed"),
                    F.array_sort(F.array_intersect("ref_toks", "hyp_toks")).alias("kept"),
                    F.array_sort(F.array_union("ref_toks", "hyp_toks")).alias("all_tokens"))


@register("o6_bag_union", with_fx("fx_features", f"""select {K}, NMT, 'train' as part from fx_features
  where sample_id % 10 < 8 union all select {K}, NMT, 'valid' as part from fx_features where sample_id % 10 >= 8"""))
def o6_bag_union(spark, sf_dir):
    f = _feat(spark, sf_dir).select(*KEY, "NMT")
    return (f.where(F.col("sample_id") % 10 < 8).withColumn("part", F.lit("train"))
            .unionByName(f.where(F.col("sample_id") % 10 >= 8).withColumn("part", F.lit("valid"))))


@register("o7_bag_min_intersection", with_fx("fx_samples", f"""select {K},
  cast(coalesce(sum(least(nr, nh)) filter (where nh > 0), 0) as bigint) as inter,
  cast(coalesce(sum(nr - nh) filter (where nr > nh), 0) as bigint) as diff
  from (select {K}, t, count(*) filter (where side = 'r') as nr, count(*) filter (where side = 'h') as nh from (
    select {K}, 'r' as side, unnest(ref_toks) as t from fx_samples union all
    select {K}, 'h' as side, unnest(hyp_toks) as t from fx_samples) group by all) group by all"""))
def o7_bag_min_intersection(spark, sf_dir):
    s = _samples(spark, sf_dir).selectExpr(*[f"`{k}`" for k in KEY], f"{N.count_map('ref_toks')} as mr",
                                           f"{N.count_map('hyp_toks')} as mh")
    return s.selectExpr(
        *[f"`{k}`" for k in KEY],
        f"{N.clipped_matches('mr', 'mh')} as inter",
        "aggregate(map_keys(mr), 0L, (a, g) -> a + greatest(mr[g] - coalesce(try_element_at(mh, g), 0), 0)) as diff")


@register("o8_multi_ref_union", with_fx("fx_samples", f"""select {K}, gram, max(c) as max_count, cast(sum(c) as bigint) as sum_count
  from (select {K}, gram, ref_id, count(*) as c from (
    select {K}, 0 as ref_id, unnest(ref_toks) as gram from fx_samples union all
    select {K}, 1 as ref_id, unnest(hyp_toks) as gram from fx_samples) group by all) group by all"""))
def o8_multi_ref_union(spark, sf_dir):
    s = _samples(spark, sf_dir)
    long = (s.select(*KEY, F.lit(0).alias("ref_id"), F.explode("ref_toks").alias("gram"))
            .unionByName(s.select(*KEY, F.lit(1).alias("ref_id"), F.explode("hyp_toks").alias("gram"))))
    return J.multi_ref_ngram_counts(long, KEY, "gram", "ref_id")


@register("a1_change_type_stats", with_fx("fx_changes", """select count(distinct change_type) as n_types,
  (select max(n) from (select count(*) as n from fx_changes group by sample_id, "index")) as max_per_key
  from fx_changes"""))
def a1_change_type_stats(spark, sf_dir):
    ch = _changes(spark, sf_dir)
    per_key = ch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))          # partial aggregate
    return (ch.agg(F.count_distinct("change_type").alias("n_types"))
            .crossJoin(per_key.agg(F.max("n").cast("long").alias("max_per_key"))))


@register("a8_ngram_doc_freq", with_fx("fx_samples", """select n, gram, count(*) as freq, count(*) / 1.0 as normalized
  from (select distinct sample_id, "index", n, gram from (select sample_id, "index", n,
        unnest(list_transform(range(1, len(ref_toks) - n + 2), lambda i: array_to_string(ref_toks[i:i + n - 1], ' '))) as gram
        from fx_samples, range(1, 5) t(n))) group by all"""))
def a8_ngram_doc_freq(spark, sf_dir):
    s = _samples(spark, sf_dir)
    long = None
    for n in range(1, 5):
        x = s.select(*KEY, F.lit(n).cast("long").alias("n"), F.explode(F.array_distinct(F.expr(N.ngrams("ref_toks", n)))).alias("gram"))
        long = x if long is None else long.unionByName(x)
    # each sentence has one reference here, so normalisation divides by 1
    return long.groupBy("n", "gram").agg(F.count(F.lit(1)).alias("freq")) \
        .withColumn("normalized", F.col("freq") / F.lit(1.0))


@register("c16_change_types", with_fx("fx_changes", "select sample_id, \"index\", ChangeType from ct", _CT_PER_KEY))
def c16_change_types(spark, sf_dir):
    """C16 per key: distinct ``type:prefix`` of the non-NONE change triples."""
    return _change_types_per_key(_changes(spark, sf_dir))
