"""Retrieval jobs over fx_vectors (C15, C17, C18, C22, C24, J8, J9, W5-W8, W13, S11) -> E2.

Corpus = vectors that are not queries; query = ``vec_id % 25 = 0``; level = label % 3.
W7 text of a candidate: ``'m' || sample_id % 40``; change types: the C16 set of
``fx_changes`` user ``vec_id % 150``; diff texts: method texts of the vector's key in
``fx_edit_seq`` (empty when absent).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...fixtures import Tables, changes, edit_seq, samples, vectors
from ...functions import ngrams as N
from ...operators import editseq as X
from ...operators import pivots as P
from ...operators import retrieval as RT
from ...operators.ranking import materialize
from ...oracle import with_fx
from ...registry import register
from ...sources import io
from ..retrieval import rank_candidates, rank_join, rerank
from .features import _TEXTS

VKEY = ["sample_id", "index"]


def _norm_sql(v: str) -> str:
    n = f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
    return f"case when {n} > 0 then list_transform({v}, lambda x: x / {n}) else {v} end"


_BASE = f"""nv as (select vec_id, sample_id, "index", level, is_query, {_norm_sql('old_vec')} as ov,
  {_norm_sql('new_vec')} as nw from fx_vectors),
q as (select vec_id as qid, level, ov, nw, case level when 0 then 11 when 1 then 7 else 3 end as K,
  sample_id as q_sid, "index" as q_idx from nv where is_query),
c as (select vec_id as cand_id, level, ov, nw, sample_id, "index", 'm' || (sample_id % 40) as text from nv where not is_query),
sc as (select q.qid, q.K, c.cand_id, c.sample_id, c."index", c.text, round(list_inner_product(q.ov, c.ov), 9) as s_old,
  round(list_inner_product(q.nw, c.nw), 9) as s_new from q join c using (level)),
rk as (select *, row_number() over (partition by qid order by s_old desc, cand_id) as r_old,
  row_number() over (partition by qid order by s_new desc, cand_id) as r_new, count(*) over (partition by qid) as lvl_n from sc),
pr as (select *, 0.5 * s_old + 0.5 * s_new as score, cast(ceil(greatest(r_old, r_new) / 20.0) as int) as entry from rk),
rd as (select distinct qid, K, unnest(range(1, cast(ceil(lvl_n / 20.0) as bigint) + 1)) as round from pr),
w6 as (select * from (select pr.*, rd.round, row_number() over (partition by pr.qid, rd.round, sample_id
  order by score desc, cand_id) as rn6 from pr join rd using (qid) where entry <= rd.round) where rn6 = 1),
w7 as (select * from (select *, row_number() over (partition by qid, round, text order by score desc, cand_id) as rn7
  from w6) where rn7 = 1),
cnt as (select qid, round, K, count(*) as n from w7 group by all),
ch as (select qid, coalesce(min(round) filter (where n >= K), max(round)) as round from cnt group by qid),
surv as (select w7.* from w7 join ch using (qid, round))"""

_TYPES = """ut as (select sample_id as usr, coalesce(list_sort(list_distinct(list(change_type || ':' ||
  trim(split_part(content, ':', 1))) filter (where significance <> 'NONE'))), []::varchar[]) as types
  from fx_changes group by all)"""

_TOKS = f"""{_TEXTS},
tk as (select sample_id, "index", t, count(*) filter (where side = 's') as ns, count(*) filter (where side = 'd') as nd from (
  select sample_id, "index", 's' as side, unnest(list_filter(regexp_split_to_array(src_method, '\\s+'), lambda x: x <> '')) as t from tx
  union all select sample_id, "index", 'd' as side, unnest(list_filter(regexp_split_to_array(dst_method, '\\s+'), lambda x: x <> '')) as t from tx)
  group by all),
am as (select sample_id, "index", t, greatest(nd - ns, 0) as a, greatest(ns - nd, 0) as r from tk)"""


def _dice_sql(col: str) -> str:
    return f"""(select case when coalesce(sum({col}), 0) = 0 then 1.0 else 2.0 * coalesce(sum(m), 0) / sum({col}) end from (
    select {col}, 0 as m from am where sample_id = top.q_sid and "index" = top.q_idx
    union all select {col}, 0 from am where sample_id = top.sample_id and "index" = top."index"
    union all select 0, least(x.{col}, y.{col}) from am x join am y using (t)
      where x.sample_id = top.q_sid and x."index" = top.q_idx and y.sample_id = top.sample_id and y."index" = top."index"))"""


_E2 = with_fx(("fx_vectors", "fx_changes", "fx_edit_seq"), f"""select qid, cast(pos as int) as pos, cand_id,
  sample_id, "index", score, diff_sim, type_sim, fused_score from (
  select *, row_number() over (partition by qid order by fused_score desc, spos) as pos from (
    select top.*, {_dice_sql('a')} + {_dice_sql('r')} as diff_sim,
      case when len(list_distinct(list_concat(coalesce(qt.types, []::varchar[]), coalesce(ct.types, []::varchar[])))) > 0
           then len(list_intersect(coalesce(qt.types, []::varchar[]), coalesce(ct.types, []::varchar[]))) / len(list_distinct(list_concat(coalesce(qt.types, []::varchar[]), coalesce(ct.types, []::varchar[])))) else 0 end as type_sim,
      {_dice_sql('a')} + {_dice_sql('r')} + case when len(list_distinct(list_concat(coalesce(qt.types, []::varchar[]), coalesce(ct.types, []::varchar[])))) > 0
           then len(list_intersect(coalesce(qt.types, []::varchar[]), coalesce(ct.types, []::varchar[]))) / len(list_distinct(list_concat(coalesce(qt.types, []::varchar[]), coalesce(ct.types, []::varchar[])))) else 0 end as fused_score
    from (select s.*, q.q_sid, q.q_idx, row_number() over (partition by s.qid order by s.score desc, s.cand_id) as spos
          from surv s join q using (qid) qualify spos <= s.K) top
    left join (select usr, types from ut) qt on qt.usr = top.qid % 150
    left join (select usr, types from ut) ct on ct.usr = top.cand_id % 150)) where pos <= K""",
              ",\n".join([_BASE, _TYPES, _TOKS]))


def _inputs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    # read by every step of an index and a search
    v = materialize(vectors(t.embeddings).select("vec_id", "sample_id", "index", "level", "is_query",
                                                 RT.l2_normalize("old_vec").alias("old_vec"),
                                                 RT.l2_normalize("new_vec").alias("new_vec")))
    corpus = v.where(~F.col("is_query")).select(F.col("vec_id").alias("cand_id"), "level", "old_vec", "new_vec")
    queries = v.where(F.col("is_query")).select(F.col("vec_id").alias("qid"), "level", "old_vec", "new_vec",
                                                RT.k_by_level("level").alias("K"))
    payload = v.where(~F.col("is_query")).select(F.col("vec_id").alias("cand_id"), "sample_id",
                                                 F.concat(F.lit("m"), (F.col("sample_id") % 40).cast("string"))
                                                 .alias("text"))
    return t, v, corpus, queries, payload


def _user_types(t):
    ch = changes(t.events)
    ct = F.concat("change_type", F.lit(":"), F.trim(F.substring_index("content", ":", 1)))
    return ch.groupBy(F.col("sample_id").alias("usr")).agg(
        F.array_sort(F.collect_set(F.when(F.col("significance") != "NONE", ct))).alias("types"))


def _token_maps(t):
    tx = X.method_texts(edit_seq(samples(t.conversations)))
    toks = lambda c: f"filter(split({c}, '\\\\s+'), x -> x != '')"       # noqa: E731
    m = tx.selectExpr("sample_id", "`index`", f"{N.count_map(toks('src_method'))} as ms",
                      f"{N.count_map(toks('dst_method'))} as md")
    diff = lambda a, b: (f"map_filter(map_from_entries(transform(map_keys({a}), g -> struct(g, {a}[g] - "  # noqa
                         f"coalesce(try_element_at({b}, g), 0)))), (k, v) -> v > 0)")
    return m.selectExpr("sample_id", "`index`", f"{diff('md', 'ms')} as am", f"{diff('ms', 'md')} as rm")


def _dice(a: str, b: str) -> F.Column:
    tot = lambda m: f"aggregate(map_values(coalesce({m}, map())), 0L, (s, x) -> s + x)"
    inter = (f"aggregate(map_keys(coalesce({a}, map())), 0L, (s, g) -> s + least({a}[g], "
             f"coalesce(try_element_at(coalesce({b}, cast(map() as map<string,int>)), g), 0)))")
    return F.expr(f"if({tot(a)} + {tot(b)} = 0, 1.0D, 2.0D * {inter} / ({tot(a)} + {tot(b)}))")


def _retrieval(spark, sf_dir):
    t, v, corpus, queries, payload = _inputs(spark, sf_dir)
    surv = rank_candidates(corpus, queries, payload)
    types = _user_types(t)
    keys = v.select(F.col("vec_id").alias("cand_id"), "sample_id", "index")
    tm = _token_maps(t)
    feats = (keys.join(tm, ["sample_id", "index"], "left")
             .join(types, F.col("cand_id") % 150 == F.col("usr"), "left").drop("usr", "sample_id", "index"))
    qf = (v.where(F.col("is_query")).select(F.col("vec_id").alias("qid"), "sample_id", "index")
          .join(tm.withColumnsRenamed({"am": "q_am", "rm": "q_rm"}), ["sample_id", "index"], "left")
          .join(types.withColumnRenamed("types", "q_types"), F.col("qid") % 150 == F.col("usr"), "left")
          .drop("usr", "sample_id", "index"))
    diff_sim = _dice("q_am", "am") + _dice("q_rm", "rm")
    qf = qf.join(queries.select("qid", "K"), "qid")
    type_sim = RT.jaccard(F.coalesce("q_types", F.array().cast("array<string>")),
                          F.coalesce("types", F.array().cast("array<string>")))
    out = rerank(surv, qf, diff_sim, type_sim, feats)
    return out.join(keys.select("cand_id", F.col("index")), "cand_id").select(
        "qid", F.col("pos").cast("int"), "cand_id", "sample_id", "index", "score", "diff_sim", "type_sim",
        "fused_score")


@register("e2_retrieval", _E2)
def e2_retrieval(spark, sf_dir):
    return _retrieval(spark, sf_dir)


@register("j9_block_topk", with_fx("fx_vectors", """select qid, cand_id, side, score, cast(rank as int) as rank from (
  select qid, cand_id, 'old' as side, s_old as score, r_old as rank from rk union all
  select qid, cand_id, 'new', s_new, r_new from rk) where rank <= 20""", _BASE))
def j9_block_topk(spark, sf_dir):
    """J9 by the stored pivot index (S11): only chunks that can still win are read."""
    _, _, corpus, queries, _ = _inputs(spark, sf_dir)
    hits, _ = P.search(P.build_index(corpus, io.scratch_path(spark, "j9_index")), queries, 20)
    return hits.select("qid", "cand_id", "side", "score", F.col("rank").cast("int"))


@register("j9_chunks_read")
def j9_chunks_read(spark, sf_dir):
    """Chunks of the pivot index and those that the top 20 of all queries needed, by level and side."""
    _, _, corpus, queries, _ = _inputs(spark, sf_dir)
    index = P.build_index(corpus, io.scratch_path(spark, "j9_index"))
    _, chosen = P.search(index, queries, 20)
    return P.reading_report(index, queries, chosen)


@register("s11_pivot_index", with_fx("fx_vectors", """select cast(level as int) as level, side, cand_id, old_vec, new_vec, true as within
  from (select level, vec_id as cand_id, ov as old_vec, nw as new_vec, unnest(['old', 'new']) as side from nv where not is_query)""", _BASE))
def s11_pivot_index(spark, sf_dir):
    """The dual index written and loaded; every row once a side, within the extent stored for its chunk."""
    _, _, corpus, _, _ = _inputs(spark, sf_dir)
    path = io.scratch_path(spark, "s11_pivots")
    P.build_index(corpus, path)
    index = P.PivotIndex(spark, path, "level")
    within = (F.col("dist") >= F.col("rmin")) & (F.col("dist") <= F.col("rmax"))
    return (index.rows().join(index.chunks(), ["level", *P.CHUNK])
            .select(F.col("level").cast("int"), "side", "cand_id", "old_vec", "new_vec", within.alias("within")))


@register("w8_rank_join", with_fx("fx_vectors", """select qid, cand_id, sample_id, text, score from (
  select *, row_number() over (partition by qid order by score desc, cand_id) as pos from w7f) where pos <= K""",
                                  _BASE + """,
w6f as (select * from (select *, row_number() over (partition by qid, sample_id order by score desc, cand_id)
  as rn from pr) where rn = 1),
w7f as (select * from (select *, row_number() over (partition by qid, text order by score desc, cand_id) as rn2
  from w6f) where rn2 = 1)"""))
def w8_rank_join(spark, sf_dir):
    """W8's end: the K best survivors of the whole level, found by the threshold algorithm."""
    _, _, corpus, queries, payload = _inputs(spark, sf_dir)
    return rank_join(corpus, queries, payload)


@register("j8_rank_intersection", with_fx("fx_vectors", """select qid, cand_id, score, entry from pr
  where r_old <= 20 and r_new <= 20""", _BASE))
def j8_rank_intersection(spark, sf_dir):
    _, _, corpus, queries, _ = _inputs(spark, sf_dir)
    return RT.intersect_ranks(RT.block_topk(corpus, queries, 20, "level"))


@register("w8_widening_survivors", with_fx("fx_vectors", "select qid, cand_id, sample_id, text, score from surv", _BASE))
def w8_widening_survivors(spark, sf_dir):
    _, _, corpus, queries, payload = _inputs(spark, sf_dir)
    return rank_candidates(corpus, queries, payload)


@register("c17_cosine", with_fx("fx_vectors", """select vec_id, round(list_inner_product(old_vec, new_vec)
  / (sqrt(list_sum(list_transform(old_vec, lambda x: x * x))) * sqrt(list_sum(list_transform(new_vec, lambda x: x * x)))), 5)
  as sim from fx_vectors"""))
def c17_cosine(spark, sf_dir):
    v = vectors(Tables(spark, sf_dir).embeddings)
    return v.select("vec_id", RT.cosine("old_vec", "new_vec").alias("sim"))


@register("c18_l2_normalize", with_fx("fx_vectors", f"select vec_id, {_norm_sql('old_vec')} as old_vec from fx_vectors"))
def c18_l2_normalize(spark, sf_dir):
    v = vectors(Tables(spark, sf_dir).embeddings)
    return v.select("vec_id", RT.l2_normalize("old_vec").alias("old_vec"))


@register("c24_k_by_level", with_fx("fx_vectors", """select vec_id, level,
  case level when 0 then 11 when 1 then 7 else 3 end as K from fx_vectors where is_query"""))
def c24_k_by_level(spark, sf_dir):
    v = vectors(Tables(spark, sf_dir).embeddings).where(F.col("is_query"))
    return v.select("vec_id", "level", RT.k_by_level("level").alias("K"))


@register("c15_change_type_jaccard", with_fx("fx_changes", """select a.usr, case when
  len(list_distinct(list_concat(a.types, b.types))) > 0 then len(list_intersect(a.types, b.types))
  / len(list_distinct(list_concat(a.types, b.types))) else 0 end as jaccard
  from ut a join ut b on b.usr = a.usr + 1""", _TYPES))
def c15_change_type_jaccard(spark, sf_dir):
    ut = _user_types(Tables(spark, sf_dir))
    nxt = ut.select((F.col("usr") - 1).alias("usr"), F.col("types").alias("t2"))
    return ut.join(nxt, "usr").select("usr", RT.jaccard("types", "t2").alias("jaccard"))


# ---- single operators of the retrieval stage ------------------------------------------
@register("w5_topk_per_query", with_fx("fx_vectors", """select qid, cand_id, s_old as score, cast(r_old as int) as rank
  from rk where r_old <= 10""", _BASE))
def w5_topk_per_query(spark, sf_dir):
    """W5 / O1 per query: the 10 best candidates by the old-code vector."""
    _, _, corpus, queries, _ = _inputs(spark, sf_dir)
    hits = RT.block_topk(corpus, queries, 10, "level")
    return hits.where(F.col("side") == "old").select("qid", "cand_id", "score", F.col("rank").cast("int"))


_FULL_ROUND = """w6f as (select * from (select *, row_number() over (partition by qid, sample_id order by score desc, cand_id)
  as rn from pr) where rn = 1),
w7f as (select * from (select *, row_number() over (partition by qid, text order by score desc, cand_id) as rn2
  from w6f) where rn2 = 1)"""


def _all_pairs(spark, sf_dir):
    _, _, corpus, queries, payload = _inputs(spark, sf_dir)
    # the final widening round: every candidate of the level
    k = corpus.count()
    return RT.intersect_ranks(RT.block_topk(corpus, queries, k, "level")).join(payload, "cand_id")


@register("w6_best_per_sample", with_fx("fx_vectors", "select qid, sample_id, cand_id, score from w6f",
                                        _BASE + ",\n" + _FULL_ROUND))
def w6_best_per_sample(spark, sf_dir):
    """Best candidate per (query, sample_id), all candidates entered."""
    p = _all_pairs(spark, sf_dir)
    b = p.groupBy("qid", "sample_id").agg(
        F.max_by(F.struct("cand_id", "score"), F.struct("score", -F.col("cand_id"))).alias("b"))
    return b.select("qid", "sample_id", "b.cand_id", "b.score")


@register("w7_dedup_by_text", with_fx("fx_vectors", "select qid, text, cand_id, score from w7f",
                                      _BASE + ",\n" + _FULL_ROUND))
def w7_dedup_by_text(spark, sf_dir):
    """W6 then W7: one candidate per (query, text), first in score order."""
    p = _all_pairs(spark, sf_dir).withColumn("entry", F.lit(1))
    s = RT.survivors(p, p.select("qid").distinct().withColumn("round", F.lit(1)))
    return s.select("qid", "text", "cand_id", "score")


@register("c14b_token_dice", with_fx(("fx_vectors", "fx_edit_seq"), f"""select qid, cand_id,
  {_dice_sql('a')} + {_dice_sql('r')} as diff_sim from (select s.qid, s.cand_id, s.sample_id, s."index", q.q_sid, q.q_idx
  from surv s join q using (qid)) top""", ",\n".join([_BASE, _TOKS])))
def c14b_token_dice(spark, sf_dir):
    """Token-multiset Dice of added + removed tokens between query and candidate diffs."""
    t, v, corpus, queries, payload = _inputs(spark, sf_dir)
    surv = rank_candidates(corpus, queries, payload)
    tm = _token_maps(t)
    keys = v.select(F.col("vec_id").alias("vid"), "sample_id", "index")
    km = keys.join(tm, ["sample_id", "index"], "left").drop("sample_id", "index")
    j = (surv.select("qid", "cand_id")
         .join(km.withColumnsRenamed({"vid": "qid", "am": "q_am", "rm": "q_rm"}), "qid", "left")
         .join(km.withColumnRenamed("vid", "cand_id"), "cand_id", "left"))
    return j.select("qid", "cand_id", (_dice("q_am", "am") + _dice("q_rm", "rm")).alias("diff_sim"))
