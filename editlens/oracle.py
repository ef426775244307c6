"""DuckDB text of the fixture views (FIXTURES.md), used to build oracle SQL.

Each entry is a CTE body over the base tables the driver registers. ``with_fx``
prepends the needed CTEs (and their dependencies) to an oracle query.
"""

from __future__ import annotations

FX: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_samples": ((), """
select conv_id as sample_id, turn as "index", role, conv_id % 3 as level, ref_toks,
       list_filter(ref_toks, lambda x, i: i % 5 <> 0) as src_toks,
       case when conv_id % 4 = 0 then ref_toks
            else list_transform(ref_toks, lambda x, i: case when i % 7 = 0 then 'x' else x end) end as hyp_toks
from (select *, string_split(regexp_replace(text, '[^A-Za-z0-9.,]+', ' ', 'g'), ' ') as ref_toks
      from conversations)"""),
    "fx_edit_seq": (("fx_samples",), """
select sample_id, "index", cast(p as bigint) as pos,
  case when p % 11 = 0 then '<con>' when p % 5 = 0 then t when p % 7 = 0 then t when p % 6 = 0 then '' else t end as src,
  case when p % 11 = 0 then '<con>' when p % 5 = 0 then '' when p % 7 = 0 then 'x' else t end as dst,
  case when p % 11 = 0 then 'equal' when p % 5 = 0 then 'delete' when p % 7 = 0 then 'replace'
       when p % 6 = 0 then 'insert' else 'equal' end as op
from (select sample_id, "index", len(ref_toks) as n, unnest(ref_toks) as t,
             generate_subscripts(ref_toks, 1) as p from fx_samples)
where not (p % 11 = 0 and p = n)"""),
    "fx_features": ((), """
select l_orderkey as sample_id, cast(l_linenumber as bigint) as "index",
  cast(count(*) as double) as NMT, cast(sum(l_quantity) as double) as NMS,
  cast(max(l_quantity) as double) as NML, cast(count(distinct l_partkey) as double) as NMC,
  cast(min(l_quantity) as double) as NNTRP, cast(count(distinct l_suppkey) as double) as NNSRP,
  cast(max(l_partkey) % 7 as double) as NTOD, cast(max(l_suppkey) % 5 as double) as NSOD,
  cast(round(max(l_discount) * 100) as double) as CC_delta,
  cast(round(max(l_tax) * 100) as double) as delta_dependency,
  round((max(l_partkey) % 1000) / 1000.0e0, 5) as sim_cocom,
  cast(max(l_partkey) % 13 as double) as codeChangeNum,
  cast(max(l_suppkey) % 17 as double) as codeChangeScore,
  cast(max(l_partkey) % 3 as double) as refactoringTypeNum
from lineitem group by l_orderkey, l_linenumber"""),
    "fx_predictions": (("fx_features",), """
select sample_id, "index", y, yhat, w0 / (w0 + w1 + w2) as p0, w1 / (w0 + w1 + w2) as p1, w2 / (w0 + w1 + w2) as p2 from (
 select *, 1.0e0 + (case when yhat = 0 then 3 else 0 end) + (sample_id * 7) % 5 as w0,
           1.0e0 + (case when yhat = 1 then 3 else 0 end) + (sample_id * 7 + 3) % 5 as w1,
           1.0e0 + (case when yhat = 2 then 3 else 0 end) + (sample_id * 7 + 6) % 5 as w2 from (
  select *, case when (sample_id + "index") % 5 = 0 then (y + 1) % 3 else y end as yhat from (
   select sample_id, "index", cast(refactoringTypeNum as int) as y from fx_features) a) b) d"""),
    "fx_vectors": ((), """
select vec_id, vec_id // 3 as sample_id, vec_id % 3 as "index", label % 3 as level, vec_id % 25 = 0 as is_query,
  list_transform(list_slice(embedding, 1, 32), lambda x: x::double) as old_vec,
  list_transform(list_slice(embedding, 33, 64), lambda x: x::double) as new_vec from embeddings"""),
    "fx_changes": ((), """
select user_id as sample_id, cast(day(ts) as bigint) as "index", event_id, event_type as change_type,
  case when event_id % 4 = 0 then 'NONE' when event_id % 4 = 1 then 'LOW' else 'HIGH' end as significance,
  concat('K', cast(event_id % 5 as varchar), ' : ', props) as content
from events"""),
    "fx_raters": ((), """
select doc_id as item_id,
  case when doc_id % 6 = 0 then 0 when toxic = 1 then 2 else quality end as label,
  case when toxic = 1 then 2 else quality end as a,
  case when doc_id % 5 = 0 then 1 - quality when toxic = 1 then 2 else quality end as b,
  case when doc_id % 7 = 0 then 2 else quality end as c
from labels"""),
}


def _deps(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for n in names:
        if n in seen:
            continue
        _deps(FX[n][0], seen)
        seen.append(n)
    return seen


def with_fx(names: str | tuple[str, ...], body: str, extra_ctes: str = "") -> str:
    """``WITH <fixture ctes>[, extra] <body>``; dependencies are added first."""
    if isinstance(names, str):
        names = (names,)
    order = _deps(tuple(names), [])
    ctes = [f"{n} as ({FX[n][1].strip()})" for n in order]
    if extra_ctes.strip():
        ctes.append(extra_ctes.strip())
    return "with " + ",\n".join(ctes) + "\n" + body.strip()
