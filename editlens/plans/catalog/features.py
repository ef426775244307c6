"""Edit-sequence features and diffs (W9, W10, W11, C5, C13, C13b, C19, C21) -> E6."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...fixtures import KEY, Tables, edit_seq, samples
from ...functions import tokens as T
from ...operators import editseq as X
from ...oracle import with_fx
from ...registry import ORACLE, register

K = 'sample_id, "index"'
PUNCT_SQL = X.PUNCTUATION.replace("'", "''")


def _seq(spark, sf_dir):
    return edit_seq(samples(Tables(spark, sf_dir).conversations))


def _desc(seq):
    """Description edit sequence of a pair: the fixture's sequence of the next turn."""
    return seq.withColumn("index", F.col("index") - 1)


# ---- DuckDB building blocks ---------------------------------------------------------
def _duck_seq_ctes(src: str, p: str) -> str:
    """CTEs ``{p}pv`` (with previous element) and ``{p}merged`` (W11) over CTE ``src``."""
    return f"""{p}pv as (select a.*, (a.src = '<con>' or a.dst = '<con>') as con, b.op as prev_op,
    (b.src = '<con>' or b.dst = '<con>') as prev_con
  from {src} a left join {src} b on a.sample_id = b.sample_id and a."index" = b."index" and b.pos = a.pos - 1),
{p}g as (select *, sum(case when not (con or coalesce(prev_con, false)) then 1 else 0 end) over
  (partition by sample_id, "index" order by pos rows between unbounded preceding and current row) as grp from {p}pv),
{p}mg as (select sample_id, "index", grp, min(pos) filter (where not con) as pos,
  string_agg(src, '' order by pos) filter (where not con) as src, string_agg(dst, '' order by pos) filter (where not con) as dst,
  arg_min(op, pos) filter (where not con) as op0, count(*) as n, count(*) filter (where not con) as m
  from {p}g group by all),
{p}merged as (select sample_id, "index", pos, src, dst, case when n = 1 then op0 when src = dst then 'equal'
  when src = '' then 'insert' when dst = '' then 'delete' else 'replace' end as op from {p}mg where m > 0)"""


def _duck_consistency(code: str, desc: str, out: str) -> str:
    sym = f"(tok = '' or tok = '<con>' or instr('{PUNCT_SQL}', tok) > 0)"
    return f"""{out} as (select sample_id, "index", count(*) as {out} from (
  select distinct sample_id, "index", src as tok from {code}) cs
  where not {sym}
    and exists (select 1 from {desc} d where d.sample_id = cs.sample_id and d."index" = cs."index" and d.src = cs.tok)
    and not exists (select 1 from {code} c where c.sample_id = cs.sample_id and c."index" = cs."index" and c.dst = cs.tok)
  group by all)"""


def _duck_lines(col: str) -> str:
    toks = f"list(case when {col} <> '' and {col} <> '<con>' then {col} end order by pos)"
    toks = f"list_filter({toks}, lambda t: t is not null)"
    return (f"array_to_string(list_transform(range(0, cast(ceil(len({toks}) / 6) as bigint)), "
            f"lambda i: array_to_string({toks}[i * 6 + 1:i * 6 + 6], ' ')), chr(10))")


def _duck_cc(t: str) -> str:
    return (f"(1 + len(regexp_extract_all({t}, '\\b(if|for|while|case|catch)\\b')) "
            f"+ (length({t}) - length(replace({t}, '&&', ''))) / 2 + (length({t}) - length(replace({t}, '||', ''))) / 2 "
            f"+ (length({t}) - length(replace({t}, '?', ''))))")


_DESC = 'dseq as (select sample_id, "index" - 1 as "index", pos, src, dst, op from fx_edit_seq)'
_TEXTS = f"""tx as (select {K}, {_duck_lines('src')} as src_method, {_duck_lines('dst')} as dst_method
  from fx_edit_seq group by all)"""
_E6_CTES = ",\n".join([
    _DESC, _duck_seq_ctes("fx_edit_seq", "c"), _duck_seq_ctes("dseq", "d"),
    "cmerged2 as (select * from cmerged), dmerged2 as (select * from dmerged)",
    _duck_consistency("fx_edit_seq", "dseq", "NSOD"), _duck_consistency("cmerged", "dmerged", "NTOD"), _TEXTS,
    f"""raw as (select {K}, count(*) filter (where op <> 'equal' and not con) as NMS,
  count(distinct src || chr(1) || dst || chr(1) || op) filter (where op <> 'equal' and not con) as NNSRP,
  count(*) filter (where op <> 'equal' and (prev_op is null or prev_op = 'equal')) as NMC from cpv group by all)""",
    f"""mrg as (select {K}, count(*) filter (where op <> 'equal' and not (src = '<con>' or dst = '<con>')) as NMT,
  count(distinct src || chr(1) || dst || chr(1) || op) filter (where op <> 'equal'
    and not (src = '<con>' or dst = '<con>')) as NNTRP from cmerged group by all)""",
])
_E6 = with_fx("fx_edit_seq", f"""select raw.sample_id, raw."index", coalesce(NMT, 0) as NMT, NMS, NMC,
  coalesce(NNTRP, 0) as NNTRP, NNSRP, coalesce(NSOD.NSOD, 0) as NSOD, coalesce(NTOD.NTOD, 0) as NTOD,
  cast(abs({_duck_cc('tx.src_method')} - {_duck_cc('tx.dst_method')}) as int) as CC_delta
  from raw left join mrg using (sample_id, "index") left join NSOD using (sample_id, "index")
  left join NTOD using (sample_id, "index") join tx using (sample_id, "index")""", _E6_CTES)


def extract_features(seq):
    """E6 ``get_features_labels`` (its commented wiring implemented): size and
    structure features of every edit pair.

    The long edit sequence feeds about ten aggregates and joins; it is checkpointed
    once (shared folder) so each of them scans a file instead of re-deriving it."""
    seq = seq.checkpoint()
    desc = _desc(seq)
    # the description sequence is the same rows under a shifted key, so its merge
    # is the code merge shifted; the merge is read three times and checkpointed
    merged = X.merge_connectors(seq).checkpoint()
    dmerged = _desc(merged)
    raw = X.count_features(seq, "raw").join(X.modified_chunks(seq), KEY)
    mrg = X.count_features(merged, "mrg")
    texts = X.method_texts(seq)
    out = (raw.join(mrg, KEY, "left")
           .join(X.desc_consistency(seq, desc, "NSOD"), KEY, "left")
           .join(X.desc_consistency(merged, dmerged, "NTOD"), KEY, "left")
           .join(texts, KEY))
    return out.select(*KEY, F.coalesce("mrg_modified", F.lit(0)).cast("long").alias("NMT"),
                      F.col("raw_modified").cast("long").alias("NMS"), F.col("NMC").cast("long"),
                      F.coalesce("mrg_distinct", F.lit(0)).cast("long").alias("NNTRP"),
                      F.col("raw_distinct").cast("long").alias("NNSRP"),
                      F.coalesce("NSOD", F.lit(0)).cast("long").alias("NSOD"),
                      F.coalesce("NTOD", F.lit(0)).cast("long").alias("NTOD"),
                      X.cc_delta(F.col("src_method"), F.col("dst_method")).alias("CC_delta"))


@register("e6_features", _E6)
def e6_features(spark, sf_dir):
    return extract_features(_seq(spark, sf_dir))


@register("w9_modified_chunks", with_fx("fx_edit_seq", f"select {K}, NMC from raw", _E6_CTES))
def w9_modified_chunks(spark, sf_dir):
    return X.modified_chunks(_seq(spark, sf_dir)).select(*KEY, F.col("NMC").cast("long"))


@register("w11_merge_connectors", with_fx("fx_edit_seq", f"select {K}, pos, src, dst, op from cmerged", _E6_CTES))
def w11_merge_connectors(spark, sf_dir):
    return X.merge_connectors(_seq(spark, sf_dir))


@register("c19_count_features", with_fx("fx_edit_seq", f"""select {K}, NMS, NNSRP, coalesce(NMT, 0) as NMT,
  coalesce(NNTRP, 0) as NNTRP from raw left join mrg using (sample_id, "index")""", _E6_CTES))
def c19_count_features(spark, sf_dir):
    seq = _seq(spark, sf_dir)
    raw = X.count_features(seq, "raw")
    mrg = X.count_features(X.merge_connectors(seq), "mrg")
    return raw.join(mrg, KEY, "left").select(
        *KEY, F.col("raw_modified").cast("long").alias("NMS"), F.col("raw_distinct").cast("long").alias("NNSRP"),
        F.coalesce("mrg_modified", F.lit(0)).cast("long").alias("NMT"),
        F.coalesce("mrg_distinct", F.lit(0)).cast("long").alias("NNTRP"))


@register("c21_cc_delta", with_fx("fx_edit_seq", f"""select {K}, cast({_duck_cc('src_method')} as int) as cc_src,
  cast({_duck_cc('dst_method')} as int) as cc_dst from tx""", _TEXTS))
def c21_cc_delta(spark, sf_dir):
    t = X.method_texts(_seq(spark, sf_dir))
    return t.select(*KEY, X.branch_complexity(F.col("src_method")).alias("cc_src"),
                    X.branch_complexity(F.col("dst_method")).alias("cc_dst"))


#: Code-like lines for the tokens of a text, by their place: branches, nesting, and branch words in strings and comments.
_LINES = ("if (T && x) {", "}", "s = \"if (a) { while\";", "// for T if {", "for (;;) { T(); }", "y = T ? 1 : 2;", "c = '}'; /* catch ( { */", "while (x || T) {", "}")


def _code_sql(toks: str) -> str:
    line = " ".join(f"when {i} then replace('{x.replace(chr(39), chr(39) * 2)}', 'T', t)" for i, x in enumerate(_LINES))
    body = f"array_to_string(list_transform({toks}, lambda t, i: case (i - 1) % {len(_LINES)} {line} end), chr(10))"
    return f"""case when sample_id % 7 = 6 then {body} else 'int f' || sample_id || ' (int a) {{' || chr(10) || {body} || chr(10) || '}}' || chr(10) || 'void g() {{ if (b) {{}} }}' end"""


_CODE = f"""fx_code as (select {K}, {_code_sql('src_toks')} as src, {_code_sql('ref_toks')} as dst from fx_samples)"""


def _complexity_sql(side: str) -> str:
    literal = X.LITERAL_RE.replace("*+", "*").replace("'", "''")
    kinds = f"{X.HEADER_RE}|[{{}}]|{X.FLOW_RE}"
    return f"""{side}t as (select {K}, unnest(regexp_extract_all(regexp_replace({side}, '{literal}', ' ', 'g'), '{kinds}')) as t,
    unnest(range(1, 1 + len(regexp_extract_all(regexp_replace({side}, '{literal}', ' ', 'g'), '{kinds}')))) as i from fx_code),
{side}d as (select *, regexp_matches(t, '^{X.HEADER_RE}$') as header, len(regexp_extract_all(t, '{X.FLOW_RE}')) as flow,
    sum(case when t = '}}' then -1 when t = '{{' or regexp_matches(t, '^{X.HEADER_RE}$') then 1 else 0 end) over (partition by {K} order by i) as depth from {side}t),
{side}o as (select {K}, min(i) as i, arg_min(depth, i) - 1 as base from {side}d where header and not regexp_matches(t, '{X.CONTROL_RE}') group by all),
{side}e as (select d.sample_id, d."index", min(d.i) as i from {side}d d join {side}o o using (sample_id, "index") where d.i > o.i and d.t = '}}' and d.depth <= o.base group by all),
{side}c as (select d.sample_id, d."index", 1 + sum(flow) as cc from {side}d d join {side}o o using (sample_id, "index") left join {side}e e using (sample_id, "index")
    where d.i >= o.i and (e.i is null or d.i <= e.i) group by all)"""


@register("c21_function_complexity", with_fx("fx_samples", f"""select {K}, coalesce(s.cc, 0)::int as cc_src, coalesce(d.cc, 0)::int as cc_dst,
  case when s.cc > 0 and d.cc > 0 then abs(s.cc - d.cc) else 0 end::int as cc_delta
  from fx_code left join srcc s using (sample_id, "index") left join dstc d using (sample_id, "index")""",
                                             ",\n".join([_CODE, _complexity_sql("src"), _complexity_sql("dst")])))
def c21_function_complexity(spark, sf_dir):
    """C21 by function: code-like texts with branch words in strings and comments, some without a function."""
    def code(toks):
        line = lambda t, i: F.element_at(F.array(*[F.replace(F.lit(x), F.lit("T"), t) for x in _LINES]), i % len(_LINES) + 1)
        body = F.array_join(F.transform(toks, line), "\n")
        whole = F.concat(F.lit("int f"), "sample_id", F.lit(" (int a) {\n"), body, F.lit("\n}\nvoid g() { if (b) {} }"))
        return F.when(F.col("sample_id") % 7 == 6, body).otherwise(whole)
    s = samples(Tables(spark, sf_dir).conversations).select(*KEY, code("src_toks").alias("src"), code("ref_toks").alias("dst"))
    return s.select(*KEY, X.function_complexity(F.col("src")).alias("cc_src"), X.function_complexity(F.col("dst")).alias("cc_dst"),
                    X.function_complexity_delta(F.col("src"), F.col("dst")).cast("int").alias("cc_delta"))


@register("c5_token_streams", with_fx("fx_edit_seq", f"""select {K},
  list(lower(src) order by pos) filter (where src <> '' and src <> '<con>') as buggy,
  list(lower(dst) order by pos) filter (where dst <> '' and dst <> '<con>') as fixed,
  list_sort(list_distinct(list_concat(
    coalesce(list(lower(src)) filter (where op <> 'equal' and src <> '' and src <> '<con>' and regexp_full_match(src, '[A-Za-z]+')), []),
    coalesce(list(lower(dst)) filter (where op <> 'equal' and dst <> '' and dst <> '<con>' and regexp_full_match(dst, '[A-Za-z]+')), [])))) as changed
  from fx_edit_seq group by all"""))
def c5_token_streams(spark, sf_dir):
    seq = _seq(spark, sf_dir)
    keep = lambda c: F.when((F.col(c) != "") & (F.col(c) != "<con>"), F.struct("pos", F.lower(c).alias("t")))  # noqa
    ch = lambda c: F.when((F.col("op") != "equal") & (F.col(c) != "") & (F.col(c) != "<con>")
                          & T.is_alpha(F.col(c)), F.lower(c))
    g = seq.groupBy(*KEY).agg(F.array_sort(F.collect_list(keep("src"))).alias("b"),
                              F.array_sort(F.collect_list(keep("dst"))).alias("f"),
                              F.collect_set(ch("src")).alias("c1"), F.collect_set(ch("dst")).alias("c2"))
    nz = lambda a: F.when(F.size(a) > 0, a)                                          # noqa: E731
    return g.select(*KEY, nz(F.transform("b", lambda x: x["t"])).alias("buggy"),
                    nz(F.transform("f", lambda x: x["t"])).alias("fixed"),
                    F.array_sort(F.array_union("c1", "c2")).alias("changed"))


@register("c13b_line_multiset_diff", with_fx("fx_edit_seq", f"""select {K}, cast(sum(greatest(nd - ns, 0)) as bigint) as added,
  cast(sum(greatest(ns - nd, 0)) as bigint) as removed,
  cast(greatest(sum(greatest(nd - ns, 0)), sum(greatest(ns - nd, 0))) as bigint) as NML from (
  select {K}, line, count(*) filter (where side = 's') as ns, count(*) filter (where side = 'd') as nd from (
    select {K}, unnest(string_split(src_method, chr(10))) as line, 's' as side from tx union all
    select {K}, unnest(string_split(dst_method, chr(10))) as line, 'd' as side from tx) group by all) group by all""",
                                                 _TEXTS))
def c13b_line_multiset_diff(spark, sf_dir):
    return X.line_multiset_diff(X.method_texts(_seq(spark, sf_dir)))


@register("e6_features_with_nml", f"""select e.*, n.NML from ({_E6}) e
  join (select sample_id, "index", NML from ({ORACLE["c13b_line_multiset_diff"]})) n using (sample_id, "index")""")
def e6_features_with_nml(spark, sf_dir):
    """E6 plus NML from the line multiset diff."""
    seq = _seq(spark, sf_dir)
    return extract_features(seq).join(X.line_multiset_diff(X.method_texts(seq)).select(*KEY, "NML"), KEY)
