"""DuckDB SQL of the operators that SQL can express."""

from .quality import BOILERPLATE

WS = r"[\x20\x09-\x0D]+"
_W = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}'), lambda x: x <> '')"

QUALITY_VIEW = rf"""
qd as (select *, row_number() over () as rid, coalesce(text, '') as x from documents),
qw as (select *, list_filter(regexp_split_to_array(x, '{WS}'), lambda w: w <> '') as w from qd),
qg as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
       from (select rid, w, unnest(generate_series(1, len(w) - 2)) as i from qw where len(w) > 3)),
qp as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from qg) where c > 1),
qr as (select rid, sum(n) as n_repeat_words from (
        select rid, least(3, coalesce(lead(i) over (partition by rid order by i) - i, 3)) as n from qp) group by rid),
ql as (select rid, n, line, regexp_matches(line, '[^\x20\x09-\x0D]') as has,
              length(regexp_replace(line, '{WS}', '', 'g')) as chars,
              list_filter(regexp_split_to_array(line, '{WS}'), lambda w: w <> '') as lw
       from (select rid, unnest(string_split(x, chr(10))) as line, unnest(generate_series(1, len(string_split(x, chr(10))))) as n from qd)),
qf as (select *, has and (
        (not regexp_matches(line, '[.!?:;…]["''”’»)\]]*[\x20\x09-\x0D]*\z') and len(lw) > 12)
        or (not regexp_matches(line, '\p{{Ll}}') and regexp_matches(line, '(?:\p{{Lu}}[^\p{{Lu}}]*){{20}}'))
        or len(regexp_extract_all(line, '[#*$%&|<>]')) > 0.1 * chars
        or len(list_filter(lw, lambda w: w in ('|', '»', '>', '·'))) >= 4
        or len(list_filter({BOILERPLATE}, lambda p: contains(lower(line), p))) > 0
       ) as bad from ql),
qs as (select rid, count(*) as n_lines, count(*) filter (bad) as n_failed_lines, coalesce(sum(chars) filter (bad), 0) as lost_chars,
              count(*) filter (has) - count(distinct line) filter (has) as n_dup_lines,
              coalesce(string_agg(line, chr(10) order by n) filter (not bad), '') as clean_text from qf group by rid),
qa as (select qw.*, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
              len(regexp_extract_all(x, '[#*$%&|<>]')) as n_symbols, n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
              n_lines, n_failed_lines, lost_chars::bigint as lost_chars, clean_text
       from qw join qs using (rid) left join qr using (rid)),
quality as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
              not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or lost_chars > 0.5 * word_chars) as kept from qa)"""

QUALITY = f"""with {QUALITY_VIEW}
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines, n_repeat_words,
       base_failed, kept, n_lines, n_failed_lines, lost_chars from quality"""

LINE_DEDUP = r"""
with lines as (select doc_id, text, n, line, len(all_lines) as n_lines, ('0x' || substr(md5(line), 1, 7))::bigint as h
  from (select *, unnest(all_lines) as line, unnest(generate_series(1, len(all_lines))) as n
        from (select doc_id, text, string_split(text, chr(10)) as all_lines from documents where text is not null))),
marks as (select *, (h + 31 * coalesce(lag(h, 1) over d, 0) + 961 * coalesce(lag(h, 2) over d, 0)) % 4 = 0 as mark
  from lines window d as (partition by doc_id order by n)),
cuts as (select *, coalesce(n > 1 and n < n_lines and mark and not (n > 2 and lag(mark) over (partition by doc_id order by n)), false) as cut from marks),
nos as (select *, coalesce(sum(cut::int) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as no from cuts),
parts as (select doc_id, 0 as kind, min(n) as pos, count(*) as k, string_agg(line, chr(10) order by n) as body from nos group by doc_id, no
  union all select doc_id, 1, n, 2, line || chr(10) || lead(line) over (partition by doc_id order by n) from lines),
nth as (select *, first_value(doc_id) over p as first_id, first_value(pos) over p as first_pos
  from parts where k > 1 and regexp_matches(body, '[^\x20\x09-\x0D]') window p as (partition by kind, body order by doc_id, pos)),
later as (select * from nth where doc_id <> first_id or pos >= first_pos + k),
gone as (select distinct doc_id, n from (select doc_id, unnest(generate_series(pos, pos + k - 1)) as n from later)),
per as (select doc_id, count(*) as n_removed_lines from gone group by doc_id),
cut_out as (select doc_id, count(*) as n_removed_chunks from later where kind = 0 group by doc_id),
kept as (select doc_id, string_agg(line, chr(10) order by n) as t from lines anti join gone using (doc_id, n) group by doc_id)
select d.doc_id, case when text is null then 0 else len(string_split(text, chr(10))) end::bigint as n_lines,
  coalesce(n_removed_lines, 0) as n_removed_lines, coalesce(n_removed_chunks, 0) as n_removed_chunks,
  case when text is not null then sha256(coalesce(t, '')) end as kept_sha256
from documents d left join per using (doc_id) left join cut_out using (doc_id) left join kept using (doc_id)"""

MIXING_VIEW = rf"""
md as (select *, len({_W}) as size, ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as h from documents),
ms as (select source, sum(size)::bigint as source_size from md group by source),
mw as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight from ms),
mf as (select *, 3.0 * source_size / weight as full_at, sum(source_size) over ()::double as total from mw),
ml as (select *, (total - coalesce(sum(3.0 * source_size) over (order by full_at, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by full_at, source nulls last rows between current row and unbounded following) as own_level,
  row_number() over (order by full_at, source nulls last) as nth from mf),
mt as (select source, source_size, case when level is null then 3.0 * source_size else least(3.0 * source_size, level * weight) end::double as target
  from (select *, arg_min(own_level, nth) filter (own_level <= full_at) over () as level from ml)),
mp as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as passes from mt),
mc as (select source, h, sum(size)::double as s from md group by source, h),
mu as (select mc.source, h, s, passes, target - passes * source_size as budget, sum(s) over (partition by mc.source order by h) as upto
  from mc join mp on mc.source is not distinct from mp.source),
mx as (select source, min(h) filter (upto > budget) as edge from mu group by source),
mcut as (select mu.source, edge, s - (budget - (upto - s)) <= budget - (upto - s) as whole
  from mu join mx on mu.source is not distinct from mx.source and mu.h = mx.edge),
mixed as (select md.*, source_size, target, case when source_size = 0 then 1 else
    least(3, passes + case when target - passes * source_size > 0 and edge is null then 1 when h < edge or (h = edge and whole) then 1 else 0 end) end::bigint as copies
  from md join mp on md.source is not distinct from mp.source left join mcut on md.source is not distinct from mcut.source)"""

MIXING = f"""with {MIXING_VIEW}
select doc_id, size::bigint as size, source_size, target, (copies * size)::bigint as taken from mixed"""

WARC = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
o as (select html, max(page_id) as owner, count(*) as n from p group by html),
h as (select p.*, owner, n, sha1(p.html) as sha from p join o using (html)),
bits as (select *, array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
   1 + ((((('0x' || substr(sha, 1 + (k * 5) // 4, 2) || '0')::bigint) >> (7 - (k * 5) % 4)) & 31))::int, 1)), '') as digest from h)
select page_id, strlen(html)::bigint as payload_bytes, digest as payload_digest,
  case when page_id = owner then 'response' else 'revisit' end as record_type,
  case when page_id <> owner then owner end as refers_to from bits"""

EMBEDDING = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  and list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select x, y from pairs union select r.x, p.y from reach r join pairs p on r.y = p.x),
low as (select x, min(y) as y from reach group by x), n as (select x, count(*) as n from pairs group by x)
select e.vec_id, coalesce(n, 0) as n_links, least(e.vec_id, coalesce(low.y, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(low.y, e.vec_id)) as kept
from embeddings e left join n on n.x = e.vec_id left join low on low.x = e.vec_id"""


SPELLING = r"""
with recursive crc_table as materialized (select list(list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b:
    case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by c) as t from (select unnest(range(256))::bigint as c)),
runs as (select coalesce(doc_id::varchar, '') || ':' || w as s, w, count(*) as k from (
    select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w
    from documents) where length(w) >= 7 group by all),
hashed as (select w, k, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, strlen(s)),
    lambda i: ('0x' || substr(hex(s), 2 * i::int + 1, 2))::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) as h from runs, crc_table),
spelt as (select case when h % 31 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, k from hashed),
vocab as materialized (select word, sum(k)::bigint as n from spelt where length(word) >= 7 group by word having sum(k) >= 2),
spots as materialized (select word, n, unnest(range(1, length(word) + 1)) as i from vocab),
cuts as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest, length(word) as len from spots),
pairs as (select a.word as a, a.n as an, b.word as b, b.n as bn from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.len = b.len and a.word < b.word
  union select a.word, a.n, b.word, b.n from cuts a join vocab b on a.rest = b.word),
near as (select a as word, b as other, bn as m from pairs union all select b, a, an from pairs),
best as (select word, count(*) as n_near, arg_min(other, (-m, other)) as other, max(m) as m from near group by word),
forms as materialized (select v.word, n, coalesce(n_near, 0) as n_near, case when m >= 10 * n then other end as form, case when m >= 10 * n then m end as form_n
  from vocab v left join best using (word)),
chain as (select word, form as at from forms where form is not null
  union all select c.word, f.form from chain c join forms f on f.word = c.at where f.form is not null),
ends as (select c.word, c.at as root from chain c join forms f on f.word = c.at where f.form is null)
select f.word, form, coalesce(root, f.word) as root, n, n_near, form_n from forms f left join ends e on e.word = f.word"""

FILTER_AUDIT = rf"""
with known as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as bad from labels group by doc_id),
texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as x, {_W} as w,
    doc_id > min(doc_id) over (partition by coalesce(text, '')) as e from documents),
masks as (select part, coalesce(good, false) as good, coalesce(bad, false) as bad,
    (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
    + 4 * (100 * len(regexp_extract_all(x, '[A-Z]')) > 5 * length(x))::int + 8 * regexp_matches(x, '[#$%&*|]')::int + 16 * coalesce(e, false)::int as m
  from texts left join known using (doc_id)),
cells as materialized (select part, m, count(*) as n, count(*) filter (good) as g, count(*) filter (bad) as t from masks group by part, m),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as l, unnest([1, 2, 4, 8, 16]) as b),
orders as (select f1.l || f2.l || f3.l || f4.l || f5.l as filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] as bs
  from f f1, f f2, f f3, f f4, f f5 where f1.b + f2.b + f3.b + f4.b + f5.b = 31 and f1.b | f2.b | f3.b | f4.b | f5.b = 31),
steps as (select filter_order, s::int as step, bs[s] as b, list_sum(bs[1:s]) - bs[s] as pre from orders, (select unnest(range(1, 6)) as s)),
rows as (select part, filter_order, step, b,
    coalesce(sum(n) filter (m & (pre::int | b) = 0), 0)::bigint as kept, coalesce(sum(n) filter (m & pre::int = 0 and m & b > 0), 0)::bigint as removed,
    coalesce(sum(n) filter (m & pre::int > 0 and m & b > 0), 0)::bigint as redundant, coalesce(sum(n) filter (m = b), 0)::bigint as unique_fails,
    coalesce(sum(g) filter (m & pre::int = 0 and m & b > 0), 0)::bigint as good_lost, coalesce(sum(t) filter (m & pre::int = 0 and m & b > 0), 0)::bigint as toxic_lost
  from cells, steps group by part, filter_order, step, b, pre)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) over (partition by part, b))::bigint as shapley from rows"""
