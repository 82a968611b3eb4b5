"""DuckDB SQL for the queries whose results SQL can express.

The ids and digests of tokenizers, k-d splits (DuckDB has no CRC-32), spans found by
a bootstrap, randomised fingerprints and scores of a fitted model are beyond it;
tests hold those against brute force.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"'[^\x20\x09-\x0D]+'"
_FOLDED = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

JACCARD = f"""
with recursive w as (
 select doc_id, regexp_extract_all({_LOWER}, {_PLAIN}) as ws from documents),
s as (
 select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as shingle
 from w, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) u(i)),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (
 select x.doc_id as a, y.doc_id as b, count(*) as n
 from s x join s y on x.shingle = y.shingle and x.doc_id < y.doc_id group by 1, 2),
link as (
 select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b
 where 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
edge as (select a, b from link union all select b, a from link),
reach(doc_id, other) as (
 select doc_id, doc_id from documents
 union select reach.doc_id, edge.b from reach join edge on edge.a = reach.other)
select d.doc_id, coalesce(max(n.n), 0) as n_shingles, min(reach.other) as component_id
from documents d join reach on reach.doc_id = d.doc_id left join n on n.doc_id = d.doc_id
group by d.doc_id"""

SUBSTRING = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {_PLAIN}) as ws from documents),
p as (
 select doc_id, i, array_to_string(ws[i : i + 12], ' ') as phrase
 from w, unnest(range(1, greatest(len(ws) - 11, 1))) u(i)),
first as (select phrase, min(doc_id) as doc_id from p group by phrase),
gone as (
 select distinct p.doc_id, p.i + k as i
 from p join first on first.phrase = p.phrase and first.doc_id < p.doc_id, unnest(range(0, 13)) u(k)),
words as (select doc_id, i, ws[i] as word from w, unnest(range(1, len(ws) + 1)) u(i)),
kept as (
 select words.doc_id, string_agg(word, ' ' order by words.i) as text, count(*) as n
 from words anti join gone on gone.doc_id = words.doc_id and gone.i = words.i group by 1),
runs as (select doc_id, i - row_number() over (partition by doc_id order by i) as run from gone)
select w.doc_id, cast(len(ws) as bigint) as n_words, len(ws) - coalesce(kept.n, 0) as n_removed,
 sha256(coalesce(kept.text, '')) as kept_sha256, coalesce(r.n, 0) as n_spans
from w left join kept on kept.doc_id = w.doc_id
left join (select doc_id, count(distinct run) as n from runs group by 1) r on r.doc_id = w.doc_id"""

CONTAMINATION = f"""
with d as (select doc_id, regexp_extract_all({_LOWER}, {_FOLDED}) as ws from documents),
b as (
 select cast(item_id as varchar) as item, regexp_extract_all({_LOWER}, {_FOLDED}) as ws
 from benchmark),
t as (
 select distinct item, least(len(ws), 10) as n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') as phrase
 from b, unnest(range(1, greatest(len(ws) - 9, least(len(ws), 1)) + 1)) u(i)),
hit as (
 select d.doc_id, i, t.n, t.item
 from d, (select distinct n from t) k, unnest(range(1, greatest(len(ws) - k.n + 2, 1))) u(i)
 join t on t.n = k.n and t.phrase = array_to_string(ws[i : i + k.n - 1], ' ')),
words as (select doc_id, count(distinct i + k) as n from hit, unnest(range(0, n)) u(k) group by 1),
items as (select doc_id, string_agg(item, ',' order by item) as names, count(item) as n from (select distinct doc_id, item from hit) x group by 1)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(words.n, 0) as n_hit, coalesce(items.n, 0) as n_items,
 sha256(coalesce(items.names, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated
from d left join words on words.doc_id = d.doc_id left join items on items.doc_id = d.doc_id"""

BYTES = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as digits from documents),
part as (  -- short parts, so that a piece is near the start of its string
 select doc_id, k * 500 as base, substr(digits, 1000 * k + 1, 1098) as digits
 from t, unnest(range(0, len(digits) // 1000 + 1)) u(k)),
p as (
 select doc_id, base + i as i, substr(digits, 2 * i + 1, 100) as piece
 from part, unnest(range(0, least(500, greatest(len(digits) // 2 - 49, 0)))) u(i)),
first as (select piece, min(doc_id) as doc_id from p group by piece having count(*) > 1),
start as (select p.doc_id, i from p join first on first.piece = p.piece and first.doc_id < p.doc_id),
step as (select doc_id, i, case when i <= 50 + lag(i) over (partition by doc_id order by i) then 0 else 1 end as fresh from start),
run as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from step),
gone as (select doc_id, min(i) as a, max(i) + 50 as b from run group by doc_id, run),
edge as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as before from gone),
kept as (
 select doc_id, sum(b - a) as removed, count(*) as spans, max(b) as last,
  string_agg(substr(digits, 2 * before + 1, 2 * (a - before)), '' order by a) as head
 from edge join t using (doc_id) group by doc_id)
select t.doc_id, cast(len(digits) // 2 as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed,
 coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(head, '') || substr(digits, 2 * coalesce(last, 0) + 1))) as kept_sha256
from t left join kept using (doc_id)"""

AUDIT = r"""
with marks as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
d as (
 select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws
 from documents),
m as (
 select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
  case when len(ws) < 100 then 1 else 0 end
  + case when 100 * len(list_distinct(ws)) < 80 * len(ws) then 2 else 0 end
  + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) then 4 else 0 end
  + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
  + case when coalesce(doc_id, 9223372036854775807) > min(doc_id) over (partition by text) then 16 else 0 end as mask
 from d left join marks using (doc_id)),
cell as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by all),
letter(l) as (select unnest(['A', 'B', 'C', 'D', 'E'])),
orders as (
 select a.l || b.l || c.l || d.l || e.l as filter_order from letter a, letter b, letter c, letter d, letter e
 where a.l not in (b.l, c.l, d.l, e.l) and b.l not in (c.l, d.l, e.l) and c.l not in (d.l, e.l) and d.l <> e.l),
step as (
 select filter_order, i as step, 1 << (ascii(filter_order[i]) - 65) as own,
  list_sum([1 << (ascii(filter_order[j]) - 65) for j in range(1, i)]) as before
 from orders, unnest(range(1, 6)) u(i)),
x as (
 select part, filter_order, step, own, n, good, toxic, mask,
  mask & own <> 0 as fails, mask & cast(coalesce(before, 0) as integer) <> 0 as gone from cell, step),
y as (
 select part, filter_order, step, own, coalesce(sum(n) filter (not fails and not gone), 0) as kept,
  coalesce(sum(n) filter (fails and not gone), 0) as removed, coalesce(sum(n) filter (fails and gone), 0) as redundant,
  coalesce(sum(n) filter (mask = own), 0) as unique_fails, coalesce(sum(good) filter (fails and not gone), 0) as good_lost,
  coalesce(sum(toxic) filter (fails and not gone), 0) as toxic_lost
 from x group by all)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
 cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
 cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley
from y"""

LINES = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (
 select doc_id, i, ls[i] as line,
  translate(regexp_replace(regexp_replace(ls[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
 from d, unnest(range(1, len(ls) + 1)) u(i)),
many as (
 select k, max(doc_id) as last from l where length(k) >= 40 group by k
 having count(distinct doc_id) >= 5),
mark as (select l.*, last is not null and doc_id <> last as gone from l left join many using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
 sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from mark group by doc_id"""
