"""SQL for the registered queries that plain SQL can express on whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = rf"""
with d as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as (
  select distinct item_id, least(10, len(w)) as k, array_to_string(w[i : i + 9], ' ') as part
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)
), places as (
  select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as part from (
    select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i
    from d cross join (select distinct k from windows) where len(w) >= k)
), hits as (
  select doc_id, i, p.k, item_id from places p join windows v on p.k = v.k and p.part = v.part
), hit_words as (
  select doc_id, count(distinct word) as n_hit
  from (select doc_id, unnest(range(i, i + k)) as word from hits) group by doc_id
), hit_items as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
  from (select distinct doc_id, cast(item_id as varchar) as item_id from hits) group by doc_id
)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words h on d.doc_id = h.doc_id left join hit_items t on d.doc_id = t.doc_id
"""

REPEATS = """
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), strings as (
  select doc_id, i, md5(substring(h, 2 * i + 1, 100)) as s
  from (select doc_id, h, unnest(range(0, length(h) // 2 - 49)) as i from d where length(h) >= 100)
), again as (
  select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as first_doc from strings)
  where first_doc < doc_id
), marked as (
  select doc_id, i, max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as before
  from again
), runs as (
  select doc_id, i, sum(case when before is null or i > before + 50 then 1 else 0 end)
    over (partition by doc_id order by i) as run from marked
), spans as (
  select doc_id, min(i) as a, max(i) + 50 as b from runs group by doc_id, run
), parts as (
  select s.doc_id, a, substring(h, 2 * coalesce(lag(b) over w, 0) + 1, 2 * (a - coalesce(lag(b) over w, 0))) as part,
    b - a as n, case when lead(a) over w is null then substring(h, 2 * b + 1) else '' end as rest
  from spans s join d on s.doc_id = d.doc_id window w as (partition by s.doc_id order by a)
), kept as (
  select doc_id, sum(n) as n_removed, count(*) as n_spans, string_agg(part || rest, '' order by a) as k from parts group by doc_id
)
select d.doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed,
  coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
from d left join kept on d.doc_id = kept.doc_id
"""

NEAR_COPIES = rf"""
with recursive d as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select distinct doc_id, array_to_string(w[i : i + 3], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) as i from d where len(w) > 0)
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), common as (
  select a.doc_id as x, b.doc_id as y, count(*) as n_both
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), links as (
  select x, y from common join sizes p on x = p.doc_id join sizes q on y = q.doc_id
  where 100 * n_both >= 80 * (p.n + q.n - n_both)
), edges as (
  select x, y from links union select y, x from links
), reach as (
  select x as doc_id, y as seen from edges union select r.doc_id, e.y from reach r join edges e on r.seen = e.x
), lowest as (
  select doc_id, min(seen) as low from reach group by doc_id
)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id,
  d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) as kept
from d left join sizes on d.doc_id = sizes.doc_id left join lowest on d.doc_id = lowest.doc_id
"""
