"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents
), w as (
  select doc_id, norm,
         first_value(doc_id) over (partition by norm order by n desc, doc_id nulls last) as keep_id,
         count(*) over (partition by norm) as group_size
  from d
)
select doc_id, keep_id, cast(group_size as bigint) as group_size,
       doc_id is not distinct from keep_id as kept, sha256(norm) as text_sha256
from w
"""

OP2 = """
with p as (select page_id, coalesce(html, '') as h, sha256(coalesce(html, '')) as digest from pages),
f as (
  select *, case when strlen(h) >= 100 then min(page_id) over (partition by digest) end as first from p
)
select page_id, cast(strlen(h) as bigint) as payload_bytes, digest as payload_digest,
       case when first is null or page_id is not distinct from first then 'response' else 'revisit' end as record_type,
       case when first is not null and page_id is distinct from first then first end as refers_to
from f
"""

OP6 = r"""
with low as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents
), items as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from benchmark
), wins as (
  select distinct item, least(len(ws), 10) as n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') as gram
  from (select item, ws, unnest(range(1, greatest(2, len(ws) - 8))) as i from items where len(ws) > 0)
), grams as (
  select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as gram
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i
        from low cross join (select distinct n from wins) where len(ws) >= n)
), found as (
  select g.doc_id, g.i, g.n, w.item from grams g join wins w on g.gram = w.gram and g.n = w.n
), hits as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from found)) group by doc_id
), owned as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as sha
  from (select distinct doc_id, item from found) group by doc_id
), gram as (
  select row_number() over () as g, n, gram, string_split(gram, ' ') as ts from (select distinct n, gram from wins)
), term as (select g, n, unnest(ts) as w, unnest(range(0, n)) as j from gram
), place as (select doc_id, unnest(ws) as w, unnest(range(0, len(ws))) as i from low
), able as (
  select g, doc_id from term join (select distinct doc_id, w from place) using (w) group by g, doc_id having count(distinct j) >= any_value(n) - any_value(n) // 10
), spot as (
  select t.g, t.n, p.doc_id, p.i - t.j as base, t.j from able a join term t using (g) join place p on p.doc_id = a.doc_id and p.w = t.w
), near as (
  select distinct g, doc_id from (
    select x.g, x.doc_id, x.base, count(distinct y.j) as held, any_value(x.n) as n
    from (select distinct g, n, doc_id, base from spot) x, range(-2, 3) r(d), spot y
    where y.g = x.g and y.doc_id = x.doc_id and y.base = x.base + r.d group by x.g, x.doc_id, x.base
  ) where held >= n - n // 10
), loose as (
  select doc_id, count(*) as n_near, string_agg(item, ',' order by item) as near_items
  from (select distinct doc_id, item from near join gram using (g) join wins w on w.gram = gram.gram and w.n = gram.n) group by doc_id
)
select l.doc_id, cast(len(l.ws) as bigint) as n_words, cast(coalesce(h.n_hit, 0) as bigint) as n_hit,
       cast(coalesce(o.n_items, 0) as bigint) as n_items, coalesce(o.sha, sha256('')) as items_sha256,
       coalesce(h.n_hit, 0) > 0 as contaminated,
       cast(coalesce(z.n_near, 0) as bigint) as n_near, coalesce(z.near_items, '') as near_items
from low l left join hits h using (doc_id) left join owned o using (doc_id) left join loose z using (doc_id)
"""

OP9 = r"""
with recursive low as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as ws
  from documents
), sh as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as s
  from (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) as i from low where len(ws) > 0)
), size as (
  select doc_id, count(*) as n from sh group by doc_id
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n
  from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all
), link as (
  select a, b from shared x join size p on p.doc_id = a join size q on q.doc_id = b
  where 100 * x.n >= 75 * (p.n + q.n - x.n)
), edge as (
  select a, b from link union select b, a from link
), reach as (
  select doc_id as v, doc_id as r from size
  union
  select e.b, r.r from reach r join edge e on e.a = r.v
)
select l.doc_id, coalesce(z.n, 0) as n_shingles, coalesce(m.c, l.doc_id) as component_id, coalesce(m.c, l.doc_id) = l.doc_id as kept
from low l left join size z using (doc_id) left join (select v as doc_id, min(r) as c from reach group by v) m using (doc_id)
"""

# crc32 is linear: each byte adds a value that depends on how many bytes follow it, and the register's start adds one.
CRC = """
bit(b, v, k) as (
  select range, range, 0 from range(256)
  union all
  select b, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from bit where k < 8
), step as (select b, v from bit where k = 8
), far(b, d, v) as (
  select b, 0, v from step
  union all
  select f.b, f.d + 1, xor(f.v >> 8, s.v) from far f join step s on s.b = f.v & 255 where f.d < (select max(strlen(s)) from texts)
), start(n, v) as (
  select 0, 4294967295
  union all
  select n + 1, xor(i.v >> 8, s.v) from start i join step s on s.b = i.v & 255 where n < (select max(strlen(s)) from texts)
), crc as (
  select b.s, xor(xor(any_value(i.v), 4294967295), bit_xor(f.v)) as crc
  from (select s, strlen(s) as n, hex(encode(s)) as h, unnest(range(1, strlen(s) + 1)) as p from texts) b
  join far f on f.b = cast('0x' || substr(h, 2 * p - 1, 2) as bigint) and f.d = b.n - p
  join start i on i.n = b.n
  group by b.s
)
"""

OP11 = rf"""
with recursive ws as (
  select 0 as side, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
  union all
  select 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), grams as (
  select side, id, array_to_string(ws[i:i + k - 1], ' ') as s
  from (select side, id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from ws, range(1, 4) r(k) where len(ws) >= k)
), texts as (select distinct s from grams), {CRC.strip()}, held as (
  select side, id, crc % 10000 as bucket, count(*) as n from grams join crc using (s) group by all
), gain as (
  select bucket, cast(floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) as bigint) as gain
  from (select bucket, cast(coalesce(sum(n) filter (side = 0), 0) as double) as s, cast(coalesce(sum(n) filter (side = 1), 0) as double) as t
        from held group by bucket),
       (select cast(coalesce(sum(n) filter (side = 0), 0) as double) as all_s, cast(coalesce(sum(n) filter (side = 1), 0) as double) as all_t from held)
), docs as (
  select d.id as doc_id, len(d.ws) as n_words, coalesce(w.n, 0) as n_features, coalesce(w.weight, 0) as weight,
         cast('0x' || substr(sha256('42:' || d.id), 1, 8) as bigint) as h
  from ws d left join (select id, sum(n) as n, sum(n * gain) as weight from held join gain using (bucket) where side = 0 group by id) w on w.id = d.id
  where d.side = 0
), scored as (
  select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::double))) as bigint) as score from docs
), placed as (
  select *, case when n_words >= 20 then row_number() over (partition by n_words >= 20 order by score desc, doc_id) end as place,
         count(*) filter (n_words >= 20) over () as able
  from scored
)
select doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score,
       cast(case when place <= able * 5 // 100 then place end as bigint) as rank, cast(n_words as bigint) as n_words
from placed
"""

OP13 = f"""
with recursive texts as (select distinct cast(doc_id as varchar) as s from documents where doc_id is not null), {CRC.strip()}, part as (
  select doc_id, lang, coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
         n_chars, coalesce(strlen(text) || ':' || text, '-') as body
  from documents
), leaves as (
  select doc_id, lang, sha256(head || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') || body) as leaf,
         sha256(head || coalesce(strlen(cast(m as varchar)) || ':' || m, '-') || body) as altered
  from (select *, n_chars + case when crc % 7 = 0 then 1 else 0 end as m from part left join crc on crc.s = cast(doc_id as varchar))
), placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from leaves
), low as (
  select lang, 0 as level, i, n, leaf as h from placed
  union all
  select lang, level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' order by i)) from low where n > 1 group by lang, level, i // 2
), subs as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as g, count(*) over () as n from low where n = 1
), high as (
  select 0 as level, g as i, n, subroot as h from subs
  union all
  select level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' order by i)) from high where n > 1 group by level, i // 2
), steps as (
  select p.doc_id, p.lang, p.i as leaf_i, l.level, (p.i >> l.level) & 1 as odd, b.h as sibling
  from placed p join (select distinct lang, level from low where n > 1) l on l.lang is not distinct from p.lang
  left join low b on b.lang is not distinct from p.lang and b.level = l.level and b.i = xor(p.i >> l.level, 1)
  union all
  select p.doc_id, p.lang, p.i, 1000 + l.level, (s.g >> l.level) & 1, b.h
  from placed p join subs s on s.lang is not distinct from p.lang cross join (select distinct level from high where n > 1) l
  left join high b on b.level = l.level and b.i = xor(s.g >> l.level, 1)
), proof as (
  select lang, leaf_i, list(struct_pack(odd := odd, sibling := sibling) order by level) as path from steps group by all
), folding as (
  select p.lang, p.i, coalesce(f.path, []) as path, p.altered as h, 1 as pos from placed p left join proof f on f.lang is not distinct from p.lang and f.leaf_i = p.i
  union all
  select lang, i, path, sha256(case when path[pos].sibling is null then h when path[pos].odd = 1 then path[pos].sibling || h else h || path[pos].sibling end), pos + 1
  from folding where pos <= len(path)
), folded as (select lang, i, path, h as folded_root from folding where pos = len(path) + 1)
select p.doc_id, p.leaf, s.subroot, r.h as root,
       sha256(coalesce(array_to_string(list_transform(list_filter(f.path, lambda x: x.sibling is not null), lambda x: x.sibling), ''), '')) as proof_sha256,
       f.folded_root, f.folded_root = r.h as verified
from placed p join subs s on s.lang is not distinct from p.lang join folded f on f.lang is not distinct from p.lang and f.i = p.i
cross join (select h from high where n = 1) r
"""

SQL: dict[str, str] = {
    "op2_warc": OP2,
    "op6_decontamination": OP6,
    "op1_exact_dedup": OP1,
    "op9_near_dedup": OP9,
    "op11_resample": OP11,
    "op13_merkle": OP13,
}
