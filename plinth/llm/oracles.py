"""DuckDB SQL that gives the rows of some queries in another way."""

#: Windows are lists of words compared as texts; a word is hit if a window that contains it occurs.
DECONTAMINATION = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
lengths as (select distinct least(len(w), 13) as n from b where len(w) > 0),
item_windows as (
  select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as t
  from (select item_id, w, least(len(w), 13) as n, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
doc_windows as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as t
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from w, lengths where len(w) >= n)),
found as (select d.doc_id, d.n, d.i, x.item_id from doc_windows d join item_windows x on d.n = x.n and d.t = x.t),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names
  from (select distinct doc_id, item_id::varchar as item_id from found) group by doc_id)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w.w) as contaminated
from w left join hit using (doc_id) left join items using (doc_id)
"""

TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c as (select vec_id, i, x[i] as x from (select vec_id, x, unnest(range(1, len(x) + 1)) as i from v)),
s as (
  select q.vec_id as query_id, c.vec_id, sum(q.x * c.x)::bigint as score
  from c q join c on q.i = c.i and q.vec_id <> c.vec_id where q.vec_id % 50 = 0 group by 1, 2),
r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

#: Near copies from words themselves: a line with one word blanked at a place, or left out, equals another's.
LINE_DEDUP = r"""
with l as (
  select doc_id, no, trim(raw, ' ') as line
  from (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(0, len(string_split(text, chr(10))))) as no from documents)
  where trim(raw, ' ') <> ''),
c as (select line, min((doc_id, no)) as first from l group by line),
w as (select line, first, string_split(line, ' ') as w from c where len(string_split(line, ' ')) >= 8),
v as (select line, first, w, unnest(range(1, len(w) + 1)) as i from w),
swap as (select first, md5(array_to_string(w[:i - 1], ' ') || ' | ' || array_to_string(w[i + 1:], ' ') || ' | ' || len(w) || ' ' || i) as k from v),
gap as (select line, first, md5(array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ')) as k from v),
own as (select line, first, md5(line) as k from w),
near as (
  select first from (select first, min(first) over (partition by k) as low from swap) where low < first
  union
  select gap.first from gap join own on gap.k = own.k where own.first < gap.first
  union
  select own.first from gap join own on gap.k = own.k where gap.first < own.first),
judged as (
  select l.doc_id, l.no, l.line, (l.doc_id, l.no) = c.first as is_first, near.first is not null as is_near
  from l join c on l.line = c.line left join near on near.first = c.first),
per as (
  select doc_id, count(*) as n_lines, count(*) filter (where is_near or not is_first) as n_removed, count(*) filter (where is_near and is_first) as n_near from judged group by doc_id),
kept as (
  select doc_id, string_agg(raw, chr(10) order by no) as text
  from (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(0, len(string_split(text, chr(10))))) as no from documents) r
  left join judged j using (doc_id, no)
  where j.line is null or (j.is_first and not j.is_near)
  group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_near, 0)::bigint as n_near, sha256(coalesce(kept.text, '')) as kept_sha256
from documents d left join per using (doc_id) left join kept using (doc_id)
"""

#: The three levels one after another: each group's counts on top of its parent's posterior mean, with a strength fitted by moments.
URL_FILTER = r"""
with u as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
j as (select doc_id, max(greatest((quality = 0)::int, (toxic = 1)::int)) as bad from labels group by doc_id),
p as (
  select page_id, host, path, j.bad,
    case when regexp_matches(host, '(^|\.)(ac|co|com|edu|gov|net|org)\.[a-z][a-z]$') then array_to_string(string_split(host, '.')[-2:], '.') else string_split(host, '.')[-1] end as suffix
  from u left join j on try_cast(nullif(regexp_extract(path, '^/[^/]+/([0-9]{1,18})(?:[./]|$)', 1), '') as bigint) = j.doc_id),
q as (
  select *, case when regexp_matches(host, '^[0-9.:\[\]]+$') then host else array_to_string(string_split(host, '.')[-(len(string_split(suffix, '.')) + 1):], '.') end as domain from p),
h as (select host, domain, suffix, coalesce(sum(bad), 0)::double as k, count(bad)::double as n from q group by all),
d as (select domain, suffix, sum(k) as k, sum(n) as n from h group by all),
x as (select suffix, sum(k) as k, sum(n) as n, (sum(sum(k)) over () + 0.5) / (sum(sum(n)) over () + 1) as mean from d group by suffix),
xs as (select least(1000, greatest(1, 1 / greatest(coalesce(sum(n * (k / n - mean) ** 2 - mean * (1 - mean)) filter (n > 1) / nullif(sum((n - 1) * mean * (1 - mean)) filter (n > 1), 0), 0), 1e-9) - 1)) as s from x),
d2 as (select d.*, (x.mean * s + x.k) / (s + x.n) as mean from d join x using (suffix), xs),
ds as (select least(1000, greatest(1, 1 / greatest(coalesce(sum(n * (k / n - mean) ** 2 - mean * (1 - mean)) filter (n > 1) / nullif(sum((n - 1) * mean * (1 - mean)) filter (n > 1), 0), 0), 1e-9) - 1)) as s from d2),
h2 as (select h.*, (d2.mean * s + d2.k) / (s + d2.n) as mean from h join d2 using (domain, suffix), ds),
hs as (select least(1000, greatest(1, 1 / greatest(coalesce(sum(n * (k / n - mean) ** 2 - mean * (1 - mean)) filter (n > 1) / nullif(sum((n - 1) * mean * (1 - mean)) filter (n > 1), 0), 0), 1e-9) - 1)) as s from h2),
post as (select host, (mean * s + k) / (s + n) as m, s + n as total from h2, hs),
r as (
  select page_id, host, path, m - 1.645 * sqrt(m * (1 - m) / (total + 1)) > 0.5 as bad,
    case when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
      when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
      when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
      when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
      when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from q join post using (host))
select page_id, host, path, rule, case when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null then 'block' when bad then 'block' else 'allow' end as verdict from r
"""

#: CRC-32 of a list of bytes by its table of 256, which the polynomial gives.
CRC_TABLE = """
crc as (
  select list(v order by i) as t
  from (select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as v from range(256) r(i)))"""
CRC = "xor(list_reduce({bytes}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"

#: Each tree as lists, level by level; a leaf's siblings are looked up in them, and its root is folded from the strings L.., R.. or N (no sibling).
MERKLE = f"""
with recursive {CRC_TABLE},
told as (
  select *, case when {CRC.format(bytes="list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)")} % 7 = 0 then n_chars + 1 else n_chars end as other from documents, crc),
leaves as (select doc_id, lang, sha256(concat({{0}}, {{1}}, {{2}}, {{3}}, {{4}})) as leaf, sha256(concat({{0}}, {{1}}, {{2}}, {{5}}, {{4}})) as told from told),
l as (select *, row_number() over (partition by lang order by doc_id nulls last, leaf) - 1 as pos from leaves),
low as (
  select lang, 0 as level, list(leaf order by pos) as x from l group by lang
  union all
  select lang, level + 1, list_transform(range(0, (len(x) + 1) // 2), lambda i: sha256(x[2 * i + 1] || coalesce(x[2 * i + 2], ''))) from low where len(x) > 1),
tops as (select lang, x[1] as subroot, row_number() over (order by lang nulls first) - 1 as pos from low where len(x) = 1),
high as (
  select 0 as level, list(subroot order by pos) as x from tops
  union all
  select level + 1, list_transform(range(0, (len(x) + 1) // 2), lambda i: sha256(x[2 * i + 1] || coalesce(x[2 * i + 2], ''))) from high where len(x) > 1),
step as (
  select l.lang, l.pos, level, 0 as part, l.pos >> level as k, x from l join low on l.lang is not distinct from low.lang and len(x) > 1
  union all
  select l.lang, l.pos, level, 1 as part, tops.pos >> level as k, x from l join tops on l.lang is not distinct from tops.lang, high where len(x) > 1),
proof as (
  select lang, pos, list(coalesce(case when k & 1 = 1 then 'L' || x[k] else 'R' || x[k + 2] end, 'N') order by part, level) as s from step group by lang, pos),
found as (
  select l.doc_id, leaf, subroot, (select x[1] from high where len(x) = 1) as root, told, coalesce(s, []) as s
  from l join tops on l.lang is not distinct from tops.lang left join proof on l.lang is not distinct from proof.lang and l.pos = proof.pos)
select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(s, lambda e: e[2:]), ''), '')) as proof_sha256,
  list_reduce(s, lambda a, e: sha256(case when e[1] = 'L' then e[2:] || a when e[1] = 'R' then a || e[2:] else a end), told) as folded_root,
  list_reduce(s, lambda a, e: sha256(case when e[1] = 'L' then e[2:] || a when e[1] = 'R' then a || e[2:] else a end), told) = root as verified
from found
""".format(*[f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text", "other")])

#: Neighbours from words with a letter left out: equal at the same place, or equal to a whole word.
SPELLING = f"""
with recursive {CRC_TABLE},
r as (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents)),
d as (select doc_id, run, count(*) as n from r group by all),
h as (
  select run, n, {CRC.format(bytes="list_transform(range(0, strlen(s)), lambda i: ('0x' || hex(encode(s))[2 * i + 1 : 2 * i + 2])::bigint)")} as h
  from (select *, coalesce(doc_id::varchar, '') || ':' || run as s from d), crc),
w as (
  select word, sum(n)::bigint as n
  from (select case when h % 97 = 0 then run[: (h % length(run))::bigint] || run[(h % length(run))::bigint + 2 :] else run end as word, n from h)
  where length(word) >= 5 group by word having sum(n) >= 3),
gap as (select word, i, word[: i - 1] || word[i + 1 :] as k from (select word, unnest(range(1, length(word) + 1)) as i from w)),
near as (
  select a.word, b.word as other from gap a join gap b on a.k = b.k and a.i = b.i and a.word <> b.word
  union
  select a.word, w.word from gap a join w on a.k = w.word
  union
  select w.word, a.word from gap a join w on a.k = w.word),
best as (
  select near.word, count(*) as n_near, min((-w.n, near.other)) as best from near join w on near.other = w.word group by near.word),
f as (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when -best[1] >= 2 * w.n then best[2] end as form, case when -best[1] >= 2 * w.n then (-best[1])::bigint end as form_n
  from w left join best using (word)),
walk as (
  select word, word as at, form as next from f
  union all
  select walk.word, f.word, f.form from walk join f on walk.next = f.word)
select f.word, f.form, walk.at as root, f.n, f.n_near, f.form_n from f join walk on f.word = walk.word and walk.next is null
"""

#: Every window as a text; a word goes if a window over it is not the first of its text.
REPEATS = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
v as (select doc_id, i, array_to_string(w[i : i + 19], ' ') as t from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from w where len(w) >= 20)),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by t order by doc_id nulls last, i) as k from v) where k > 1),
gone as (select doc_id, list(distinct p) as gone from (select doc_id, unnest(range(i, i + 20)) as p from late) group by doc_id),
kept as (
  select doc_id, string_agg(word, ' ' order by i) as text, count(*) as n
  from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i, w from w) x
  where not exists (select 1 from (select doc_id, unnest(gone) as p from gone) g where g.doc_id = x.doc_id and g.p = x.i)
  group by doc_id)
select w.doc_id, len(w.w)::bigint as n_words, (len(w.w) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from w left join kept using (doc_id)
"""
