"""SQL twins (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

from paceline.llm import urls

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicates_sql(width: int, percent: int, table: str = "documents") -> str:
    words = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+')"
    return rf"""
with recursive w as (
  select doc_id, {words} as w from {table} where text is not null),
s as materialized (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {width} then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - {width - 1} + 1), lambda i: array_to_string(w[i : i + {width - 1}], ' ')) end) as g
  from w),
n as materialized (select doc_id, count(*) as n from s group by 1),
e as materialized (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
l as materialized (
  select e.a, e.b from e join n x on x.doc_id = e.a join n y on y.doc_id = e.b
  where 100 * e.c >= {percent} * (x.n + y.n - e.c)),
r(doc_id, reached) as (
  select doc_id, doc_id from {table}
  union select r.doc_id, l.b from r join l on l.a = r.reached)
select r.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(reached) as component_id,
       r.doc_id = min(reached) as kept
from r left join n on n.doc_id = r.doc_id group by r.doc_id
"""


DECONTAMINATION = r"""
with dw as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bg as (
  select distinct item_id, k, g from (
    select item_id, least(len(w), 10) as k,
           unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) as g
    from bw where len(w) > 0)),
dg as (
  select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as g from (
    select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from dw, (select distinct k from bg) where len(w) >= k)),
m as materialized (select doc_id, item_id, dg.i, dg.k from dg join bg using (k, g)),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from m) group by 1),
t as (select doc_id, count(*) as n_items, array_to_string(list(item_id order by item_id), ',') as ids
      from (select distinct doc_id, cast(item_id as varchar) as item_id from m) group by 1)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from dw left join h on h.doc_id = dw.doc_id left join t on t.doc_id = dw.doc_id
"""

QUALITY = rf"""
with w as (
  select doc_id, coalesce(text, '') as t, {_WORDS} as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
g as materialized (
  select doc_id, i, array_to_string(w[i : i + 4], ' ') as g from (
    select doc_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) > 5)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g) where n > 1),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from again) group by 1),
m as (
  select w.doc_id, len(w)::bigint as n_words, coalesce(length(array_to_string(w, '')), 0)::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, len(l)::bigint as n_lines,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
  from w left join r on r.doc_id = w.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 10 * n_symbols > n_words
            or 100 * n_dup_lines > 30 * n_lines or word_chars < 2 * n_words or word_chars > 15 * n_words) as kept,
       ((n_words < 10)::bigint + 2 * (100 * n_repeat_words > 20 * n_words)::bigint
        + 4 * (10 * n_symbols > n_words)::bigint + 8 * (100 * n_dup_lines > 30 * n_lines)::bigint
        + 16 * (word_chars < 2 * n_words)::bigint + 32 * (word_chars > 15 * n_words)::bigint)::bigint as failed
from m
"""

def _terms(terms) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def url_filter_sql() -> str:
    """Rules as an ordered case list; a term stands by itself where a pattern with its borders matches."""
    ordered = sorted(urls.RULES, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: f"((host = '{r.host}' or host like '%.{r.host}') and starts_with(path, '{r.path}'))"
    rule = " ".join(f"when {fits(r)} then '{r.name}'" for r in ordered)
    ruled = " ".join(f"when {fits(r)} then '{'block' if r.block else 'allow'}'" for r in ordered)
    stands = "lambda t: regexp_matches(low, '(^|[^a-z0-9])' || t || '($|[^a-z0-9])')"
    weights = ", ".join(f"'{t}': {w}" for t, w in urls.SOFT.items())
    return rf"""
with u as (
  select page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
         case when contains(url, '://') then url[strpos(url, '://') + 3 :] else '' end as rest from pages),
p as (
  select page_id, low, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         len(list_filter({_terms(urls.STRICT)}, {stands})) as strict,
         coalesce(list_sum(list_transform(list_filter({_terms(t for t in urls.SOFT if t not in urls.STRICT)}, {stands}),
                  lambda t: map {{{weights}}}[t])), 0) as soft
  from u)
select page_id, host, path, case {rule} end as rule,
       coalesce(case {ruled} end, case when strict > 0 or soft >= {urls.ENOUGH} then 'block' else 'allow' end) as verdict
from p
"""


_BASE32 = "".join(
    f" || translate(lpad(to_base(('0x' || sha[{5 * k + 1}:{5 * k + 5}])::bigint, 32), 4, '0'),"
    " '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
    for k in range(8)
)

WARC = f"""
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha,
         max(page_id) over (partition by coalesce(html, '')) as top from pages)
select page_id, octet_length(encode(html))::bigint as payload_bytes, ''{_BASE32} as payload_digest,
       case when page_id = top then 'response' else 'revisit' end as record_type,
       case when page_id <> top then top end as refers_to
from p
"""

def _climbed(name: str, key: str) -> str:
    """Levels of trees: rows (key, level, pos, n, hash) from ``name``_0, each level from the one below."""
    return f"""
{name} as (
  select * from {name}_0
  union all
  select a.{key}, a.level + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.hash || coalesce(b.hash, ''))
  from {name} a left join {name} b on b.{key} = a.{key} and b.pos = a.pos + 1 where a.pos % 2 = 0 and a.n > 1)"""


_VALUE = "coalesce(octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text of up to 20 signs: bit by bit, the polynomial reversed."""
    step = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    byte = f"list_reduce(list_prepend(xor(c, s), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: {step})"
    signs = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {signs}), lambda c, s: {byte}), 4294967295)"


MERKLE = f"""
with recursive d as (
  select row_number() over () as row, doc_id, lang, {_leaf("n_chars")} as leaf,
         case when n_chars is not null and {_crc32("doc_id::varchar")} % 7 = 0 then {_leaf("(n_chars + 1)")} end as tampered
  from documents),
g as (select lang, row_number() over (order by encode(lang) nulls first) - 1 as tree, count(*) over () as trees from (select distinct lang from d)),
p as (
  select d.*, g.tree, g.trees, row_number() over (partition by g.tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g.tree) as n
  from d join g on d.lang is not distinct from g.lang),
t_0 as (select tree, 0 as level, pos, n, leaf as hash from p),{_climbed("t", "tree")},
s as (select tree, hash as subroot from t where n = 1),
u_0 as (select 0 as top, 0 as level, tree as pos, count(*) over () as n, subroot as hash from s),{_climbed("u", "top")},
way as (
  select p.row, t.level, t.hash, p.pos // (2 ** t.level)::bigint % 2 = 1 as before
  from p join t on t.tree = p.tree and t.pos = xor(p.pos // (2 ** t.level)::bigint, 1)
  union all
  select p.row, 1000 + u.level, u.hash, p.tree // (2 ** u.level)::bigint % 2 = 1
  from p join u on u.pos = xor(p.tree // (2 ** u.level)::bigint, 1)),
steps as (
  select p.row, lv.level, way.hash, way.before from p join (select tree, max(level) as top from t group by 1) h on h.tree = p.tree
  cross join (select max(level) as top from u) k
  cross join (select unnest(range(0, 64)) as i) x
  cross join lateral (select case when i < h.top then i when i - h.top < k.top then 1000 + i - h.top end as level) lv
  left join way on way.row = p.row and way.level = lv.level where lv.level is not null),
numbered as (select *, row_number() over (partition by row order by level) as nr, count(*) over (partition by row) as many from steps),
f as (
  select row, 0::bigint as nr, coalesce(tampered, leaf) as h from p
  union all
  select f.row, s.nr, sha256(case when s.hash is null then f.h when s.before then s.hash || f.h else f.h || s.hash end)
  from f join numbered s on s.row = f.row and s.nr = f.nr + 1),
last as (select row, arg_max(h, nr) as folded from f group by 1),
said as (select row, sha256(string_agg(hash, '' order by level)) as proof from way group by 1)
select doc_id, leaf, subroot, (select hash from u where n = 1) as root, coalesce(said.proof, sha256('')) as proof_sha256,
       folded as folded_root, folded = (select hash from u where n = 1) as verified
from p join s on s.tree = p.tree join last on last.row = p.row left join said on said.row = p.row
"""

COLLOCATIONS = r"""
with p as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(p, '[^\x20\x09]+') as w
  from (select lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) as p from documents)),
n as (select lang, sum(len(w))::bigint as n from p group by 1),
g as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from p, (select unnest(range(1, 5)) as k) where len(w) >= k),
f as materialized (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*)::bigint as a from g group by 1, 2, 3 having count(*) >= 30),
c as materialized (select lang, k, phrase, a, string_split(phrase, ' ') as w from f where k > 1),
cut as (
  select lang, phrase, a, j, array_to_string(w[1 : j], ' ') as x, array_to_string(w[j + 1 : k], ' ') as y
  from (select *, unnest(range(1, k)) as j from c)),
s as (
  select cut.lang, cut.phrase, x.a as l, y.a as r, (2000000::hugeint * cut.a // (x.a + y.a))::bigint as score,
         row_number() over (partition by cut.lang, cut.phrase order by 2000000::hugeint * cut.a // (x.a + y.a), j) as place
  from cut join f x on x.lang = cut.lang and x.phrase = cut.x join f y on y.lang = cut.lang and y.phrase = cut.y),
inner_parts as (
  select lang, array_to_string(w[i : i + m - 1], ' ') as phrase, max(a) as more
  from (select lang, w, a, m, unnest(range(1, k - m + 2)) as i from c, (select unnest(range(2, 4)) as m) where k > m) group by 1, 2),
kept as (
  select c.lang, c.phrase, c.a, s.l, s.r, s.score
  from c join s on s.lang = c.lang and s.phrase = c.phrase and s.place = 1
  left join inner_parts i on i.lang = c.lang and i.phrase = c.phrase
  where i.more is null or 100 * i.more < 80 * c.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select ranked.lang, rank, phrase, a, l, r, n, score from ranked join n on n.lang = ranked.lang where rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op3_near_duplicates": near_duplicates_sql(2, 80),
    "op4_warc": WARC,
    "op6_url_filter": url_filter_sql(),
    "op9_decontamination": DECONTAMINATION,
    "op10_quality_rules": QUALITY,
    "op11_merkle_manifest": MERKLE,
    "op12_collocations": COLLOCATIONS,
}
