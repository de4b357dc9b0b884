"""DuckDB SQL with the answers of those queries of this subpackage that SQL can express."""

from __future__ import annotations

from bagframe.llm.decontaminate import WORD
from bagframe.llm.secrets import ALLOW, BASE, CANDIDATE, LIMITS, WINDOW

_SPACED = r"[^\x20\x09-\x0D]+"


def _low(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CONTAMINATION = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_low('text')}, {_q(WORD)}) as w from documents),
i as (select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all({_low('text')}, {_q(WORD)}) as w from benchmark),
s as (select item, w, least(10, len(w)) as l from i where len(w) > 0),
iw as (select distinct item, l, array_to_string(w[p:p + l - 1], ' ') as g from (select *, unnest(range(1, len(w) - l + 2)) as p from s)),
dw as (select r, l, p, array_to_string(w[p:p + l - 1], ' ') as g
       from (select r, w, l, unnest(range(1, len(w) - l + 2)) as p from d, (select distinct l from s))),
hit as (select dw.r, dw.p, dw.l, iw.item from dw join iw on dw.l = iw.l and dw.g = iw.g),
n as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + l)) as q from hit) group by r),
k as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (r) left join k using (r)"""

LINE_DEDUP = f"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select r, doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as p from d),
k as (select *, {_low("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l),
h as (select key, max(doc_id) as m from k where length(key) >= 20 and doc_id is not null group by key having count(distinct doc_id) >= 3),
j as (select k.r, k.p, k.line, coalesce(k.doc_id < h.m, false) as gone from k left join h using (key)),
g as (select r, count(*) as n, count(*) filter (gone) as x, string_agg(line, chr(10) order by p) filter (not gone) as t from j group by r)
select doc_id, cast(n as bigint) as n_lines, cast(x as bigint) as n_dropped, sha256(coalesce(t, '')) as kept_sha256 from d join g using (r)"""

MIX = f"""
with s as (select row_number() over () as r, doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), {_q(_SPACED)})) as bigint) as size,
                  md5(coalesce(cast(doc_id as varchar), '')) as h from documents),
t as (select source, cast(sum(size) as bigint) as ss from s group by source),
n as (select *, row_number() over (order by source nulls last) - 1 as no from t),
w as (select *, [5, 2, 1][no % 3 + 1] as w, 3 * ss as cap from n),
l as (select *, (sum(ss) over () - coalesce(sum(cap) over (order by ss / w, no rows between unbounded preceding and 1 preceding), 0))
                / sum(w) over (order by ss / w, no rows between current row and unbounded following) as lev, row_number() over (order by ss / w, no) as pl from w),
f as (select pl, lev from l where lev * w <= cap order by pl limit 1),
g as (select l.source, l.ss, least(cast(cap as double), case when l.pl >= f.pl then f.lev * w else cast(cap as double) end) as target from l left join f on true),
p as (select s.*, g.ss, g.target, cast(round(g.target) as bigint) as take,
             cast(coalesce(sum(size) over (partition by s.source order by h, doc_id, size, r rows between unbounded preceding and 1 preceding), 0) as bigint) as b
      from s join g on s.source is not distinct from g.source)
select doc_id, size, ss as source_size, cast(target as double) as target,
       cast(case when size = 0 then 0 else (take // ss) * size + greatest(0, least(b + size, take % ss) - b) end as bigint) as taken from p"""

QUALITY = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {_q(_SPACED)}) as w from documents),
l as (select r, line from (select r, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, {_q(_SPACED)})),
ld as (select r, count(*) as nl, count(*) - count(distinct line) as dup from l group by r),
g as (select r, p, array_to_string(w[p:p + 7], ' ') as g from (select r, w, unnest(range(1, len(w) - 6)) as p from d)),
rep as (select r, p from (select *, count(*) over (partition by r, g) as c from g) where c >= 2),
rw as (select r, count(distinct q) as n from (select r, unnest(range(p, p + 8)) as q from rep) group by r),
m as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) as bigint) as word_chars,
             cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(dup, 0) as bigint) as n_dup_lines,
             cast(coalesce(rw.n, 0) as bigint) as n_repeat_words, coalesce(nl, 0) as nl
      from d left join ld using (r) left join rw using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or word_chars < 2 * n_words or word_chars > 20 * n_words or n_symbols > n_words or 100 * n_dup_lines > 50 * nl) as kept
from b"""

JACCARD = f"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all({_low('text')}, {_q(_SPACED)}) as w from documents),
g as (select distinct r, array_to_string(w[p:p + 3], ' ') as g from (select r, w, unnest(range(1, greatest(len(w) - 2, 2))) as p from d where len(w) > 0)),
s as (select r, md5(string_agg(g, chr(10) order by g)) as sid, count(*) as n from g group by r),
u as (select sid, any_value(n) as n, min(r) as r from s group by sid),
x as (select u.sid, u.n, g.g from u join g using (r)),
e as (select a.sid as a, b.sid as b from x a join x b on a.g = b.g and a.sid <> b.sid where 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n
      group by a.sid, b.sid, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
c(a, b) as (select sid, sid from u union select c.a, e.b from c join e on c.b = e.a),
m as (select c.a as sid, min(d.doc_id) as component from c join s on s.sid = c.b join d using (r) group by c.a),
k as (select a as sid, count(*) as n_links from e group by a)
select d.doc_id, cast(coalesce(s.n, 0) as bigint) as n_shingles, case when s.sid is null then d.doc_id else component end as component_id,
       cast(coalesce(n_links, 0) as bigint) as n_links
from d left join s using (r) left join m using (sid) left join k using (sid)"""


COLLOCATIONS = f"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({_low('text')}, '[.,;:!?\\x0A-\\x0D]')) as t from documents),
w as (select lang, regexp_extract_all(t, '[^\\x20\\x09]+') as w from p),
f as (select lang, m, phrase, count(*) as a from (
        select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase from (
            select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from w, (select unnest([1, 2, 3, 4]) as m) where len(w) >= m))
      group by lang, m, phrase),
c as (select *, string_split(phrase, ' ') as ws from f where m >= 2 and a >= 30),
k as (select *, unnest(range(1, m)) as k from c),
x as (select k.lang, k.phrase, k.m, k.a, k.ws, k.k, l.a as l, r.a as r, (cast(2000000 as hugeint) * k.a) // (l.a + r.a) as score
      from k join f as l on l.lang = k.lang and l.phrase = array_to_string(k.ws[1:k.k], ' ') join f as r on r.lang = k.lang and r.phrase = array_to_string(k.ws[k.k + 1:k.m], ' ')),
b as (select *, row_number() over (partition by lang, phrase order by score, k) as cut from x),
h as (select lang, sub, max(a) as longer from (
        select lang, a, array_to_string(ws[i:i + n - 1], ' ') as sub from (
            select *, unnest(range(1, m - n + 2)) as i from c, (select unnest([2, 3]) as n) where m > n)) group by lang, sub),
s as (select b.* from b left join h on h.lang = b.lang and h.sub = b.phrase where cut = 1 and (longer is null or 100 * longer < 80 * a)),
t as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from s),
n as (select lang, cast(sum(a) as bigint) as n from f where m = 1 group by lang)
select t.lang, rank, phrase, a, l, r, n.n, cast(score as bigint) as score from t join n using (lang) where rank <= 2000"""


def _base_spans(kind: str, pattern: str, group: int, least: int) -> str:
    return f"""select r, '{kind}' as kind, e - n as s, e from (
        select r, n, k, sum(gap + n) over (partition by r order by i) as e from (
            select r, unnest(range(1, len(m) + 1)) as i, unnest(list_transform(m, lambda x: length(x))) as n, unnest(list_transform(q, lambda x: length(x))) as k,
                   unnest(list_transform(gaps[1:len(m)], lambda x: length(x))) as gap
            from (select r, regexp_extract_all(t, {_q(pattern)}, 0) as m, regexp_extract_all(t, {_q(pattern)}, {group}) as q, string_split_regex(t, {_q(pattern)}) as gaps from d)))
        where k >= {least}"""


SECRETS = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
b as ({' union all '.join(_base_spans(k, p, g, n) for k, p, g, n, _ in BASE)}),
c as (select r, str, e - length(str) as s, e from (
        select r, str, sum(gap + length(str)) over (partition by r order by i) as e from (
            select r, unnest(range(1, len(m) + 1)) as i, unnest(m) as str, unnest(list_transform(gaps[1:len(m)], lambda x: length(x))) as gap
            from (select r, regexp_extract_all(t, {_q(CANDIDATE)}) as m, string_split_regex(t, {_q(CANDIDATE)}) as gaps from d)))
      where not ({' or '.join(f'regexp_matches(str, {_q(p)})' for p in ALLOW)})),
f as (select * from c where not exists (select 1 from b where b.r = c.r and c.s < b.e and b.s < c.e)),
w as (select r, s, e, str, i, entropy(ch) as bits from (
        select r, s, e, str, i, unnest(string_split(substring(str, i, {WINDOW}), '')) as ch from (select *, unnest(range(1, length(str) - {WINDOW} + 2)) as i from f))
      group by r, s, e, str, i),
h as (select r, 'entropy' as kind, s, e from w group by r, s, e, str having max(bits) >=
      case when regexp_matches(str, '^[0-9a-f]+$') or regexp_matches(str, '^[0-9A-F]+$') then {LIMITS['hex']}
           when regexp_matches(str, '^[A-Za-z0-9]+$') then {LIMITS['alnum']} else {LIMITS['base64']} end),
o as (select r, kind, s, concat(kind, ':', cast(s as bigint), ':', cast(e as bigint)) as x, list_position(['assign', 'access', 'hex', 'entropy'], kind) as k
      from (select * from b union all select * from h)),
a as (select r, count(*) filter (kind = 'assign') as n1, count(*) filter (kind = 'access') as n2, count(*) filter (kind = 'hex') as n3,
             string_agg(x, ',' order by s, k) filter (kind <> 'entropy') as base, string_agg(x, ',' order by s, k) as spans from o group by r)
select doc_id, cast(coalesce(n1, 0) as bigint) as n_assign, cast(coalesce(n2, 0) as bigint) as n_access, cast(coalesce(n3, 0) as bigint) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (r)"""

SQL = {
    "op11_collocations": COLLOCATIONS,
    "op2_contamination": CONTAMINATION, "op5_line_dedup": LINE_DEDUP, "op6_secret_spans": SECRETS, "op7_source_mix": MIX,
    "op8_quality_cascade": QUALITY, "op10_jaccard_classes": JACCARD,
}
