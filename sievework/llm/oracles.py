"""DuckDB SQL of the operators' queries."""

from __future__ import annotations

import re

from sievework.llm import decontam, licenses

ORACLES: dict[str, str] = {}

# all words of three copies, sorted globally by finish time and cut at the budget
ORACLES["op8_source_mix"] = r"""
with d as (
  select doc_id, source, coalesce(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'a', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0)::bigint as size,
         md5(concat_ws('|', 'mix', doc_id::varchar)) as k
  from documents),
per as (select source, sum(size)::bigint as source_size from d group by source),
ranked as (select *, row_number() over (order by source nulls last) as rank, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from per),
leveled as (select *, source_size * 3 as cap, source_size * 3 / weight as full_at from ranked),
filled as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by full_at, source nulls last rows between unbounded preceding and 1 preceding), 0))
          / (sum(weight) over () - coalesce(sum(weight) over (order by full_at, source nulls last rows between unbounded preceding and 1 preceding), 0)) as share,
         row_number() over (order by full_at, source nulls last) as nth
  from leveled),
level as (select *, arg_min(share, nth) filter (where full_at > share) over () as level from filled),
target as (select source, source_size, rank, coalesce(case when full_at <= level then cap else weight * level end, cap)::double as target from level),
q as (
  select row_number() over () as rid, d.*, t.source_size, t.target, t.rank, (sum(size) over (partition by d.source order by k, doc_id, size rows unbounded preceding) - size)::bigint as begin
  from d join target t on d.source is not distinct from t.source),
word as (select rid, rank, (begin + copy * source_size + place)::double / target as finish from (select *, unnest(range(3)) as copy from q), unnest(range(1, size + 1)) u(place)),
served as (select rid from word order by finish, rank limit (select sum(size)::bigint from d)),
n as (select rid, count(*) as taken from served group by rid)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from q left join n on q.rid = n.rid
"""

ORACLES["op9_line_dedup"] = r"""
with l as (
  select doc_id, unnest(s) as line, generate_subscripts(s, 1) as i
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents)),
k as (select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
often as (select key, max(doc_id) as last from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.*, (o.key is not null and k.doc_id <> o.last) as gone from k left join often o on k.key = o.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def words_sql(text: str, pattern: str = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), {AZ}), '{pattern}')"


ORACLES["op1_warc_round_trip"] = """
with p as (select page_id, coalesce(html, '') as html from pages),
f as (select html, min(page_id) as first from p where strlen(html) >= 100 group by html)
select page_id, strlen(p.html)::bigint as payload_bytes, sha256(p.html) as payload_digest,
       case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
       case when first is not null and page_id is distinct from first then first end as refers_to
from p left join f on p.html = f.html
"""


def _template_rows() -> str:
    rows = [(label, text, "true") for text, label in licenses.BASE.items()] + [(label, text, "false") for label, text in licenses.NOTICES]
    bare = [(label, " ".join(re.findall("[a-z0-9]+", text.lower())), base) for label, text, base in rows]
    return ", ".join(f"({i}, '{label}', '{text}', {base})" for i, (label, text, base) in enumerate(bare))


ORACLES["op2_license_scan"] = f"""
with t as (select tid, label, base, w, least(3, len(w)) as k from (select tid, label, base, string_split(text, ' ') as w from (values {_template_rows()}) v(tid, label, text, base))),
g as (select tid, label, base, k, len(w) - k + 1 as n_grams, s as tpos, array_to_string(w[s + 1:s + k], ' ') as gram from (select *, unnest(range(len(w) - k + 1)) as s from t)),
d as (select doc_id, {words_sql('text')} as w from documents),
r as (select doc_id, pos, array_to_string(w[pos + 1:pos + k], ' ') as gram, k from (select doc_id, w, unnest(range(len(w))) as pos from d), (values (2), (3)) ks(k)),
v as (select doc_id, tid, label, base, n_grams, pos - tpos as diagonal, tpos from r join g on r.gram = g.gram and r.k = g.k group by all),
exact as (select doc_id, label, true as base, diagonal as first, 1.0::double as coverage from v where base group by doc_id, tid, label, n_grams, diagonal having count(distinct tpos) = n_grams),
o as (select *, tpos + diagonal as pos, case when diagonal - lag(diagonal) over (partition by doc_id, tid order by diagonal, tpos) <= {licenses.NEIGHBOUR} then 0 else 1 end as opens from v where not base),
s as (select *, sum(opens) over (partition by doc_id, tid order by diagonal, tpos rows unbounded preceding) as span from o),
s2 as (select *, floor((diagonal - min(diagonal) over (partition by doc_id, tid, span)) / n_grams) as part from s),
u as (select doc_id, tid, label, n_grams, span, part, tpos, min(pos) as pos from s2 group by all),
u2 as (select *, case when pos <= lag(pos) over (partition by doc_id, tid, span, part order by tpos) then 0 else 1 end as ordered from u),
m as (select doc_id, tid, label, n_grams, min(pos) as first, max(pos) as last, sum(ordered)::double / n_grams as coverage from u2 group by doc_id, tid, label, n_grams, span, part having sum(ordered)::double / n_grams >= {licenses.COVERAGE}),
i as (select *, case when first <= max(last + 2) over (partition by doc_id order by first, last, tid rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from m),
i2 as (select *, sum(opens) over (partition by doc_id order by first, last, tid rows unbounded preceding) as island from i),
loose as (select doc_id, label, false as base, first, coverage from (select *, row_number() over (partition by doc_id, island order by coverage desc, n_grams desc, label, first) as nth from i2) where nth = 1),
a as (select * from exact union all select * from loose),
p as (select doc_id, count(*) filter (where base) as n_base, min(first) filter (where base) as f, max(first) filter (where base) as l,
      string_agg(distinct label, ',' order by label) filter (where base) as bl, string_agg(distinct label, ',' order by label) as al, max(coverage) as score from a group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, f::bigint as first_word, l::bigint as last_word,
       coalesce(bl, '') as base_labels, coalesce(al, '') as labels, coalesce(score, 0.0)::double as score
from d left join p on d.doc_id = p.doc_id
"""

ORACLES["op7_decontamination"] = f"""
with i as (select item_id::varchar as item, {words_sql('text')} as w from benchmark),
win as (select distinct item, w[s:s + 9] as phrase from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as s from i where len(w) > 0)),
lens as (select distinct len(phrase) as n from win),
d as (select doc_id, {words_sql('text')} as w from documents),
g as (select doc_id, pos, n, w[pos:pos + n - 1] as phrase from (select doc_id, w, unnest(range(1, len(w) + 1)) as pos from d), lens where pos + n - 1 <= len(w)),
h as (select g.doc_id, g.pos, g.n, win.item from g join win on g.phrase = win.phrase),
c as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(pos, pos + n)) as place from h) group by doc_id),
p as (select doc_id, unnest(w) as term, generate_subscripts(w, 1) as pos from d),
ph as (select distinct phrase from win),
tc as (select term, count(*) as n from p group by term),
rk as (select phrase, len(phrase) as m, term, place, row_number() over (partition by phrase order by n, term, place) as rank
       from (select phrase, unnest(phrase) as term, generate_subscripts(phrase, 1) - 1 as place from ph) join tc using (term)),
st as (select p.doc_id, rk.phrase, rk.m, p.pos - rk.place as start from p join rk on p.term = rk.term and rk.rank = 1 where p.pos - rk.place >= 1),
nr as (select st.doc_id, st.phrase, st.start from st join rk on st.phrase = rk.phrase and rk.rank > 1
       join p on p.doc_id = st.doc_id and p.term = rk.term and abs(p.pos - st.start - rk.place) <= {decontam.SLOP}
       group by st.doc_id, st.phrase, st.m, st.start having count(distinct rk.rank) = st.m - 1),
ex as (select distinct g.doc_id, g.phrase from g join ph on g.phrase = ph.phrase),
near as (select doc_id, count(distinct phrase) as n_near from nr anti join ex on nr.doc_id = ex.doc_id and nr.phrase = ex.phrase group by doc_id),
t as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0)::bigint as n_near
from d left join near on d.doc_id = near.doc_id left join c on d.doc_id = c.doc_id left join t on d.doc_id = t.doc_id
"""

ORACLES["op10_near_duplicates"] = rf"""
with recursive d as (select doc_id, {words_sql('text', r'[^\x20\x09-\x0D]+')} as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as sh from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
e as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * shared >= 85 * (p.n + q.n - shared)),
edges as (select x, y from e union all select y, x from e),
reach(doc_id, comp) as (select doc_id, doc_id from n union select edges.y, reach.comp from reach join edges on edges.x = reach.doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(r.comp, d.doc_id) as component_id, d.doc_id = coalesce(r.comp, d.doc_id) as kept
from d left join n on n.doc_id = d.doc_id left join (select doc_id, min(comp) as comp from reach group by doc_id) r on r.doc_id = d.doc_id
"""

#: CRC32 (reflected, polynomial EDB88320) in SQL: its table, and the expression over a text and that table.
CRC_TABLE = """crc_step(i, k, v) as (select i::bigint, 0, i::bigint from range(256) r(i) union all select i, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from crc_step where k < 8),
crc_table as (select list(v order by i) as crc_tab from crc_step where k = 8)"""


def crc_sql(text: str) -> str:
    one = f"hex(encode({text}))"
    each = f"list_transform(range(1, length({one}) // 2 + 1), lambda i: ('0x' || substr({one}, (2 * i - 1)::bigint, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {each}), lambda a, b: xor(a // 256, crc_tab[(xor(a, b) % 256 + 1)::bigint])), 4294967295)"


ORACLES["op12_importance_sample"] = f"""
with recursive {CRC_TABLE},
d as (select row_number() over () as rid, doc_id, {words_sql('text')} as w from documents),
f as (select rid, unnest(w) as word from d), bf as (select unnest({words_sql('text')}) as word from benchmark),
v as (select distinct word from (select word from f union all select word from bf) x),
b as (select word, {crc_sql('word')} % 10000 as bucket from v, crc_table),
s as (select bucket, count(*) as n from f join b using (word) group by bucket), t as (select bucket, count(*) as n from bf join b using (word) group by bucket),
g as (select r.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double)))::bigint as gain
      from range(10000) r(bucket) left join s on s.bucket = r.bucket left join t on t.bucket = r.bucket),
wt as (select rid, sum(gain)::bigint as weight from f join b using (word) join g using (bucket) group by rid),
sc as (select d.rid, doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
       coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::varchar, '')), 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score
       from d left join wt on d.rid = wt.rid),
r as (select rid, row_number() over (order by score desc, doc_id nulls last) as nth, count(*) over () as n from sc where n_features >= 20)
select doc_id, n_features, weight, score, case when nth <= n * 10 // 100 then nth end::bigint as rank from sc left join r on sc.rid = r.rid
"""

_BARE = "rtrim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _add(best: str, letter: str, cost: str) -> str:
    return f"printf('%08d', left({best}, 8)::int + {cost}) || substr({best}, 9) || '{letter}'"


# the cheapest edits so far by what was output last (z: nothing, s, u, a), as a padded cost and the audit, so that texts compare
# as costs and then audits do
ORACLES["op11_conversation_repair"] = f"""
with recursive {CRC_TABLE},
r as (select row_number() over () as rid, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations, crc_table),
dmg as (select rid, copy, conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text
        from r, range(2) c(copy) where kind <> 0 and (copy = 0 or kind = 3)),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, rid, copy) as pos, row_number() over (partition by conv_id, role, text order by turn nulls first, rid, copy) as seen, {_BARE.format('text')} as bare from dmg),
x as (select conv_id, pos, turn, role, text, left(role, 1) as ini, bare = '' as blank, bare <> '' and seen > 1 as dup, bare <> '' and seen = 1 and right(bare, 1) not in ('.', '!', '?') as cut, lag(left(role, 1)) over (partition by conv_id order by pos) as before from o),
facts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (where blank) as blank, count(*) filter (where dup) as duplicate, count(*) filter (where cut) as truncated,
          count(*) filter (where before is not null and before || ini not in ('su', 'ua', 'au')) as illegal, max(pos) as n from x group by conv_id),
walk as (
  select distinct conv_id, 0::bigint as pos, '00000000' as z, null::varchar as s, null::varchar as u, null::varchar as a from x
  union all
  select conv_id, pos, {_add('z', 'D', '2')}, least({_add('s', 'D', '2')}, case when ok and ini = 's' then {_add('z', 'K', 'extra')} end),
         least({_add('u', 'D', '2')}, case when ok and ini = 'u' then {_add('least(z, s, a)', 'K', 'extra')} end, case when ok then {_add('least(z, s, a)', 'R', '(extra + 1)')} end),
         least({_add('a', 'D', '2')}, case when ok and ini = 'a' then {_add('u', 'K', 'extra')} end, case when ok then {_add('u', 'R', '(extra + 1)')} end)
  from (select conv_id, pos, ok, ini, extra, z, s, u, least(a, {_add('u', 'I', '5')}) as a
        from (select w.conv_id, x.pos, not x.blank and not x.dup as ok, x.ini, case when x.cut then 5 else 0 end as extra, z, s, a, least(u, {_add('least(z, s, a)', 'I', '5')}) as u
              from walk w join x on x.conv_id is not distinct from w.conv_id and x.pos = w.pos + 1) e) e2),
best as (select w.conv_id, least(z, a, {_add('u', 'I', '5')}, {_add("printf('%08d', left(s, 8)::int + 5) || substr(s, 9) || 'I'", 'I', '5')}) as b from walk w join facts f on w.conv_id is not distinct from f.conv_id and w.pos = f.n),
l as (select conv_id, substr(b, 9) as audit, unnest(range(1, length(b) - 7)) as j from best),
e as (select conv_id, audit[j] as letter, j, length(replace(left(audit, j), 'I', '')) as at_row, length(replace(left(audit, j), 'D', '')) as k from l),
kept as (select e.conv_id, letter, k, x.role, x.text, first_value(letter = 'K' and x.ini = 's') over (partition by e.conv_id order by k) as has_s from e left join x on x.conv_id is not distinct from e.conv_id and x.pos = e.at_row and letter <> 'I' where letter <> 'D'),
said as (select conv_id, string_agg(case when letter = 'K' then role when (k - case when has_s then 1 else 0 end) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end, chr(10) order by k) as t from kept group by conv_id),
every as (select distinct conv_id from conversations)
select every.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
       coalesce(left(b, 8)::bigint, 0)::bigint as cost, coalesce(substr(b, 9), '') as audit, sha256(coalesce(t, '')) as repaired_sha256
from every left join facts on facts.conv_id is not distinct from every.conv_id left join best on best.conv_id is not distinct from every.conv_id left join said on said.conv_id is not distinct from every.conv_id
"""
