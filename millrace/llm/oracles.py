"""SQL (DuckDB) of the corpus operators that SQL can express, for the queries' results over whole tables."""

from __future__ import annotations

from . import line_dedup, mixing, near_dedup, quality_rules

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SLOPES = "[" + ", ".join(f"[{a}::double, {b}::double]" for a, b in mixing.SLOPES) + "]"

MIXING = f"""
with s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as size, md5(coalesce(doc_id::varchar, '')) as draw from documents),
src as (select source, sum(size)::bigint as source_size from s group by source),
placed as (select *, ((row_number() over (order by source nulls last) - 1) % 3)::int as place from src),
weighed as (select *, ([5, 2, 1])[place + 1]::double as weight, ({mixing.MOST_REPEATS} * source_size)::double as cap from placed),
filled as (select *, sum(source_size) over () as total, coalesce(sum(cap) over before, 0) as capped, sum(weight) over () - coalesce(sum(weight) over before, 0) as free
           from weighed window before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
levels as (select *, (total - capped) / free as level from filled),
target as (select source, source_size, place, least(cap, coalesce((select max(level) from levels where level * weight <= cap), 0) * weight) as target from levels),
streams as (select s.doc_id, s.size, t.source_size, t.target, round(t.target)::bigint as goal, {_SLOPES}[t.place + 1] as ab,
            (sum(s.size) over (partition by s.source order by s.draw, s.doc_id) - s.size)::bigint as start from s join target t on s.source is not distinct from t.source),
taken as (select *, ({' + '.join(f'least(greatest(goal - {p} * source_size - start, 0), size)' for p in range(mixing.MOST_REPEATS))})::bigint as taken, start / greatest(goal, 1) as share from streams)
select doc_id, size::bigint as size, source_size, target, taken,
       case when taken > 0 then 2 * share / (ab[1] + sqrt(greatest(ab[1] * ab[1] + 2 * (ab[2] - ab[1]) * share, 0))) end as position from taken
"""

NEAR_DEDUP = f"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') as w from documents),
shingles as (select distinct doc_id, array_to_string(w[i:i + {near_dedup.WIDTH - 1}], ' ') as x from (select doc_id, w, unnest(range(1, greatest(len(w) - {near_dedup.WIDTH - 2}, 2))) as i from w where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= {near_dedup.PERCENT} * (x.n + y.n - k)),
edges as (select a, b from links union all select b, a from links),
reach as (with recursive r as (select doc_id as n, doc_id as l from sizes union select e.b, r.l from r join edges e on e.a = r.n) select n, min(l) as least from r group by n)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, coalesce(r.least, d.doc_id) as component_id, coalesce(r.least, d.doc_id) = d.doc_id as kept
from documents d left join sizes s using (doc_id) left join reach r on r.n = d.doc_id
"""

_MEASURES = {
    "symbol_rate": "1000 * n_symbols // greatest(n_words, 1)",
    "dup_line_rate": "1000 * n_dup_lines // greatest(n_lines, 1)",
    "repeat_rate": "1000 * n_repeat_words // greatest(n_words, 1)",
    "upper_rate": "1000 * n_upper // greatest(word_chars, 1)",
    "bang_rate": "1000 * n_bangs // greatest(n_words, 1)",
    "word_length": "1000 * word_chars // greatest(n_words, 1)",
}
_LEAST = " ".join(f"when '{m}' then {v}" for m, v in quality_rules.LEAST_SPREAD.items())


def _quantiles(keys: str) -> str:
    part = f"{keys}, m" if keys else "m"
    return f"""select {part}, max(total) as docs, min(bin) filter (4 * upto >= total) as q1, min(bin) filter (2 * upto >= total) as q2 from
        (select *, sum(n) over (partition by {part} order by bin) as upto, sum(n) over (partition by {part}) as total from (select {part}, bin, sum(n) as n from sketch group by all)) group by all"""


QUALITY_RULES = rf"""
with w as (select row_number() over () as row, doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
tokens as (select row, unnest(w) as t, generate_subscripts(w, 1) as i from w),
windows as (select row, i, t, lead(t) over (partition by row order by i) as t1, lead(t, 2) over (partition by row order by i) as t2 from tokens),
twice as (select row, i, t2 is not null and count(*) over (partition by row, t, t1, t2) > 1 as hit from windows),
covered as (select row, count(*) as n_repeat_words from (select row, hit or coalesce(lag(hit) over o, false) or coalesce(lag(hit, 2) over o, false) as c from twice window o as (partition by row order by i)) where c group by row),
counts as (select row, doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
           len(regexp_extract_all(text, '\p{{Lu}}')) as n_upper, len(regexp_extract_all(text, '!')) as n_bangs, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines from w),
base as (select c.*, coalesce(n_repeat_words, 0) as n_repeat_words, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
         n_words < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * n_words as base_failed from counts c left join covered v using (row)),
rates as (select row, lang, source, base_failed, unnest([{', '.join(f"{{'m': '{m}', 'v': ({sql})::bigint}}" for m, sql in _MEASURES.items())}]) as x from base),
sketch as (select lang, source, x.m as m, x.v - x.v % (1::bigint << greatest(length(bin(x.v)) - 5, 0)) as bin, count(*) as n from rates where not base_failed group by all),
own as ({_quantiles('lang, source')}), of_lang as ({_quantiles('lang')}), of_all as ({_quantiles('')}),
chosen as (select o.lang, o.source, o.m, case when o.docs >= {quality_rules.LEAST_DOCS} then o.q1 when l.docs >= {quality_rules.LEAST_DOCS} then l.q1 else a.q1 end as q1,
           case when o.docs >= {quality_rules.LEAST_DOCS} then o.q2 when l.docs >= {quality_rules.LEAST_DOCS} then l.q2 else a.q2 end as q2
           from own o join of_lang l on o.lang is not distinct from l.lang and o.m = l.m join of_all a on a.m = o.m),
limits as (select lang, source, m, q2 + {quality_rules.REACH} * greatest(q2 - q1, case m {_LEAST} end) as most from chosen),
verdict as (select r.row, bool_and(coalesce(x.v <= l.most, false)) as fine from rates r left join limits l on l.lang is not distinct from r.lang and l.source is not distinct from r.source and l.m = x.m group by r.row)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and fine as kept
from base join verdict using (row)
"""

SQL = {"op2_mixing": MIXING, "op4_near_dedup": NEAR_DEDUP, "op5_line_dedup": line_dedup.SQL, "op9_quality_rules": QUALITY_RULES}
