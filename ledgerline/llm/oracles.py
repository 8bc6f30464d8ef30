"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from ledgerline.llm import line_dedup as _lines

_OP1 = rf"""
with docs as (
  select doc_id d, coalesce(text, '') t, md5(coalesce(text, '')) tk, row_number() over () r from documents
), line as (
  select r, d, tk, unnest(string_split(t, chr(10))) x, generate_subscripts(string_split(t, chr(10)), 1) - 1 p from docs
), two as (
  select *, lead(x) over w y, ('0x' || substr(md5(x), 1, 8))::bigint h, lag(x) over w pb, lead(x, 2) over w pn from line window w as (partition by r order by p)
), rolled as (
  select *, case when y is not null then (h % {_lines.MODULUS} * {_lines.BASE} + lead(h) over w) % {_lines.MODULUS} end roll from two window w as (partition by r order by p)
), chosen as (
  select *, coalesce(roll <= lag(roll) over w, true) or coalesce(roll <= lead(roll) over w, true) sel from rolled where y is not null window w as (partition by r order by p)
), ranked as (
  select r, p, pb, pn, dense_rank() over w k, first_value(pb) over w fb, first_value(pn) over w fn from chosen where sel and (x <> '' or y <> '') window w as (partition by x, y order by d is null, d, tk, p)
), again as (
  select * from ranked where k > 1
), gone as (
  select r, p from again union select r, p + 1 from again union select r, p - 1 from again where pb = fb union select r, p + 2 from again where pn = fn
), seen as (
  select r, count(*) n from again group by r
)
select any_value(l.d) doc_id, count(*) n_lines, any_value(coalesce(n, 0))::bigint n_repeated_chunks, count(g.p) n_removed_lines, sha256(coalesce(string_agg(l.x, chr(10) order by l.p) filter (where g.p is null), '')) kept_sha256
from line l left join gone g on g.r = l.r and g.p = l.p left join seen s on s.r = l.r group by l.r
"""

_OP5 = r"""
with sized as (
  select doc_id, coalesce('s' || source, 'n') k, source, coalesce(doc_id::varchar, md5(coalesce(text, ''))) ident,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size
  from documents
), placed as (
  select *, coalesce(sum(size) over (partition by k order by md5(ident), ident, size rows between unbounded preceding and 1 preceding), 0) cum from sized
), src as (
  select k, source, sum(size) words from sized group by k, source
), ranked as (
  select k, words, (row_number() over (order by source nulls last) - 1) % 3 + 1 n from src
), weighed as (
  select k, words, [5.0, 2.0, 1.0][n]::double w, [-0.5, 0.0, 0.5][n]::double slope, words * 2.0::double cap from ranked
), level as (
  select *, (sum(words) over () * 1.5::double - coalesce(sum(cap) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0))
    / (sum(w) over () - coalesce(sum(w) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0)) lam from weighed
), common as (
  select min_by(lam, cap / w) lam from level where lam < cap / w
), target as (
  select k, words, slope, least(cap, coalesce((select lam from common) * w, cap))::double target, round(least(cap, coalesce((select lam from common) * w, cap)))::bigint goal from level
), taken as (
  select doc_id, size, words, target, slope, goal, cum,
    greatest(0, least(size, goal - cum)) w0, greatest(0, least(size, goal - words - cum)) w1
  from placed join target using (k)
), spot as (
  select *, least(1.0, (cum + w0 / 2.0) / greatest(goal, 1))::double u from taken
)
select doc_id, size, words::bigint source_size, target, (w0 + w1)::bigint taken,
  case when w0 + w1 > 0 then least(1.0, 2 * u / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * u)))::double end first_position
from spot
"""

_OP9 = r"""
with dw as (
  select row_number() over () r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents
), iw as (
  select item_id::varchar item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark
), win as (
  select distinct item, least(10, len(w)) n, w[j : j + least(10, len(w)) - 1] x
  from iw, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(j) where len(w) > 0
), lens as (select distinct n from win), grams as (
  select r, j, n, w[j : j + n - 1] x from dw, lens, unnest(range(1, len(w) - n + 2)) t(j) where len(w) >= n
), hit as (
  select r, j, grams.n, item from grams join win on grams.x = win.x and grams.n = win.n
), pos as (
  select r, count(distinct p) n_hit from (select r, unnest(range(j, j + n)) p from hit) group by r
), its as (
  select r, count(*) n_items, string_agg(item, ',' order by item) s from (select distinct r, item from hit where item is not null) group by r
)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join pos using (r) left join its using (r)
"""

ORACLES = {"op1_line_dedup": _OP1, "op5_mixing": _OP5, "op9_decontaminate": _OP9}
