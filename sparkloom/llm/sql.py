"""The same results as DuckDB SQL, for the queries that SQL can express."""

from .secrets import EITHER

LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = r"""
with src as (select doc_id, text, md5(text) as tk from documents),
lines as (select doc_id, tk, string_split(text, chr(10)) as ls from src),
placed0 as (select doc_id, tk, ls, unnest(range(len(ls))) as pos from lines),
tok as (
  select doc_id, tk, pos, regexp_extract_all(ls[pos + 1], '[^\x20\x09-\x0D]+') as raw from placed0),
gen as (
  select doc_id, tk, pos, raw, list_transform(raw, lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) as tokens
  from tok where len(raw) >= 1),
keyed as (
  select doc_id, tk, pos, tokens, len(tokens) as n, array_to_string(tokens[1:3], ' ') as lead,
    array_to_string(case when len(raw) < 3 then raw else tokens end, ' ') as t
  from gen),
kinds as (select t, any_value(n) as n, any_value(lead) as lead, any_value(tokens) as tokens, count(distinct tk) as c from keyed group by t),
leaves as (select n, lead, sum(c) as every from kinds where n >= 3 group by n, lead having sum(c) >= 3 and count(*) > 1),
placed as (
  select t, n, lead, every, c, unnest(range(n)) as p, unnest(tokens) as token from kinds join leaves using (n, lead)),
common as (
  select n, lead, p, token from placed where token <> '<*>' group by n, lead, p, token, every having sum(c) >= 3 and sum(c) >= 0.2::double * every),
shown as (
  select a.t, a.n, a.p, case when c.token is not null then a.token else '<*>' end as s
  from placed a left join common c on a.n = c.n and a.lead = c.lead and a.p = c.p and a.token = c.token),
forms as (
  select t, '<*> ' || n || ' ' || string_agg(s, ' ' order by p) as form
  from shown group by t, n having count(*) filter (s <> '<*>') >= 0.6 * n),
again as (select form from keyed join forms using (t) group by form having count(distinct tk) >= 3),
own as (select t from kinds where c >= case when n >= 20 then 2 else 3 end),
names as (
  select coalesce(o.t, f.t) as t, coalesce(f.form, o.t) as name
  from own o full join (select t, form from forms where form in (select form from again)) f on o.t = f.t),
hits as (select k.doc_id, k.tk, k.pos, n.name as t from keyed k join names n on k.t = n.t),
ranked as (select *, rank() over (partition by t order by doc_id nulls last, tk, pos) as r from hits),
gone as (select distinct doc_id, tk, pos from ranked where r > 1),
per as (select doc_id, tk, list(pos) as gone from gone group by doc_id, tk)
select s.doc_id, coalesce(len(string_split(s.text, chr(10))), 0)::bigint as n_lines,
  coalesce(len(p.gone), 0)::bigint as n_dropped,
  sha256(coalesce(case when p.gone is null then s.text else array_to_string(
    list_transform(list_filter(range(len(string_split(s.text, chr(10)))), lambda i: not list_contains(p.gone, i)),
      lambda i: string_split(s.text, chr(10))[i + 1]), chr(10)) end, '')) as kept_sha256
from src s left join per p on s.doc_id is not distinct from p.doc_id and s.tk is not distinct from p.tk
"""

DECONTAMINATE = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
b as (select coalesce(item_id::varchar, '') as item, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item, least(len(w), 10) as n,
    array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') as g
  from (select item, w, unnest(range(greatest(len(w) - 9, 1))) as i from b where len(w) > 0)),
sizes as (select distinct n from win),
grams as (
  select r, n, i, array_to_string(w[i + 1 : i + n], ' ') as g
  from (select r, w, n, unnest(range(len(w) - n + 1)) as i from d, sizes where len(w) >= n)),
met as (select g.r, g.n, g.i, x.item from grams g join win x on g.n = x.n and g.g = x.g),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from met) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from met) group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join items using (r)
"""

MIXING = r"""
with slim as (
  select row_number() over () as r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(concat_ws('|', '7', doc_id::varchar)) as d, md5(text) as tk
  from documents),
total as (select source, sum(size)::bigint as source_size from slim group by source),
weighed as (
  select *, ([5.0, 2.0, 1.0]::double[])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as w, source_size * 2.0::double as "full" from total),
leveled as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum("full") over (order by "full" / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
    / (sum(w) over () - coalesce(sum(w) over (order by "full" / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double)) as level
  from weighed),
goal as (
  select source, source_size, case when "full" / w <= level then "full" else max(case when not ("full" / w <= level) then level end) over () * w end as target,
    ('0x' || substr(md5(concat_ws('|', 'offset 7', source)), 1, 8))::bigint / 4294967296.0::double as u
  from leveled),
ranked as (select *, row_number() over (partition by source order by size, d, doc_id, tk)::double as rank from slim),
drawn as (
  select k.doc_id, k.size, g.source_size, g.target, rank, u, case when g.source_size > 0 then g.target / g.source_size else 0.0::double end as rate
  from ranked k join goal g on k.source is not distinct from g.source)
select doc_id, size, source_size, target,
  size * least(floor(u + rate * rank) - floor(u + rate * (rank - 1)), 2)::bigint as taken
from drawn
"""

_ASSIGN = rf"""({EITHER})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _secret_kind(kind: str, place: int, pattern: str, least: str) -> str:
    """Matches of one kind with their places, by cutting the text at each match in turn."""
    return f"""
  select r, {place} as place, '{kind}' as kind, s as start, s + length(m) as stop from (
    select r, m, k, (list_sum([length(x) for x in parts[1:k]]) + coalesce(list_sum([length(x) for x in ms[1:k - 1]]), 0))::bigint as s
    from (select r, ms, parts, unnest(ms) as m, unnest(range(1, len(ms) + 1)) as k from (
      select r, regexp_extract_all(text, '{pattern}') as ms, regexp_split_to_array(text, '{pattern}') as parts from d)))
  where {least}"""


SECRETS = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
found as ({_secret_kind("assign", 0, _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6")}
  union all {_secret_kind("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20")}
  union all {_secret_kind("hex", 2, "[0-9a-f]+", "length(m) >= 24")}
  union all {_secret_kind("pem", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true")}),
per as (
  select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, place, stop) filter (kind <> 'pem') as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, place, stop) as spans
  from found group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join per using (r)
"""

REPAIR = r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i)) as t),
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint) as bytes
  from conversations),
kinds as (
  select conv_id, turn, role, text, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) % 20 as kind
  from keyed, crc),
rows as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case kind when 3 then 2 else 1 end)) as copy
  from kinds where kind <> 0),
placed as (
  select *, role[1] as i, row_number() over (partition by conv_id order by turn nulls first, role, md5(length(role) || ':' || role || text)) as rn,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again,
    not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as open_end
  from rows),
facts as (
  select *, case when blank then 'b' when again > 1 then 'd' when open_end then 't' else '' end as fault,
    lag(i) over (partition by conv_id order by rn) || i not in ('su', 'ua', 'au') as illegal
  from placed),
-- for each role that may come last the cheapest edits so far, (cost, audit, repaired); state is '', s, u or a
walk as (
  select conv_id, 0::bigint as rn, {'c': 0, 'a': '', 't': []::varchar[]} as z,
    null::struct(c integer, a varchar, t varchar[]) as s, null::struct(c integer, a varchar, t varchar[]) as u, null::struct(c integer, a varchar, t varchar[]) as a
  from (select distinct conv_id from facts)
  union all
  select conv_id, rn,
    {'c': z.c + 4, 'a': z.a || 'D', 't': z.t},
    list_sort([x for x in [
      {'c': s.c + 4, 'a': s.a || 'D', 't': s.t},
      {'c': z.c + own, 'a': case when i = 's' then z.a || 'K' end, 't': z.t || [role || ':' || text]}] if x.c is not null and x.a is not null])[1],
    list_sort([x for x in [
      {'c': u.c + 4, 'a': u.a || 'D', 't': u.t},
      {'c': z.c + own + rerole_u, 'a': z.a || edit_u, 't': z.t || [given_u]},
      {'c': s.c + own + rerole_u, 'a': s.a || edit_u, 't': s.t || [given_u]},
      {'c': a.c + own + rerole_u, 'a': a.a || edit_u, 't': a.t || [given_u]},
      {'c': u.c + own + rerole_u + 3, 'a': u.a || 'I' || edit_u, 't': u.t || ['assistant:', given_u]}] if x.c is not null and x.a is not null])[1],
    list_sort([x for x in [
      {'c': a.c + 4, 'a': a.a || 'D', 't': a.t},
      {'c': u.c + own + rerole_a, 'a': u.a || edit_a, 't': u.t || [given_a]},
      {'c': z.c + own + rerole_a + 3, 'a': z.a || 'I' || edit_a, 't': z.t || ['user:', given_a]},
      {'c': s.c + own + rerole_a + 3, 'a': s.a || 'I' || edit_a, 't': s.t || ['user:', given_a]},
      {'c': a.c + own + rerole_a + 3, 'a': a.a || 'I' || edit_a, 't': a.t || ['user:', given_a]}] if x.c is not null and x.a is not null])[1]
  from (
    select w.* exclude (rn), f.rn, f.i, f.role, f.text, case fault when 't' then 3 when '' then 0 end as own,
      case when f.i = 'u' then 0 else 3 end as rerole_u, case when f.i = 'a' then 0 else 3 end as rerole_a,
      case when f.i = 'u' then 'K' else 'R' end as edit_u, case when f.i = 'a' then 'K' else 'R' end as edit_a,
      case when f.i = 'u' then f.role else 'user' end || ':' || f.text as given_u, case when f.i = 'a' then f.role else 'assistant' end || ':' || f.text as given_a
    from walk w join facts f on w.conv_id is not distinct from f.conv_id and f.rn = w.rn + 1)),
ends as (
  select w.conv_id, list_sort([x for x in [z, a,
    {'c': u.c + 3, 'a': u.a || 'I', 't': u.t || ['assistant:']},
    {'c': s.c + 6, 'a': s.a || 'II', 't': s.t || ['user:', 'assistant:']}] if x.c is not null and x.a is not null])[1] as best
  from walk w join (select conv_id, max(rn) as rn from facts group by conv_id) l on w.conv_id is not distinct from l.conv_id and w.rn = l.rn),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'b') as blank,
    count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated, count(*) filter (illegal) as illegal
  from facts group by conv_id),
convs as (select distinct conv_id from conversations)
select v.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit,
  sha256(coalesce(array_to_string(best.t, chr(10)), '')) as repaired_sha256
from convs v left join counts c on v.conv_id is not distinct from c.conv_id left join ends e on v.conv_id is not distinct from e.conv_id
"""
