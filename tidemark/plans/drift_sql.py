"""Problem 6 in SQL, for the check: versions, their fields, renames, ingestion and replay."""

from __future__ import annotations

from tidemark.operators.drift import AGREE, DISAGREE, FORMER_KEYWORDS, LEAST_RECORDS

_FORMER = ", ".join(f"""p->>'$."{k}"'""" for k in FORMER_KEYWORDS)


def _fits(v: str, kind: str) -> str:
    fmt, base = f"split_part({kind}, '/', 2)", f"split_part({kind}, '/', 1)"
    return rf"""({v} is null or case {base}
      when 'integer' then regexp_matches({v}, '^\s*[+-]?\d+\s*$') and try_cast({v} as bigint) is not null
      when 'number' then regexp_matches({v}, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$')
      when 'boolean' then lower(trim({v})) in ('true', 'false')
      when 'array' then regexp_matches({v}, '^\s*\[') when 'object' then regexp_matches({v}, '^\s*\{{')
      when 'string' then case {fmt} when 'date' then regexp_matches({v}, '^\d{{4}}-\d{{2}}-\d{{2}}$') and try_cast({v} as date) is not null
        when 'date-time' then regexp_matches({v}, '^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}') and try_cast({v} as timestamptz) is not null
        when 'uuid' then regexp_matches({v}, '^[0-9A-Fa-f]{{8}}(-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}$') else true end
      else true end)"""


#: f: the fields of each contract version; m: the members of each well-formed line.
_BASE = rf"""
with once as (
  select * from contracts where contract_id is not null and version is not null
  qualify row_number() over (partition by contract_id, version order by published_at, schema_json) = 1
), steps as (
  select *, row_number() over (partition by contract_id order by published_at, version) - 1 as step,
    case when len(primary_keys) > 0 then primary_keys else business_keys end as keys from once
), named as (
  select contract_id, version, step, keys, unnest(json_keys(schema_json, '$.properties')) as field, generate_subscripts(json_keys(schema_json, '$.properties'), 1) as pos, schema_json from steps
), props as (select *, json_extract(schema_json, '$.properties."' || field || '"') as p from named),
f as (
  select contract_id, version, step, keys, field, pos,
    case when json_type(p, '$.type') = 'ARRAY' then array_to_string(list_sort(list_distinct(list_filter(from_json(json_extract(p, '$.type'), '["VARCHAR"]'), lambda x: x <> 'null'))), '|') else coalesce(nullif(p->>'$.type', 'null'), '') end
      || case when coalesce(p->>'$.format', '') <> '' then '/' || (p->>'$.format') else '' end as kind,
    lower(trim(regexp_replace(coalesce(nullif(p->>'$.description', ''), p->>'$.title', ''), '[\s.]+', ' ', 'g'))) as described,
    coalesce({_FORMER}, nullif(regexp_extract(coalesce(p->>'$."$comment"', ''), '(?i)\b(?:called|named|formerly|was|renamed from)\s+[`''"]?([A-Za-z_][A-Za-z0-9_]*)', 1), '')) as former
  from props
), files as (select contract_id, file_id, max(version) as v, min(landed_at) as landed from landed_rows group by 1, 2),
in_force as (
  select x.contract_id, x.file_id, arg_max(s.version, (s.published_at, s.version)) as v from files x join steps s on s.contract_id = x.contract_id and s.published_at <= x.landed where x.v is null group by 1, 2
), l as (
  select r.contract_id, r.file_id, r.line_in_file, coalesce(r.version, x.v, i.v) as version, r.payload, r.j,
    coalesce(json_type(r.j) = 'OBJECT' and len(json_keys(r.j)) = len(list_distinct(json_keys(r.j))), false) as ok
  from (select *, try_cast(payload as json) as j from landed_rows) r left join files x using (contract_id, file_id) left join in_force i using (contract_id, file_id)
), km as (select contract_id, file_id, line_in_file, version, j, unnest(json_keys(j)) as field, generate_subscripts(json_keys(j), 1) as nth from l where ok),
m as (
  select k.contract_id, k.file_id, k.line_in_file, k.version, k.field, k.nth, k.j, json_extract_string(k.j, '$."' || k.field || '"') as value, f.field is not null as declared, f.kind
  from km k left join f on f.contract_id = k.contract_id and f.version = k.version and f.field = k.field
)
"""

#: renames: what each step calls otherwise; changes: the whole report.
_CHANGES = _BASE + rf""", moved as (
  select n.contract_id, n.version, n.step, n.keys, o.field as old_field, n.field, o.kind as old_kind, n.kind, o.described as od, n.described as nd, n.former, o.pos as opos, n.pos as npos,
    (select count(*) from f b where b.contract_id = o.contract_id and b.step = o.step and b.pos < o.pos and exists (select 1 from f x where x.contract_id = n.contract_id and x.step = n.step and x.field = b.field))
    = (select count(*) from f b where b.contract_id = n.contract_id and b.step = n.step and b.pos < n.pos and exists (select 1 from f x where x.contract_id = o.contract_id and x.step = o.step and x.field = b.field)) as same_place
  from f n join f o on o.contract_id = n.contract_id and o.step = n.step - 1
  where not exists (select 1 from f x where x.contract_id = n.contract_id and x.step = n.step - 1 and x.field = n.field)
    and not exists (select 1 from f x where x.contract_id = o.contract_id and x.step = o.step + 1 and x.field = o.field)
), possible as (
  select * from moved where coalesce(former = old_field, false) or (former is null and not (od <> '' and nd <> '' and od <> nd) and (old_kind = kind or (od <> '' and od = nd)))
), keyed as (select distinct contract_id, keys from f),
v as (
  select m.contract_id, m.field, array_to_string(list_transform(k.keys, lambda x: coalesce(json_extract_string(m.j, '$."' || x || '"'), '')), chr(1)) as record,
    lower(regexp_replace(m.value, '[\[\]"\s]', '', 'g')) as bare
  from m join keyed k using (contract_id) where m.value is not null
), plain as (select contract_id, field, record, case when try_cast(bare as double) is not null then cast(floor(try_cast(bare as double)) as varchar) else bare end as t from v where bare <> '' and record <> ''),
sides as (select contract_id, field, record, min(t) as lo, max(t) as hi from plain group by 1, 2, 3),
agreed as (
  select p.contract_id, p.version, p.old_field, p.field, count(*) as n, count(*) filter (a.lo in (b.lo, b.hi) or a.hi in (b.lo, b.hi)) as eq
  from possible p join sides a on a.contract_id = p.contract_id and a.field = p.old_field join sides b on b.contract_id = p.contract_id and b.field = p.field and b.record = a.record group by 1, 2, 3, 4
), scored as (
  select p.*, eq / n as share, case when coalesce(former = p.old_field, false) then 100 when od <> '' and od = nd then 60
    when n >= {LEAST_RECORDS} then case when eq / n >= {AGREE} then 40 when eq / n <= {DISAGREE} then 0 when same_place then 15 else 0 end when same_place then 20 else 0 end as score
  from possible p left join agreed using (contract_id, version, old_field, field)
), ranked as (
  select *, row_number() over (partition by contract_id, version, old_field order by score desc, coalesce(share, 0) desc, not same_place, abs(opos - npos), opos, npos) as ro,
    row_number() over (partition by contract_id, version, field order by score desc, coalesce(share, 0) desc, not same_place, abs(opos - npos), opos, npos) as rn
  from scored where score > 0
), renames as (select contract_id, version, step, old_field, field from ranked where ro = 1 and rn = 1),
changes as (
  select contract_id, version, 'renamed' as change, field, old_field from renames
  union all
  select n.contract_id, n.version, 'added', n.field, '' from f n where n.step > 0
    and not exists (select 1 from f o where o.contract_id = n.contract_id and o.step = n.step - 1 and o.field = n.field) and not exists (select 1 from renames r where r.contract_id = n.contract_id and r.version = n.version and r.field = n.field)
  union all
  select o.contract_id, s.version, 'removed', o.field, '' from f o join steps s on s.contract_id = o.contract_id and s.step = o.step + 1
    where not exists (select 1 from f n where n.contract_id = o.contract_id and n.step = o.step + 1 and n.field = o.field) and not exists (select 1 from renames r where r.contract_id = o.contract_id and r.version = s.version and r.old_field = o.field)
  union all
  select n.contract_id, n.version, 'retyped', n.field, '' from f n left join renames r on r.contract_id = n.contract_id and r.version = n.version and r.field = n.field
    join f o on o.contract_id = n.contract_id and o.step = n.step - 1 and o.field = coalesce(r.old_field, n.field) where o.kind <> n.kind
)
"""

_UNDECLARED = "select distinct contract_id, version, file_id, 'undeclared' as change, field, '' as old_field from m where not declared"

#: names: what each version's fields are called now; e: where each member of a line ends up.
_REPLAYED = _CHANGES.replace("with once as", "with recursive once as", 1) + f""", last as (select contract_id, max(step) as step from steps group by 1),
walk as (
  select contract_id, version, step as origin, field, field as current, step as reached from f
  union all
  select w.contract_id, w.version, w.origin, w.field, coalesce(r.field, w.current), w.reached + 1 from walk w join last t on t.contract_id = w.contract_id and w.reached < t.step
    left join renames r on r.contract_id = w.contract_id and r.step = w.reached + 1 and r.old_field = w.current
), names as (select w.contract_id, w.version, w.field, w.current from walk w join last t on t.contract_id = w.contract_id and w.reached = t.step),
now as (select f.contract_id, f.field, f.kind from f join last t on t.contract_id = f.contract_id and t.step = f.step),
placed as (
  select m.*, case when declared and {_fits('m.value', 'm.kind')} then 0 when declared then 2 else 1 end as place, coalesce(a.kind, b.kind) as now_kind, n.current
  from m left join names n on n.contract_id = m.contract_id and n.version = m.version and n.field = m.field
    left join now a on a.contract_id = n.contract_id and a.field = n.current left join now b on b.contract_id = m.contract_id and b.field = m.field
), e as (select *, place = 0 or (now_kind is not null and {_fits('value', 'now_kind')}) as typed, coalesce(current, field) as name from placed),
shown as (
  select *, typed and (name = field or not exists (select 1 from e x where x.contract_id = e.contract_id and x.file_id = e.file_id and x.line_in_file = e.line_in_file and x.typed and x.field = e.name)) as kept from e
)
"""
_TEXT = "to_json({0})::varchar || ':' || coalesce(to_json(value)::varchar, 'null')"

ORACLE = {
    "p6_found": _CHANGES + "select contract_id, version, 0::bigint as file_id, change, field, old_field from changes union all " + _UNDECLARED,
    "p6_undeclared": _BASE + _UNDECLARED,
    "p6_rescued_counts": _BASE + """, u as (select contract_id, count(distinct (file_id, line_in_file)) as n from m where not declared group by 1)
        select l.contract_id, count(*) as n_lines, count(*) filter (not ok) as n_malformed, coalesce(max(u.n), 0) as n_undeclared from l left join u using (contract_id) group by 1""",
    "p6_consistent": _REPLAYED + f""", texts as (
          select contract_id, file_id, line_in_file, '{{' || coalesce(string_agg({_TEXT.format('name')}, ',' order by name) filter (kept), '') || '}}' as row_json,
            '{{' || coalesce(string_agg({_TEXT.format('field')}, ',' order by place, nth) filter (not typed), '') || '}}' as rescued from shown group by 1, 2, 3)
        select l.contract_id, l.file_id, l.line_in_file, l.version as file_version, l.ok as well_formed, case when l.ok then coalesce(t.row_json, '{{}}') end as row_json, case when l.ok then coalesce(t.rescued, '{{}}') else l.payload end as rescued
        from l left join texts t using (contract_id, file_id, line_in_file)""",
    "p6_tables": _REPLAYED + f""", c as (
          select n.contract_id, n.field, n.kind, count(s.value) filter ({_fits('s.value', 'n.kind')}) as n_values
          from now n left join shown s on s.contract_id = n.contract_id and s.name = n.field and s.kept group by 1, 2, 3)
        select c.*, x.n_lines from c join (select contract_id, count(*) as n_lines from l group by 1) x using (contract_id)""",
}
