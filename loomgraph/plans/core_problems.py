"""Queries of the general problems (drift, small files, orphan references) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import compaction, drift, orphans
from loomgraph.plans.registry import registry
from loomgraph.session import shared_folder
from loomgraph.tables import table

QUERIES, SQL, query = registry()

#: Values of a vector in the files.
VALUES = 12

_SPELLED = " ".join(f"when lower(regexp_replace(key, '[^A-Za-z0-9]', '', 'g')) = '{s}' then '{f}'" for s, f in drift.DriftRules().spelling_map().items())
_CHANGES_OF = """
with recs as (select distinct raw_id, series, file_no, file_name, payload from matcher_raw where json_valid(payload) and json_type(payload) = 'OBJECT'),
keyed as (select series, file_no, file_name, unnest(json_keys(payload)) as key, payload from recs),
vals as (select series, file_no, file_name, key, json_extract(payload, '$."' || key || '"') as v from keyed),
typed as (select *, {field} as field,
  nullif(nullif(nullif(regexp_replace(json_structure(v)::varchar, 'UBIGINT|BIGINT|HUGEINT', 'WHOLE', 'g'), '"NULL"'), '["NULL"]'), '[["NULL"]]') as kind from vals),
prof as (select series, file_no, min(file_name) as file_name, field, string_agg(distinct key, ',' order by key) as sp, string_agg(distinct kind, ',' order by kind) as ki
  from typed where field is not null group by series, file_no, field),
files as (select series, file_no, min(file_name) as file_name from recs group by series, file_no),
pairs as (select f.series, f.file_no, f.file_name from files f join files g on f.series = g.series and f.file_no = g.file_no + 1),
fields as (select distinct field from prof),
cmp as (select p.file_name, f.field, n.sp as s1, n.ki as k1, o.sp as s0, o.ki as k0 from pairs p cross join fields f
  left join prof n on n.series = p.series and n.file_no = p.file_no and n.field = f.field
  left join prof o on o.series = p.series and o.file_no = p.file_no - 1 and o.field = f.field)
select file_name, field as field_name, 'added' as change_kind from cmp where s0 is null and s1 is not null
union all select file_name, field, 'removed' from cmp where s1 is null and s0 is not null
union all select file_name, field, 'renamed' from cmp where s0 <> s1
union all select file_name, field, 'type_changed' from cmp where s0 is not null and s1 is not null and k0 <> k1
"""


_CHANGES = _CHANGES_OF.replace("{field}", f"case {_SPELLED} end")
_UNKNOWN = _CHANGES_OF.replace("{field}", f"case when (case {_SPELLED} end) is null then key end")


@query(_CHANGES)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.schema_changes(drift.ingest(table(spark, folder, "matcher_raw")))


@query(_UNKNOWN)
def p1_unknown(spark: SparkSession, folder: str) -> DataFrame:
    """The changes of the keys that no field of the target approves."""
    return drift.schema_changes(drift.ingest(table(spark, folder, "matcher_raw")), unknown=True)


_BY_TYPE = {"array<array<double>>": "m", "array<int>": "a", "int": "i", "double": "d", "string": "s"}
_OF_TYPE = {c: ", ".join(f"'{n}'" for n, (t, _) in drift.MATCHER_FIELDS.items() if _BY_TYPE[t] == c) for c in "maids"}
_CHOSEN = ", ".join(f"arg_min({_BY_TYPE[t]}, {{'r': rank, 'k': key}}) filter (field = '{n}' and rank < 2) as {n}" for n, (t, _) in drift.MATCHER_FIELDS.items())
_TYPED = rf"""
with recs as (select distinct raw_id, series, file_no, file_name, payload, coalesce(json_valid(payload) and json_type(case when json_valid(payload) then payload end) = 'OBJECT', false) as readable from matcher_raw),
keyed as (select raw_id, series, file_no, unnest(json_keys(payload)) as key, payload from recs where readable),
vals as (select *, case {_SPELLED} end as field, json_extract(payload, '$."' || key || '"') as v from keyed),
kinds as (select *, nullif(nullif(nullif(regexp_replace(json_structure(v)::varchar, 'UBIGINT|BIGINT|HUGEINT', 'WHOLE', 'g'), '"NULL"'), '["NULL"]'), '[["NULL"]]') as kind, case when json_type(v) = 'VARCHAR' then v->>'$' end as t from vals),
forms as (select *,
  case when kind in ('[["DOUBLE"]]', '[["WHOLE"]]') then try_cast(v as double[][]) when json_type(v) = 'ARRAY' and regexp_full_match(v::varchar, '[\[\],\snul]+') then []::double[][] end as m0,
  case when kind = '"VARCHAR"' and regexp_matches(t, '^\s*\[') then try_cast(case when json_valid(t) then t end::json as double[][])
    when kind = '"VARCHAR"' then case when list_bool_and(list_transform(string_split(replace(t, ';', ','), ','), lambda x: try_cast(trim(x) as double) is not null)) then list_transform(string_split(t, ';'), lambda r: list_transform(string_split(r, ','), lambda x: try_cast(trim(x) as double))) end
    when kind like '[{{%' then list_transform(json_extract(v, '$[*]'), lambda o: [(o->>'h')::double, (o->>'w')::double, (o->>'l')::double])
    when kind in ('["DOUBLE"]', '["WHOLE"]') and json_array_length(v) % 3 = 0 then list_transform(range(0, json_array_length(v)::bigint, 3), lambda i: try_cast(v as double[])[i + 1:i + 3]) end as m1,
  case when kind = '"WHOLE"' then try_cast(v->>'$' as int) end as i0,
  case when kind = '"VARCHAR"' and regexp_full_match(t, '\s*[+-]?\d+\s*') then try_cast(trim(t) as int) when kind = '"DOUBLE"' and (v->>'$')::double = floor((v->>'$')::double) then try_cast((v->>'$')::double as int) end as i1,
  case when kind in ('"WHOLE"', '"DOUBLE"') then (v->>'$')::double end as d0, case when kind = '"VARCHAR"' then try_cast(trim(t) as double) end as d1,
  case when kind = '"VARCHAR"' then t end as s0, case when kind is not null then v::varchar end as s1,
  case when kind like '[%' then try_cast(v as int[]) when json_type(v) = 'ARRAY' and regexp_full_match(v::varchar, '[\[\],\snul]+') then []::int[] end as a0, null::int[] as a1 from kinds),
ranked as (select *, {', '.join(f"case when field in ({_OF_TYPE[c]}) then coalesce({c}0, {c}1) end as {c}" for c in 'maids')},
  case when {' or '.join(f"(field in ({_OF_TYPE[c]}) and {c}0 is not null)" for c in 'maids')} then 0 when {' or '.join(f"(field in ({_OF_TYPE[c]}) and {c}1 is not null)" for c in 'maids')} then 1 when kind is not null then 2 else 3 end as rank from forms),
first as (select raw_id, field, min({{'r': rank, 'k': key}}).r as rank, arg_min(kind, {{'r': rank, 'k': key}}) as kind from ranked where field is not null group by all),
again as (select raw_id, list(field) as fields from first where rank = 1 group by all),
peaks as (select r.raw_id, any_value(series) as series, any_value(file_no) as file_no, any_value(case when f.kind = '[["WHOLE"]]' then coalesce(list_max(list_transform(flatten(m), lambda x: abs(x))), 0) when contains(f.kind, 'DOUBLE') then -1 end) as peak
  from ranked r join first f on f.raw_id = r.raw_id and f.field = r.field and f.rank = r.rank where r.field = 'text_embedding0' group by r.raw_id),
quant as (select series, file_no from peaks group by all having min(peak) >= 0 and max(peak) > 1),
rest as (select raw_id, list(key order by key) as rescued from ranked where field is null or rank = 2 group by raw_id),
chosen as (select raw_id, {_CHOSEN} from ranked group by raw_id),
scaled as (select c.* replace (case when q.series is not null and p.peak >= 0 and not coalesce(list_contains(a.fields, 'text_embedding0'), false) then list_transform(text_embedding0, lambda r: list_transform(r, lambda x: x * 0.01::double)) else text_embedding0 end as text_embedding0),
  q.series is not null and p.peak >= 0 and not coalesce(list_contains(a.fields, 'text_embedding0'), false) as quantised, a.fields from chosen c left join again a using (raw_id) left join peaks p using (raw_id) left join quant q on q.series = p.series and q.file_no = p.file_no)
select r.raw_id, r.file_name, r.readable, s.* exclude (raw_id, quantised, fields), coalesce(array_to_string(list_sort(list_concat(coalesce(fields, []), case when quantised then ['text_embedding0'] else [] end)), ','), '') as replayed,
  coalesce(array_to_string(rescued, ','), '') as rescued from recs r left join scaled s using (raw_id) left join rest using (raw_id)
"""


@query(_TYPED)
def p1_typed(spark: SparkSession, folder: str) -> DataFrame:
    """The typed columns of the ingested table, with the names of the replayed fields and of the rescued keys."""
    t = drift.ingest(table(spark, folder, "matcher_raw"))
    keys = F.array_sort(F.map_keys(F.from_json("_rescued", "map<string,string>")))
    return t.select("raw_id", "file_name", F.col("_readable").alias("readable"), *drift.MATCHER_FIELDS, F.coalesce(F.array_join("_replayed", ","), F.lit("")).alias("replayed"), F.coalesce(F.array_join(keys, ","), F.lit("")).alias("rescued"))


@query()
def p1_table(spark: SparkSession, folder: str) -> DataFrame:
    return drift.ingest(table(spark, folder, "matcher_raw"))


_READ = r"""
with f as (select distinct file_id, file_path, coalesce(file_content, '') as c, case when json_valid(file_content) then file_content end as j from feature_file),
l as (select file_id, file_path, list_filter(string_split(replace(c, chr(13), ''), chr(10)), lambda x: length(trim(x)) > 0) as ls from f where j is null),
g as (select file_id, file_path, ls, list_bool_and(list_transform(ls, lambda x: json_valid(x) and coalesce(json_type(case when json_valid(x) then x end), '') = 'OBJECT')) as good from l),
"""
_RECORDS = (
    _READ
    + r"""v as (select file_path, unnest(list_transform(ls, lambda x: case when json_valid(x) then x end)) as j from g where len(ls) > 0 and good),
docs as (select file_path, j from f where j is not null union all select file_path, j from v),
ids as (select file_path, unnest(json_extract(j, '$[*]'))->>'instance_id' as i from docs where json_type(j) = 'ARRAY'
  union all select file_path, j->>'instance_id' from docs where json_type(j) = 'OBJECT' and json_exists(j, '$.instance_id')
  union all select file_path, unnest(json_keys(j)) from docs where json_type(j) = 'OBJECT' and not json_exists(j, '$.instance_id')),
recs as (select distinct regexp_extract(file_path, 'scene\d+_\d+') as scan_id, regexp_extract(file_path, '(\d+)_[^/]*$', 1)::bigint as frame_id, i::bigint as instance_id from ids)
"""
)


def _rewritten(spark: SparkSession, folder: str, target_bytes: int = compaction.TARGET_BYTES) -> DataFrame:
    target = shared_folder(spark, "compacted")
    compaction.write_compacted(table(spark, folder, "feature_file"), target, target_bytes)
    return compaction.read_compacted(spark, target)


@query(_RECORDS + "select scan_id, frame_id, instance_id from recs")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The records as they stand in the rewritten and reconciled files."""
    return _rewritten(spark, folder).select("scan_id", "frame_id", "instance_id")


@query(
    _RECORDS
    + f""", sized as (select *, 32 + 4 * {VALUES} as bytes from recs),
run as (select *, sum(bytes) over (order by scan_id, frame_id, instance_id rows unbounded preceding) - bytes as before from sized)
select (before // {compaction.TARGET_BYTES})::bigint as group_no, count(*) as records, sum(bytes)::bigint as bytes, min(scan_id) as first_scan, max(scan_id) as last_scan from run group by 1"""
)
def p5_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file of the target, as read back."""
    return compaction.group_report(_rewritten(spark, folder))


@query(
    _READ
    + r"""b as (select file_id, file_path, j is null and len(ls) > 0 and not good as broken from f left join g using (file_id, file_path))
select file_id, case when broken then 'broken' else 'no_place' end as reason from b
where broken or not regexp_matches(coalesce(file_path, ''), '(?i)scene[\s_-]*\d+[\s_-]+\d+') or not regexp_matches(coalesce(file_path, ''), '(\d+)_[^/]*$')"""
)
def p5_unread(spark: SparkSession, folder: str) -> DataFrame:
    """Files that give no record because they are broken or lie in no scan's place."""
    return compaction.unread_files(table(spark, folder, "feature_file"))


_REFS = r"""
with m as (select distinct map_row_id, scan_id, instance_id, added_at, removed_at from instance_name_map),
c as (select distinct corr_id, instance_id, instance_id_in_00, matched_at,
  regexp_extract(lower(scan_id), 'scene[\s_-]*(\d+)[\s_-]+(\d+)', 1) as a, regexp_extract(lower(scan_id), 'scene[\s_-]*(\d+)[\s_-]+(\d+)', 2) as b
  from matched_instance_correspondence_to_00),
r as (select corr_id, matched_at, 'instance_id' as ref_column, 'scene' || lpad(a, greatest(4, length(a))::int, '0') || '_' || lpad(b, 2, '0') as scan, instance_id as inst from c
  union all select corr_id, matched_at, 'instance_id_in_00', 'scene' || lpad(a, greatest(4, length(a))::int, '0') || '_00', instance_id_in_00 from c),
refs as (select * from r where inst is not null and inst <> -1),
j as (select refs.corr_id, refs.ref_column, refs.matched_at, count(m.map_row_id) as n,
  coalesce(bool_or(m.added_at <= refs.matched_at and (m.removed_at is null or m.removed_at > refs.matched_at)), false) as held,
  coalesce(bool_and(m.added_at > refs.matched_at), false) as late
  from refs left join m on m.scan_id = refs.scan and m.instance_id = refs.inst group by refs.corr_id, refs.ref_column, refs.matched_at),
o as (select corr_id, ref_column, matched_at, case when n = 0 then 'missing' when late then 'late' else 'deleted' end as reason from j where not held)
"""


@query(_REFS + "select corr_id, ref_column, reason from o")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = orphans.orphan_references(table(spark, folder, "matched_instance_correspondence_to_00"), table(spark, folder, "instance_name_map"))
    return found.select("corr_id", "ref_column", "reason")


@query(
    _REFS
    + """, t as (select ref_column, strftime(matched_at, '%Y-%m') as month, count(*) as refs from refs group by 1, 2)
select o.ref_column, strftime(o.matched_at, '%Y-%m') as month, reason, count(*) as orphans, any_value(t.refs) as refs
from o join t on t.ref_column = o.ref_column and t.month = strftime(o.matched_at, '%Y-%m') group by 1, 2, 3"""
)
def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_counts(table(spark, folder, "matched_instance_correspondence_to_00"), table(spark, folder, "instance_name_map"))
