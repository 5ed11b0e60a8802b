"""Queries of the general training-data problems (1 to 5), with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cdc_apply, drift, hierarchy, incremental, orphans
from ..runtime import materialize, read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.untaken(read_table(spark, d, "objects"), read_table(spark, d, "consumer_runs"), read_table(spark, d, "meta"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.find_orphans(read_table(spark, d, "objects"), read_table(spark, d, "store_types")).select("store_id", "oid", "field", "ref_oid")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(read_table(spark, d, "objects"), read_table(spark, d, "store_types"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cdc_apply.rebuilt_records(read_table(spark, d, "objects"), read_table(spark, d, "commit_batches")).select("store_id", "oid", "tid")


def p3_feeds(spark: SparkSession, d: str) -> DataFrame:
    """The deliveries in three feeds: the later ones first, then the first attempts of the earlier ones, then the rest."""
    batches = read_table(spark, d, "commit_batches")
    half = batches.agg(F.floor(F.avg("tid"))).first()[0] or 0
    early, first = F.coalesce(F.col("tid") <= half, F.lit(False)), F.coalesce(F.col("attempt") <= 1, F.lit(True))
    feeds = [batches.where(~early), batches.where(early & first), batches.where(early & ~first)]
    return cdc_apply.applied_feeds(read_table(spark, d, "objects"), feeds).select("store_id", "oid", "tid")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.term_cycles(read_table(spark, d, "terms"))


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    paths = hierarchy.all_paths(read_table(spark, d, "terms"))
    return paths.select("go_id", "root", "depth", "from_cycle", F.concat_ws("/", "path").alias("path"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(read_table(spark, d, "terms"))


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.node_summary(read_table(spark, d, "terms"))


def _drift(spark: SparkSession, d: str) -> drift.Drift:
    return drift.Drift(read_table(spark, d, "objects"), read_table(spark, d, "store_types"), read_table(spark, d, "field_specs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).changes()


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    """The renames that the matching finds: declared, and likely ones that nobody declared."""
    x = _drift(spark, d)
    found = x.matches()
    return found.where("declared").unionByName(x.likely(found)).select("store_id", "name", "old_cid", "cid", "old", "new", F.round("score", 6).alias("score"), "declared")


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every version in its type's table, undeclared renames among the unified columns."""
    x = _drift(spark, d)
    rows = x.unified(materialize(x.matches(), "matches"))
    return rows.select("name", "store_id", "oid", "tid", "cid", F.to_json("row", {"ignoreNullFields": "false"}).alias("row"), "rest")


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """The unified tables value by value, columns unified by declared renames alone."""
    return _drift(spark, d).unified().select("name", "store_id", "oid", "tid", F.explode("row").alias("field", "value"))


def p5_columns(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).columns()


def p5_specimens(spark: SparkSession, d: str) -> DataFrame:
    """One type's table with typed columns."""
    rows = _drift(spark, d).table("catalogue.model:Specimen")
    return rows.select("store_id", "oid", "tid", *[c for c in ("specimen_no", "mass", "mineral") if c in rows.columns])


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p3_found": p3_found,
    "p3_feeds": p3_feeds,
    "p4_found": p4_found,
    "p4_paths": p4_paths,
    "p4_descendants": p4_descendants,
    "p4_nodes": p4_nodes,
    "p5_found": p5_found,
    "p5_matches": p5_matches,
    "p5_unified": p5_unified,
    "p5_values": p5_values,
    "p5_columns": p5_columns,
    "p5_specimens": p5_specimens,
}

# CRC-32 in SQL: the table follows from the polynomial, the bytes are read from the text's hexadecimal form.
_INTACT = """
tab as (select list(list_reduce([n] || range(8), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by n) as t
        from (select unnest(range(256)) as n)),
intact as (
  select store_id, oid, cid, tid, payload, committed_at, arrived_at from (
    select o.*, case when payload is not null then xor(4294967295, list_reduce([4294967295::bigint] || list_transform(range(octet_length(encode(payload))), lambda i: ('0x' || substr(hex(encode(payload)), (2 * i + 1)::bigint, 2))::bigint),
      lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::bigint]))) end as sum
    from objects o, tab)
  where sum is not distinct from crc and store_id is not null and oid is not null and tid is not null)"""

_CURRENT = """
cur as (select * from (select *, row_number() over (partition by store_id, oid order by tid desc, payload desc nulls last) as rn from intact) where rn = 1 and payload is not null)"""

_SHAPES = r"""
shape as (
  select store_id, cid, name, case when trim(fields) like '[%' then from_json(fields, '["VARCHAR"]') when contains(fields, chr(31)) then string_split(fields, chr(31)) else string_split(fields, ',') end as fields
  from (select *, row_number() over (partition by store_id, cid order by recorded_at desc, fields) as rn from store_types) where rn = 1)"""

_LINKS = """
cur as (select go_id, arg_max(parents, tid) as parents from terms group by go_id),
links as (
  select distinct c.go_id as child, p.go_id as parent
  from (select go_id, unnest(parents) as entry from cur) c
  join cur p on lower(trim(string_split(c.entry, '!')[1], ' ' || chr(9) || chr(10) || chr(13))) = lower(p.go_id)),
reach as (
  with recursive r as (select child, parent from links union select r.child, l.parent from r join links l on r.parent = l.child)
  select * from r),
cyc as (select distinct child as go_id from reach where child = parent)"""

_ABOVE = """,
above(ancestor, go_id, distance) using key (ancestor, go_id) as (
  select parent, child, 1 from links where child <> parent
  union select a.ancestor, l.child, min(a.distance + 1) from above a join links l on l.parent = a.go_id
    left join recurring.above r on r.ancestor = a.ancestor and r.go_id = l.child where l.child <> a.ancestor and r.distance is null group by all)"""

_DRIFT = (
    _INTACT
    + ","
    + _SHAPES
    + """,
vers as (select distinct store_id, oid, tid, cid, payload from intact where payload is not null),
vals as (select store_id, cid, unnest(json_extract(payload, '$[*]')) as v, generate_subscripts(json_extract(payload, '$[*]'), 1) as pos from vers),
kinds as (
  select store_id, cid, pos, case
    when json_type(v) = 'BOOLEAN' then 'bool' when json_type(v) in ('BIGINT', 'UBIGINT', 'HUGEINT') then 'int' when json_type(v) = 'DOUBLE' then 'float'
    when json_type(v) = 'VARCHAR' then 'string' when json_type(v) = 'ARRAY' then 'list'
    when json_type(v) = 'OBJECT' and json_keys(v) = ['$ref'] then 'ref' when json_type(v) = 'OBJECT' then 'map' end as kind, count(*) as n
  from vals group by all),
usual as (select store_id, cid, pos, kind from (select *, row_number() over (partition by store_id, cid, pos order by n desc, kind) as rn from kinds where kind is not null) where rn = 1),
pairs as (select * from (select *, lag(cid) over w as old_cid, lag(fields) over w as old_fields from shape window w as (partition by store_id, name order by cid)) where old_cid is not null),
now as (select store_id, name, cid, old_cid, fields, old_fields, unnest(fields) as field from pairs),
fresh as (select * from now where not list_contains(old_fields, field)),
renamed as (
  select f.store_id, f.cid, f.old_cid, f.field, s.renamed_from as old, f.fields, f.old_fields from fresh f
  join (select distinct typename, name, renamed_from from field_specs where renamed_from is not null) s on s.typename = f.name and s.name = f.field
  where list_contains(f.old_fields, s.renamed_from) and not list_contains(f.fields, s.renamed_from)),
gone as (select * from (select store_id, cid, fields, unnest(old_fields) as field from pairs) where not list_contains(fields, field)),
kept as (
  select store_id, cid, old_cid, field, list_position(fields, field) as pos, list_position(old_fields, field) as old_pos from now where list_contains(old_fields, field)
  union all select store_id, cid, old_cid, field, list_position(fields, field), list_position(old_fields, old) from renamed)"""
)

ORACLE = {
    "p1_found": "with "
    + _INTACT
    + r""",
vers as (select store_id, oid, tid, min(arrived_at) as available from intact group by all),
state as (select run_id, max(store_id) as store_id, max(consumer) as consumer, max(from_tid) as from_tid, min(started_at) as started_at, arg_max(status, logged_at) as status from consumer_runs group by run_id),
curs as (select run_id, max(try_cast(regexp_extract(value, '^[^0-9]*?([0-9]+)(\.[0-9]*)?[^0-9]*$', 1) as bigint)) as cursor from meta where run_id is not null and key like 'cursor.%' group by run_id),
ok as (select * from state join curs using (run_id) where status = 'ok' and cursor is not null)
select c.consumer, v.store_id, v.oid, v.tid from vers v, (values ('mirror'), ('fts'), ('deltalog')) c(consumer)
where not exists (select 1 from ok where ok.consumer = c.consumer and ok.store_id = v.store_id and ok.from_tid < v.tid and v.tid <= ok.cursor and v.available <= ok.started_at)""",
    "p2_found": "with "
    + _INTACT
    + ","
    + _CURRENT
    + ","
    + _SHAPES
    + r""",
vals as (select store_id, oid, cid, unnest(json_extract(payload, '$[*]')) as v, generate_subscripts(json_extract(payload, '$[*]'), 1) as pos from cur),
refs as (select distinct store_id, oid, cid, pos, unnest(regexp_extract_all(v::varchar, '\{"\$ref":\s*([0-9]+)\}', 1))::bigint as ref_oid from vals)
select r.store_id, r.oid, s.fields[r.pos] as field, r.ref_oid from refs r left join shape s using (store_id, cid)
where not exists (select 1 from cur c where c.store_id = r.store_id and c.oid = r.ref_oid)""",
    "p2_counts": "with "
    + _INTACT
    + ","
    + _CURRENT
    + ","
    + _SHAPES
    + r""",
vals as (select store_id, oid, tid, cid, unnest(json_extract(payload, '$[*]')) as v, generate_subscripts(json_extract(payload, '$[*]'), 1) as pos from cur),
refs as (select distinct store_id, oid, tid, cid, pos, unnest(regexp_extract_all(v::varchar, '\{"\$ref":\s*([0-9]+)\}', 1))::bigint as ref_oid from vals),
lost as (select r.*, s.name from refs r left join shape s using (store_id, cid) where not exists (select 1 from cur c where c.store_id = r.store_id and c.oid = r.ref_oid)),
made as (select store_id, tid, max(committed_at) as done_at from objects where committed_at is not null group by all)
select name, strftime(done_at, '%Y-%m') as month, count(*) as orphans, count(distinct (store_id, ref_oid)) as targets from lost left join made using (store_id, tid) group by all""",
    "p3_found": "with "
    + _INTACT
    + """,
won as (select * from (select *, max(attempt) over (partition by store_id, tid) as top from commit_batches) where attempt = top),
ops as (
  select store_id, oid, tid, payload is null as deleted from intact
  union all select store_id, r.oid, tid, r.payload is null from (select store_id, tid, unnest(records) as r from won)
  union all select store_id, d, tid, true from (select store_id, tid, unnest(deletes) as d from won))
select store_id, oid, tid from (select *, row_number() over (partition by store_id, oid order by tid desc, deleted desc) as rn from ops) where rn = 1 and not deleted""",
    "p4_found": "with " + _LINKS + """
select min(b.parent) as cycle_id, a.go_id from cyc a join reach b on b.child = a.go_id join reach c on c.child = b.parent and c.parent = a.go_id group by a.go_id""",
    "p4_paths": "with recursive " + _LINKS + """,
met as (select b.child as go_id, min(b.parent) as cycle_id from reach b join reach c on c.child = b.parent and c.parent = b.child group by all),
node as (select go_id, coalesce(cycle_id, go_id) as node from cur left join met using (go_id)),
up as (select distinct c.node as child, p.node as parent from links join node c on c.go_id = child join node p on p.go_id = parent where c.node <> p.node),
paths as (
  select distinct node, node as root, 0 as depth, node in (select go_id from cyc) as from_cycle, node as path from node where node not in (select child from up)
  union all select u.child, p.root, p.depth + 1, p.from_cycle, p.path || '/' || u.child from paths p join up u on u.parent = p.node)
select go_id, root, depth, from_cycle, path from paths join node using (node)""",
    "p4_descendants": "with recursive " + _LINKS + _ABOVE + """
select ancestor, go_id, distance from above""",
    "p4_nodes": "with recursive " + _LINKS + _ABOVE + """,
tops as (select go_id from cur where go_id not in (select child from links)),
up as (select a.go_id, min(case when t.go_id is not null then distance end) as depth, count(t.go_id) as roots, count(*) as ancestors from above a left join tops t on t.go_id = a.ancestor group by all),
down as (select ancestor as go_id, count(*) as descendants from above group by all)
select go_id, case when t.go_id is not null then 0 else depth end as depth, case when t.go_id is not null then 1 else coalesce(roots, 0) end as roots, coalesce(ancestors, 0) as ancestors, coalesce(descendants, 0) as descendants
from cur left join up using (go_id) left join down using (go_id) left join tops t using (go_id)""",
    "p5_found": "with " + _DRIFT + """
select store_id, cid, field, 'renamed' as change from renamed
union select store_id, cid, field, 'added' from fresh where (store_id, cid, field) not in (select store_id, cid, field from renamed)
union select store_id, cid, field, 'removed' from gone where (store_id, cid, field) not in (select store_id, cid, old from renamed)
union select k.store_id, k.cid, k.field, 'retyped' from kept k join usual a on a.store_id = k.store_id and a.cid = k.cid and a.pos = k.pos
  join usual b on b.store_id = k.store_id and b.cid = k.old_cid and b.pos = k.old_pos where a.kind <> b.kind""",
}
ORACLE["p3_feeds"] = ORACLE["p3_found"]

_NAMES = """,
specs as (select distinct typename, name as new, renamed_from as old from field_specs where renamed_from is not null),
fields as (select store_id, cid, name, fields, unnest(fields) as field, generate_subscripts(fields, 1) as pos from shape),
names as (select f.store_id, f.cid, f.name, f.pos, coalesce(s.new, f.field) as field from fields f left join specs s on s.typename = f.name and s.old = f.field and not list_contains(f.fields, s.new))"""

ORACLE |= {
    "p5_values": "with " + _DRIFT + _NAMES + """
select n.name, v.store_id, v.oid, v.tid, n.field, v.v ->> '$' as value
from (select store_id, oid, tid, cid, unnest(json_extract(payload, '$[*]')) as v, generate_subscripts(json_extract(payload, '$[*]'), 1) as pos from vers) v join names n using (store_id, cid, pos)""",
    "p5_columns": "with " + _DRIFT + _NAMES + """
select name, field, case when count(distinct kind) = 1 then min(kind) when bool_and(kind in ('int', 'float')) then 'float' else 'string' end as kind, count(*) as shapes
from names join usual using (store_id, cid, pos) group by all""",
    "p5_specimens": "with " + _DRIFT + _NAMES + """,
held as (
  select v.store_id, v.oid, v.tid, n.field, v.v from (select store_id, oid, tid, cid, unnest(json_extract(payload, '$[*]')) as v, generate_subscripts(json_extract(payload, '$[*]'), 1) as pos from vers) v
  join names n using (store_id, cid, pos) where n.name = 'catalogue.model:Specimen')
select store_id, oid, tid, max(case when field = 'specimen_no' then v ->> '$' end) as specimen_no, max(case when field = 'mass' then try_cast(v ->> '$' as double) end) as mass,
  max(case when field = 'mineral' then try_cast(json_extract_string(v, '$."$ref"') as bigint) end) as mineral
from held group by all""",
}
