"""The p1, p2, p4 and p6 queries over the project's tables, and the SQL they are checked against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.times import iso, naive
from chronoweave.operators import asof, flatten, forest, orphans
from chronoweave.runtime import Workspace, read_table


# --- 1: references to records that do not exist ---------------------------------------------------------------


def _reference_graph(spark: SparkSession, folder: str) -> tuple[list[orphans.ForeignKey], dict[str, DataFrame]]:
    nodes, edges, provenance, mentions = (read_table(spark, folder, t) for t in ("nodes", "edges", "provenance", "mentions"))
    never = F.lit(None).cast("timestamp_ntz")
    records = {
        "nodes": nodes.groupBy("id").agg(F.min(naive("ingested_at")).alias("first_seen"), F.max(naive("deleted_at")).alias("deleted_at")),
        "edges": edges.groupBy("id").agg(F.min(naive("ingested_at")).alias("first_seen")).withColumn("deleted_at", never),
    }
    arrived = naive("ingested_at").alias("arrived")
    keys = [
        orphans.ForeignKey("edges", f, edges.select(F.col("id").alias("row_key"), F.col(f).alias("ref_id"), arrived), ("nodes",)) for f in ("src", "dst")
    ] + [
        orphans.ForeignKey("mentions", "entity_id", mentions.select(F.col("artifact_path").alias("row_key"), F.col("entity_id").alias("ref_id"), arrived), ("nodes",)),
        orphans.ForeignKey("provenance", "target_id", provenance.select(F.col("target_id").alias("row_key"), F.col("target_id").alias("ref_id"), arrived), ("edges", "nodes")),
    ]
    return keys, records


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The failing references themselves; what hangs on orphaned records in turn is in p1_report."""
    return orphans.direct_orphans(*_reference_graph(spark, folder)).select("tab", "row_key", "field_name", "ref_id", "state")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    with Workspace(spark, "p1") as ws:
        return orphans.report(orphans.cascade(*_reference_graph(spark, folder), ws))


P1_SQL = """
with n as (select id, min(ingested_at) f, max(deleted_at) d from nodes group by id),
e as (select id, min(ingested_at) f from edges group by id),
both_ as (select id, min(f) f, max(d) d from (select id, f, d from n union all select id, f, null from e) group by id),
r as (
  select 'edges' tab, id row_key, 'src' field_name, src ref_id, min(ingested_at) a from edges where trim(src) <> '' group by id, src
  union all select 'edges', id, 'dst', dst, min(ingested_at) from edges where trim(dst) <> '' group by id, dst
  union all select 'mentions', artifact_path, 'entity_id', entity_id, min(ingested_at) from mentions where trim(entity_id) <> '' group by artifact_path, entity_id
  union all select 'provenance', target_id, 'target_id', target_id, min(ingested_at) from provenance where trim(target_id) <> '' group by target_id),
j as (
  select r.*, k.f, k.d from r left join n k on r.ref_id = k.id where tab <> 'provenance'
  union all select r.*, k.f, k.d from r left join both_ k on r.ref_id = k.id where tab = 'provenance'),
s as (select *, case when f is null then 'missing' when d <= a then 'deleted' when f > a then 'late' end state from j)
"""
P1_FOUND_SQL = P1_SQL + "select tab, row_key, field_name, ref_id, state from s where state is not null"
P1_REPORT_SQL = (
    P1_SQL
    + """, direct as (select tab, row_key, field_name, ref_id, a, state, 'direct' kind from s where state is not null),
inherited as (
  select tab, row_key, field_name, ref_id, a, 'orphaned_parent' state, 'inherited' kind from r
  where tab = 'provenance' and ref_id in (select row_key from direct where tab = 'edges') and ref_id not in (select ref_id from direct where tab = 'provenance')),
x as (select * from direct union all select * from inherited)
select tab, strftime(a, '%Y-%m') as "month", kind, state, count(*) n_refs, count(distinct ref_id) n_targets from x group by all
"""
)

# --- 2: attributes as known at event time ---------------------------------------------------------------------


def _p2(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges, journal = (read_table(spark, folder, t) for t in ("nodes", "edges", "run_clinical_study"))
    named = F.array_distinct(F.concat(F.coalesce(F.flatten(F.map_values("actors")), F.array()), F.coalesce("subjects", F.array())))
    events = journal.select(F.col("id").alias("event_id"), iso("timestamp").alias("ts"), F.explode(named).alias("entity_id")).where(F.col("entity_id").isNotNull())
    events = events.groupBy("event_id", "entity_id").agg(F.min("ts").alias("ts"))
    no_time = F.lit(None).cast("timestamp_ntz")
    states = nodes.select(F.col("id").alias("entity_id"), iso("created_at").alias("created"), naive("ingested_at").alias("seen"), "rev", F.lit(None).cast("string").alias("edge_id"))
    memberships = edges.where("type = 'member_of'").select(
        F.col("src").alias("entity_id"), iso("created_at").alias("created"), naive("ingested_at").alias("seen"), F.lit(None).cast("int").alias("rev"), F.col("id").alias("edge_id")
    )
    changes = states.unionByName(memberships).withColumn("available", F.when(F.col("created").isNotNull() & F.col("seen").isNotNull(), F.greatest("created", "seen")).otherwise(no_time))
    tracks = {"state": F.when(F.col("rev").isNotNull(), F.struct("created", "rev")), "team": F.when(F.col("edge_id").isNotNull(), F.struct("created", "edge_id"))}
    last = changes.where("created is not null or rev is not null").groupBy("entity_id").agg(*[F.max(c).alias(f"last_{n}") for n, c in tracks.items()]).where("last_state is not null")
    with Workspace(spark, "p2") as ws:
        known = asof.carry_forward(events.join(last, "entity_id"), changes, "entity_id", "ts", "available", tracks, ws)
    return known.select(
        "event_id", "entity_id", "ts",
        F.coalesce("state.rev", F.lit(-1)).alias("rev"), F.coalesce("team.edge_id", F.lit("")).alias("edge_id"),
        F.coalesce("last_state.rev", F.lit(-1)).alias("last_rev"), F.coalesce("last_team.edge_id", F.lit("")).alias("last_edge_id"),
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p2(spark, folder).where("rev <> last_rev or edge_id <> last_edge_id").select("event_id", "entity_id", "rev", "edge_id")


def p2_known(spark: SparkSession, folder: str) -> DataFrame:
    return _p2(spark, folder).select("event_id", "entity_id", "rev", "edge_id")


P2_SQL = """
with j as (select id, min(try_cast("timestamp" as timestamp)) ts, any_value(actors) actors, any_value(subjects) subjects from run_clinical_study group by id),
p as (select distinct id event_id, ts, unnest(list_concat(coalesce(flatten(map_values(actors)), []), coalesce(subjects, []))) entity_id from j),
n as (select id entity_id, rev, try_cast(created_at as timestamp) c, min(ingested_at) i from nodes group by all),
m as (select src entity_id, id edge_id, try_cast(created_at as timestamp) c, min(ingested_at) i from edges where type = 'member_of' group by all),
ln as (select entity_id, arg_max(rev, (c, rev)) last_rev from n group by entity_id),
lm as (select entity_id, arg_max(edge_id, (c, edge_id)) last_edge from m group by entity_id),
kn as (select p.event_id, p.entity_id, arg_max(n.rev, (n.c, n.rev)) rev from p join n using (entity_id) where n.c <= p.ts and n.i <= p.ts group by all),
km as (select p.event_id, p.entity_id, arg_max(m.edge_id, (m.c, m.edge_id)) edge_id from p join m using (entity_id) where m.c <= p.ts and m.i <= p.ts group by all),
x as (
  select p.event_id, p.entity_id, coalesce(kn.rev, -1) rev, coalesce(km.edge_id, '') edge_id, ln.last_rev, coalesce(lm.last_edge, '') last_edge
  from p join ln using (entity_id) left join lm using (entity_id) left join kn using (event_id, entity_id) left join km using (event_id, entity_id))
"""
P2_FOUND_SQL = P2_SQL + "select event_id, entity_id, rev, edge_id from x where rev <> last_rev or edge_id <> last_edge"
P2_KNOWN_SQL = P2_SQL + "select event_id, entity_id, rev, edge_id from x"

# --- 4: parent-child links to full hierarchies ----------------------------------------------------------------


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    with Workspace(spark, "p4") as ws:
        links = ws.put(forest.parent_links(read_table(spark, folder, "run_clinical_study"), "id", "parent_event"), keep=True)
        solved = forest.contract(links.select("id", "parent"), ws)
        named = links.where("named").select("id")
        return solved.join(named, "id", "left_semi").select(F.col("id").alias("event_id"), F.col("root").alias("root_id"), F.col("depth").cast("int"))


def p4_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with root, depth, path and number of descendants; below a circle the path runs from its member, and the circle's smallest id lists its members."""
    with Workspace(spark, "p4") as ws:
        links = ws.put(forest.parent_links(read_table(spark, folder, "run_clinical_study"), "id", "parent_event"), keep=True)
        solved = forest.contract(links.select("id", "parent"), ws, paths=True, sizes=True)
        hung = forest.below_circles(links, solved, ws, sizes=True).select("id", F.when(F.col("depth") > 0, F.col("path")).alias("from_circle"), F.col("size").alias("hung_size"))
        circles = solved.where("circle is not null").select(F.col("root").alias("id"), F.array_join(F.array_sort("circle"), ">").alias("members"))
        return solved.join(hung, "id", "left").join(circles, "id", "left").select(
            F.col("id").alias("event_id"), F.col("root").alias("root_id"), F.col("depth").cast("int"), F.array_join(F.coalesce("path", "from_circle"), ">").alias("path"),
            F.col("members").alias("circle"), (F.coalesce("hung_size", "size") - 1).alias("n_descendants"),
        )


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    with Workspace(spark, "p4") as ws:
        links = ws.put(forest.parent_links(read_table(spark, folder, "run_clinical_study"), "id", "parent_event"), keep=True)
        solved = forest.contract(links.select("id", "parent"), ws, paths=True)
        return forest.descendants(solved).unionByName(forest.descendants(forest.below_circles(links, solved, ws)))


P4_SQL = """
with recursive ids as (select id, max(case when trim(parent_event) <> '' then parent_event end) up from run_clinical_study group by id),
l as (select a.id, b.id parent, a.up is not null named from ids a left join ids b on a.up = b.id),
t as (select id, id root, 0 depth, id path from l where parent is null
      union all select l.id, t.root, t.depth + 1, t.path || '>' || l.id from l join t on l.parent = t.id),
bad as (select id, parent from l where id not in (select id from t)),
up(id, anc) as (select id, parent from bad union select u.id, b.parent from up u join bad b on u.anc = b.id),
oncirc as (select id from up where id = anc),
c as (select id, min(anc) root from up where anc in (select id from oncirc) group by id)
"""
P4_FOUND_SQL = P4_SQL + (
    "select t.id event_id, root root_id, depth from t join l using (id) where named union all select id, root, -1 from c"
)
# upwards from every link that is no part of a circle; around a circle nobody is above anybody
P4_DESCENDANTS_SQL = P4_SQL + (
    ", tree as (select id, parent from l where parent is not null and id not in (select id from oncirc)), d(ancestor, descendant, distance) as (select parent, id, 1 from tree "
    "union all select t.parent, d.descendant, d.distance + 1 from d join tree t on d.ancestor = t.id) select ancestor, descendant, cast(distance as bigint) distance from d"
)
P4_HIERARCHY_SQL = P4_SQL + """
, h(id, path, depth) as (select id, id, 0 from oncirc union all select b.id, h.path || '>' || b.id, h.depth + 1 from bad b join h on b.parent = h.id where b.id not in (select id from oncirc)),
p as (select id, path, depth from t union all select id, path, depth from h),
n as (select a id, count(*) k from (select unnest(string_split(path, '>')[:-2]) a from p) group by a),
m as (select root, string_agg(c.id, '>' order by c.id) circle from c where c.id in (select id from oncirc) group by root),
x as (select id, root, depth, path from t union all select c.id, c.root, -1, case when h.depth > 0 then h.path end from c join h using (id))
select x.id event_id, x.root root_id, x.depth::integer as "depth", x.path, m.circle, coalesce(n.k, 0) n_descendants from x left join n on n.id = x.id left join m on m.root = x.id
"""

# --- 6: deeply nested semi-structured records -----------------------------------------------------------------


_text = lambda *names: tuple((n, f"$.{n}", "string") for n in names)
_whole = lambda *names: tuple((n, f"$.{n}", "int") for n in names)
LISTS = {
    "deliverable": flatten.Level("$", (*_text("kind", "medium"), ("value", "$", "string")), flatten.Level("$.sections", (*_text("title"), *_whole("pages")))),
    "severity": flatten.Level("$.severity", (*_whole("code"), *_text("grade"), ("value", "$", "string")), flatten.Level("$.history", (("said_by", "$.by", "string"), ("earlier_grade", "$.grade", "string")))),
    "mentions": flatten.Level("$.mentions", _text("artifact_path", "entity_id", "surface_form"), flatten.Level("$.locator", (*_text("medium"), *_whole("offset", "length", "line")))),
}


def nested_lists(spark: SparkSession, folder: str, name: str, level: flatten.Level) -> DataFrame:
    """(record_id, lists) of one kind; copies of a record agree, so the flat rows of copies are equal and distinct removes them afterwards."""
    if name == "mentions":
        # a bundle may be wrapped in 'kg'; its own mentions come first, then those of its parts
        bodies = read_table(spark, folder, "kg_bundles").select(F.col("bundle_id").alias("record_id"), flatten.parsed("body").alias("b"))
        unwrapped = bodies.withColumn("v", F.expr("coalesce(try_variant_get(b, '$.kg', 'variant'), b)"))
        return unwrapped.select("record_id", F.expr(flatten.run_on(flatten.nested("v", level), flatten.run_on_parts("v", "$.parts", level))).alias("lists"))
    column = "deliverable" if name == "deliverable" else "payload"
    texts = read_table(spark, folder, "run_clinical_study").where(F.col(column).isNotNull()).select(F.col("id").alias("record_id"), flatten.parsed(column).alias("v"))
    return texts.select("record_id", F.expr(flatten.nested("v", level)).alias("lists")).where(F.size("lists") > 0)


def p6_flat(spark: SparkSession, folder: str, name: str, keys_only: bool = False) -> DataFrame:
    level = LISTS[name].bare() if keys_only else LISTS[name]
    return flatten.flatten(nested_lists(spark, folder, name, level), level)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    every = reduce(DataFrame.unionByName, [p6_flat(spark, folder, n, keys_only=True).withColumn("list_name", F.lit(n)) for n in LISTS])
    return every.select("record_id", "list_name", F.col("no_0").alias("item_no"), F.coalesce("no_1", F.lit(-1)).alias("sub_no")).distinct()


def _p6_tables(spark: SparkSession, folder: str, depth: int) -> DataFrame:
    numbers = {"no_0": "item_no", "no_1": "sub_no"}
    parts = [flatten.table(p6_flat(spark, folder, n), level, depth).withColumnsRenamed(numbers).withColumn("list_name", F.lit(n)) for n, level in LISTS.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).distinct()


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """The table of parents: every deliverable, severity and mention with its fields, keyed by record, list and position."""
    return _p6_tables(spark, folder, 0)


def p6_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The table of children: sections, history and locators, each with its parent's key and its own position."""
    return _p6_tables(spark, folder, 1)


def _aslist(x: str) -> str:
    return f"case when json_type({x}) = 'ARRAY' then json_extract({x}, '$[*]') when {x} is null or json_type({x}) = 'NULL' then [] else [{x}] end"


P6_SQL = f"""
with t as (
  select distinct id rid, 'deliverable' ln, 'sections' inr, deliverable x from run_clinical_study union select id, 'severity', 'history', payload from run_clinical_study
  union select bundle_id, 'mentions', 'locator', body from kg_bundles),
v as (select rid, ln, inr, case when json_valid(x) then x::json end j from t),
u as (select rid, ln, inr, case when json_type(j) <> 'VARCHAR' then j when json_valid(j->>'$') then (j->>'$')::json end j from v),
w as (select rid, ln, inr, case ln when 'severity' then json_extract(j, '$.severity') when 'mentions' then coalesce(json_extract(j, '$.kg'), j) else j end j from u where j is not null),
m as (select *, json_extract(j, '$.mentions') mm, json_extract(j, '$.parts') pp from w),
l as (select rid, ln, inr, case when ln = 'mentions' then list_concat({_aslist('mm')}, flatten(list_transform({_aslist('pp')}, lambda q: {_aslist("json_extract(q, '$.mentions')")}))) else {_aslist('j')} end l from m),
i as (select rid, ln, inr, unnest(l) x, generate_subscripts(l, 1) - 1 item_no from l),
k as (select rid, ln, item_no, x, json_extract(x, '$.' || inr) y from i where json_type(x) <> 'NULL'),
c as (select rid, ln, item_no, {_aslist('y')} sub from k),
s as (select rid, ln, item_no, unnest(sub) z, generate_subscripts(sub, 1) - 1 sub_no from c)
"""
P6_FOUND_SQL = P6_SQL + """
select distinct rid record_id, ln list_name, item_no::integer item_no, sub_no::integer sub_no from (
  select rid, ln, item_no, -1 sub_no from k union all select rid, ln, item_no, sub_no from s where json_type(z) <> 'NULL')
"""
_J = lambda v, ln, f, t=None: f"case when ln = '{ln}' then {f'try_cast({v}->>{chr(39)}$.{f}{chr(39)} as {t})' if t else f'{v}->>{chr(39)}$.{f}{chr(39)}'} end"
P6_ITEMS_SQL = P6_SQL + f"""
select distinct rid record_id, ln list_name, item_no::integer item_no, {_J('x', 'deliverable', 'kind')} kind, {_J('x', 'deliverable', 'medium')} medium,
  case when ln <> 'mentions' and json_type(x) <> 'OBJECT' then x->>'$' end "value", {_J('x', 'severity', 'code', 'integer')} code, {_J('x', 'severity', 'grade')} grade,
  {_J('x', 'mentions', 'artifact_path')} artifact_path, {_J('x', 'mentions', 'entity_id')} entity_id, {_J('x', 'mentions', 'surface_form')} surface_form from k"""
P6_ENTRIES_SQL = P6_SQL + f"""
select distinct rid record_id, ln list_name, item_no::integer item_no, sub_no::integer sub_no, {_J('z', 'deliverable', 'title')} title, {_J('z', 'deliverable', 'pages', 'integer')} pages,
  {_J('z', 'severity', 'by')} said_by, {_J('z', 'severity', 'grade')} earlier_grade, {_J('z', 'mentions', 'medium')} medium, {_J('z', 'mentions', 'offset', 'integer')} "offset",
  {_J('z', 'mentions', 'length', 'integer')} "length", {_J('z', 'mentions', 'line', 'integer')} line from s where json_type(z) <> 'NULL'"""

QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_known, p4_found, p4_hierarchy, p4_descendants, p6_found, p6_items, p6_entries)}
SQL = {"p1_found": P1_FOUND_SQL, "p1_report": P1_REPORT_SQL, "p2_found": P2_FOUND_SQL, "p2_known": P2_KNOWN_SQL, "p6_found": P6_FOUND_SQL, "p6_items": P6_ITEMS_SQL, "p6_entries": P6_ENTRIES_SQL, "p4_found": P4_FOUND_SQL, "p4_descendants": P4_DESCENDANTS_SQL, "p4_hierarchy": P4_HIERARCHY_SQL}
