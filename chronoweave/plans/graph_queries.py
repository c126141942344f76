"""Queries on the temporal graph: projection, adjacency, labels, traversal, inference, diff, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.times import naive
from chronoweave.operators import graph as g
from chronoweave.operators import infer, traverse
from chronoweave.runtime import Workspace, read_table

#: The instants the registered queries look at.
THEN, LATER, WINDOW = "2027-06-30 00:00:00", "2027-09-30 00:00:00", "60 days"

PRE = """
with recursive n as (select id, arg_max_null(type, rev) type, arg_max_null(try_cast(created_at as timestamp), rev) created, arg_max_null(props, rev) props,
  arg_max_null(aliases, (rev, coalesce(aliases, []))) aliases, max(deleted_at) deleted_at from nodes group by id),
e as (select id, max(type) type, max(src) src, max(dst) dst, max(try_cast(created_at as timestamp)) created, max(props) props from edges group by id),
j as (select id, max(type) type, max(try_cast("timestamp" as timestamp)) ts, max(initiative) initiative, max(project) project, max(deliverable) deliverable,
  max(parent_event) parent_event, max(payload) payload, any_value(actors) actors, any_value(subjects) subjects from run_clinical_study group by id),
part as (select id, entity_id, role from (
  select id, unnest(map_values(actors)) who, unnest(map_keys(actors)) role from j) , unnest(who) u(entity_id) where entity_id is not null
  union all select id, unnest(subjects), 'subject' from j),
art as (select json_extract_string(props, '$.path') path, max(id) artifact_id from n where type = 'Artifact' and json_extract_string(props, '$.path') <> '' group by 1)
"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, pre: str = PRE):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = pre + sql
        return f

    return add


def joined(c: str, alias: str | None = None):
    return F.array_join(c, "|").alias(alias or c)


@query(f"""
, d as (select src id, id eid from e where created <= timestamp '{THEN}' and created >= timestamp '{THEN}' - interval {WINDOW} union all
        select dst, id from e where created <= timestamp '{THEN}' and created >= timestamp '{THEN}' - interval {WINDOW})
select d.id, any_value(n.type) as "type", count(*) degree from d join n on d.id = n.id group by d.id order by degree desc, id limit 20""")
def graph_top_degree(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty busiest entities of the window before THEN."""
    t = g.TemporalGraph.load(spark, folder)
    now = t.at(THEN, WINDOW)
    ends = now.edges.select(F.col("src").alias("id")).unionByName(now.edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return ends.join(t.nodes.select("id", "type"), "id").select("id", "type", "degree").orderBy(F.desc("degree"), "id").limit(20)


@query("select 'node' kind, type, count(*) n from n group by type union all select 'edge', type, count(*) from e group by type union all select 'event', type, count(*) from j group by type")
def graph_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return g.TemporalGraph.load(spark, folder).type_counts()


@query(f"""
select 'node' kind, type, count(*) n from n where created <= timestamp '{THEN}' and created >= timestamp '{THEN}' - interval {WINDOW} group by type
union all select 'edge', type, count(*) from e where created <= timestamp '{THEN}' and created >= timestamp '{THEN}' - interval {WINDOW} group by type
union all select 'event', type, count(*) from j where ts <= timestamp '{THEN}' and ts >= timestamp '{THEN}' - interval {WINDOW} group by type""")
def graph_at_time(spark: SparkSession, folder: str) -> DataFrame:
    return g.TemporalGraph.load(spark, folder).at(THEN, WINDOW).type_counts()


@query(f"""
, f as (select id from n where type = 'Person' and json_extract_string(props, '$.department') = 'Biostatistics')
select 'node' kind, id from n where id in (select id from f) and created <= timestamp '{THEN}'
union all select 'edge', id from e where src in (select id from f) and dst in (select id from f) and created <= timestamp '{THEN}'
union all select 'event', id from j where ts <= timestamp '{THEN}' and id in (select id from part where entity_id in (select id from f))""")
def graph_focus(spark: SparkSession, folder: str) -> DataFrame:
    t = g.TemporalGraph.load(spark, folder)
    focus = t.of_type("Person").where(g.prop("department") == "Biostatistics").select("id")
    v = t.at(THEN).focus(focus)
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id")
    return tag(v.nodes, "node").unionByName(tag(v.edges, "edge")).unionByName(tag(v.events, "event"))


P = lambda k: f"json_extract_string(props, '$.{k}')"


@query(f"""
select id, coalesce(nullif(aliases[1], ''), nullif({P('name')}, ''), nullif({P('title')}, ''), nullif({P('statement')}, ''), id) question_label,
  coalesce({', '.join(f"case when trim({P(k)}) <> '' then {P(k)} end" for k in ('title', 'name', 'statement', 'issue_key', 'kind'))}, case when trim(aliases[1]) <> '' then aliases[1] end, id) model_label
from n""")
def node_labels(spark: SparkSession, folder: str) -> DataFrame:
    return g.TemporalGraph.load(spark, folder).nodes.select("id", g.question_label().alias("question_label"), g.model_label().alias("model_label"))


@query(f"""
select id, coalesce(nullif({P('name')}, ''), nullif({P('statement')}, ''), nullif({P('title')}, '')) canonical,
  len(list_distinct(list_filter(list_concat([coalesce(nullif({P('name')}, ''), nullif({P('statement')}, ''), nullif({P('title')}, ''))], coalesce(aliases, [])), lambda x: x <> ''))) n_surfaces
from n where len(list_filter(list_concat([coalesce(nullif({P('name')}, ''), nullif({P('statement')}, ''), nullif({P('title')}, ''))], coalesce(aliases, [])), lambda x: x <> '')) > 0""")
def alias_rows(spark: SparkSession, folder: str) -> DataFrame:
    some = lambda c: F.when(c != "", c)
    rows = g.TemporalGraph.load(spark, folder).nodes.withColumn("s", g.surfaces()).where(F.size("s") > 0)
    return rows.select("id", F.coalesce(some(g.prop("name")), some(g.prop("statement")), some(g.prop("title"))).alias("canonical"), F.size("s").cast("bigint").alias("n_surfaces"))


@query("""
, p as (select src id, dst nb, 'out' d from e union select dst, src, 'in' from e union select src, dst, 'both' from e union select dst, src, 'both' from e)
select d direction, p.id, count(distinct nb) n, string_agg(distinct nb, '|' order by nb) neighbors from p where p.id is not null and nb in (select id from n) group by d, p.id""")
def neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours of every entity in the three directions. A pair is made distinct and looked up once for all of them."""
    t = g.TemporalGraph.load(spark, folder)
    edges = read_table(spark, folder, "edges")  # copies of an edge give the same pair
    pairs = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), F.lit(True).alias("out")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbor"), F.lit(False).alias("out")))
    ways = F.when(F.bool_and("out"), F.array(F.lit("out"), F.lit("both"))).when(~F.bool_or("out"), F.array(F.lit("in"), F.lit("both"))).otherwise(F.array(F.lit("out"), F.lit("in"), F.lit("both")))
    met = pairs.where("id is not null and neighbor is not null").groupBy("neighbor", "id").agg(ways.alias("ways")).join(t.nodes.select(F.col("id").alias("neighbor")), "neighbor", "left_semi")
    return met.select(F.explode("ways").alias("direction"), "id", "neighbor").groupBy("direction", "id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("neighbor")), "|").alias("neighbors"))


@query("""
select distinct a.src, b.dst from e a join e b on a.dst = b.src join n t on t.id = a.dst join n d on d.id = b.dst
where a.type = 'leads' and b.type = 'part_of' and t.type = 'Project' and d.type = 'Department' and a.src is not null""")
def two_hop_department(spark: SparkSession, folder: str) -> DataFrame:
    """The departments of what each person leads. (No team of these tables is part of a department; that pair of hops is in the questions and in a test.)"""
    return g.TemporalGraph.load(spark, folder).two_hop("leads", "Project", "part_of", "Department").where("src is not null")


@query("select src, string_agg(distinct dst, '|' order by dst) targets from e where type = 'works_on' and src is not null and dst is not null group by src")
def group_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return g.TemporalGraph.load(spark, folder).grouped("works_on").select("src", joined("targets"))


@query("""
, c as (select type, src, dst from e where src is not null)
select 'members' what, dst id, count(distinct src) n from c where type = 'member_of' and dst in (select id from n where type = 'Team') group by dst
union all select 'reports', dst, count(distinct src) from c where type = 'reports_to' and dst in (select id from n where type = 'Person') group by dst
union all select 'teams', dst, count(distinct src) from c where type = 'part_of' and dst in (select id from n where type = 'Department') group by dst""")
def headcount(spark: SparkSession, folder: str) -> DataFrame:
    t = g.TemporalGraph.load(spark, folder)
    specs = (("members", "member_of", "Team"), ("reports", "reports_to", "Person"), ("teams", "part_of", "Department"))
    return reduce(DataFrame.unionByName, [t.headcount(e, ty).select(F.lit(w).alias("what"), "id", "n") for w, e, ty in specs])


@query("""
, m as (select distinct art.artifact_id src, entity_id dst from mentions join art on artifact_path = path)
select 'mentions:' || src || ':' || dst id, 'mentions' as "type", src, dst, n.created from m join n on n.id = src where dst in (select id from n)""")
def mention_edges(spark: SparkSession, folder: str) -> DataFrame:
    return g.mention_edges(read_table(spark, folder, "mentions"), g.TemporalGraph.load(spark, folder).nodes)


@query("select entity_id, string_agg(distinct artifact_id, '|' order by artifact_id) artifacts from mentions join art on artifact_path = path where entity_id is not null group by entity_id")
def groundings(spark: SparkSession, folder: str) -> DataFrame:
    return g.groundings(read_table(spark, folder, "mentions"), g.TemporalGraph.load(spark, folder).nodes).select("entity_id", joined("artifacts"))


def _provenance_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "provenance").select("target_id", F.explode("artifacts").alias("a")).select("target_id", F.col("a.path").alias("path")).where("target_id is not null and path is not null").distinct()


PROV = ", pv as (select distinct target_id, u.path from provenance, unnest(artifacts) t(u) where target_id is not null and u.path is not null)"


@query(PROV + """
, pa as (select target_id, artifact_id from pv join art using (path))
select 'expresses' kind, artifact_id, target_id, '' expressed_by from (select distinct artifact_id, target_id from pa where target_id in (select id from n) and artifact_id <> target_id)
union all select 'edge', '', target_id, string_agg(distinct artifact_id, '|' order by artifact_id) from pa where target_id in (select id from e) group by target_id""")
def provenance_split(spark: SparkSession, folder: str) -> DataFrame:
    """Provenance of nodes as artifact-node pairs, that of edges as a sorted list on the edge."""
    t = g.TemporalGraph.load(spark, folder)
    pairs = _provenance_pairs(spark, folder).join(g.artifacts_by_path(t.nodes), "path").select("target_id", "artifact_id").distinct()
    on_nodes = pairs.join(t.nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi").where("artifact_id <> target_id")
    on_edges = pairs.join(t.edges.select(F.col("id").alias("target_id")), "target_id", "left_semi").groupBy("target_id").agg(F.array_join(F.array_sort(F.collect_set("artifact_id")), "|").alias("expressed_by"))
    return on_nodes.select(F.lit("expresses").alias("kind"), "artifact_id", "target_id", F.lit("").alias("expressed_by")).unionByName(
        on_edges.select(F.lit("edge").alias("kind"), F.lit("").alias("artifact_id"), "target_id", "expressed_by")
    )


@query(PROV + """
, x as (select entity_id id, artifact_path path from mentions union select target_id, path from pv)
select n.id, count(distinct path) n_artifacts, string_agg(distinct path, '|' order by path) paths from x join n using (id) where path is not null group by n.id""")
def provenance_of_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Artifacts of each node by mention or provenance."""
    said = read_table(spark, folder, "mentions").select(F.col("entity_id").alias("id"), F.col("artifact_path").alias("path"))
    both = said.unionByName(_provenance_pairs(spark, folder).withColumnRenamed("target_id", "id")).distinct().where("path is not null")
    return both.join(g.TemporalGraph.load(spark, folder).nodes.select("id"), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n_artifacts"), F.array_join(F.array_sort(F.collect_set("path")), "|").alias("paths"))


@query(PROV + """
, i as (select case when e.type = 'expresses' then e.dst else target_id end target, path from pv left join e on e.id = target_id union select artifact_id, path from pv join art using (path))
select target, string_agg(distinct path, '|' order by path) paths from i where target is not null group by target""")
def provenance_invert(spark: SparkSession, folder: str) -> DataFrame:
    """Target to sorted paths; an expresses edge stands for what it expresses, and an artifact is grounded in itself."""
    t = g.TemporalGraph.load(spark, folder)
    pairs = _provenance_pairs(spark, folder)
    expresses = t.edges_of("expresses").select(F.col("id").alias("target_id"), "dst")
    meant = pairs.join(expresses, "target_id", "left").select(F.when(F.col("dst").isNotNull(), F.col("dst")).otherwise(F.col("target_id")).alias("target"), "path")
    own = pairs.join(g.artifacts_by_path(t.nodes), "path").select(F.col("artifact_id").alias("target"), "path")
    return meant.unionByName(own).distinct().groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("path")), "|").alias("paths"))


@query(f"select id, {P('name')} as \"name\", {P('title')} title, {P('unit')} unit, {P('department')} department, {P('seniority')} seniority, {P('handle')} handle, {P('desk')} desk, {P('site')} site from n where type = 'Person'")
def props_flat(spark: SparkSession, folder: str) -> DataFrame:
    return g.TemporalGraph.load(spark, folder).of_type("Person").select("id", *[g.prop(k).alias(k) for k in ("name", "title", "unit", "department", "seniority", "handle", "desk", "site")])


@query(f"""
, lab as (select id, coalesce({', '.join(f"case when trim({P(k)}) <> '' then {P(k)} end" for k in ('title', 'name', 'statement', 'issue_key', 'kind'))}, case when trim(aliases[1]) <> '' then aliases[1] end, id) l from n),
kv as (select id, k, json_extract(props, '$.' || k) v from (select id, props, unnest(json_keys(props)) k from n where props is not null)),
ent as (select id, 'ent:' || url_encode(id) s from (select id from n union select src from e union select dst from e) where id is not null)
select distinct s, p, o, is_iri from (
 select ent.s, 'rdf:type' p, 'type:' || n.type o, true is_iri from n join ent using (id)
 union all select ent.s, 'rdfs:label', l, false from lab join ent using (id)
 union all select ent.s, 'prop:' || k, case json_type(v) when 'BOOLEAN' then case when v::varchar = 'true' then 'True' else 'False' end else v->>'$' end, false from kv join ent using (id) where json_type(v) not in ('ARRAY', 'OBJECT', 'NULL')
 union all select a.s, 'rel:' || type, b.s, true from e join ent a on a.id = src join ent b on b.id = dst)""")
def rdf_triples(spark: SparkSession, folder: str) -> DataFrame:
    return g.triples(g.TemporalGraph.load(spark, folder))


@query(f"""
, p as (select id, {P('seniority')} s, {P('name')} m, {P('hired_on')} h from n where type = 'Person')
select 'eq' op, count(*) filter (s = 'senior') n from p union all select 'ne', count(*) filter (s <> 'senior') from p union all select 'in', count(*) filter (s in ('lead', 'principal')) from p
union all select 'contains', count(*) filter (contains(m, 'ae')) from p union all select 'gte', count(*) filter (h >= '2020-01-01') from p union all select 'lte', count(*) filter (h <= '2020-01-01') from p""")
def filter_ops(spark: SparkSession, folder: str) -> DataFrame:
    people = g.TemporalGraph.load(spark, folder).of_type("Person")
    tests = {"eq": ("seniority", "senior"), "ne": ("seniority", "senior"), "in": ("seniority", ["lead", "principal"]), "contains": ("name", "ae"), "gte": ("hired_on", "2020-01-01"), "lte": ("hired_on", "2020-01-01")}
    counted = people.agg(*[F.count_if(g.matches(g.prop(f), op, v)).alias(op) for op, (f, v) in tests.items()])
    return counted.select(F.expr("stack(6, " + ", ".join(f"'{o}', `{o}`" for o in tests) + ") as (op, n)"))


@query("select id, type, ts from j where type = 'ReviewComment' and list_contains(map_keys(actors), 'investigator') and project = 'project:study-larkmoor'")
def event_query(spark: SparkSession, folder: str) -> DataFrame:
    events = g.TemporalGraph.load(spark, folder).events
    return events.where(g.matches(F.col("type"), "eq", "ReviewComment") & g.matches(F.col("project"), "eq", "project:study-larkmoor") & F.map_contains_key("actors", F.lit("investigator"))).select("id", "type", "ts")


@query(f"""
, vn as (select id, created > timestamp '{THEN}' future from n where type in ('Person', 'Project', 'Team'))
select 'node' kind, id, future from vn union all
select 'edge', e.id, e.created > timestamp '{THEN}' from e where type in ('member_of', 'works_on') and src in (select id from vn) and dst in (select id from vn)""")
def visible_view(spark: SparkSession, folder: str) -> DataFrame:
    """What a viewer with these types switched on sees; what is younger than the cursor is flagged."""
    t = g.TemporalGraph.load(spark, folder)
    future = (F.col("created") > F.lit(THEN).cast("timestamp_ntz")).alias("future")
    nodes, edges = t.of_type("Person", "Project", "Team"), t.edges_of("member_of", "works_on")
    ids = nodes.select("id")
    shown = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes.select(F.lit("node").alias("kind"), "id", future).unionByName(shown.select(F.lit("edge").alias("kind"), "id", future))


def _diff(spark: SparkSession, folder: str) -> DataFrame:
    t = g.TemporalGraph.load(spark, folder)
    a, b = t.at(THEN, "120 days"), t.at(LATER, "120 days")
    return g.diff(a.nodes, b.nodes).withColumn("kind", F.lit("node")).unionByName(g.diff(a.edges, b.edges).withColumn("kind", F.lit("edge")))


DIFF = f"""
, a as (select 'node' kind, id, type from n where created <= timestamp '{THEN}' and created >= timestamp '{THEN}' - interval 120 days union all select 'edge', id, type from e where created <= timestamp '{THEN}' and created >= timestamp '{THEN}' - interval 120 days),
b as (select 'node' kind, id, type from n where created <= timestamp '{LATER}' and created >= timestamp '{LATER}' - interval 120 days union all select 'edge', id, type from e where created <= timestamp '{LATER}' and created >= timestamp '{LATER}' - interval 120 days),
c as (select coalesce(a.kind, b.kind) kind, coalesce(a.id, b.id) id, coalesce(b.type, a.type) as "type", case when a.id is null then 'added' when b.id is null then 'removed' else 'common' end change from a full join b on a.kind = b.kind and a.id = b.id)
"""


@query(DIFF + "select kind, id, type, change from c")
def run_diff(spark: SparkSession, folder: str) -> DataFrame:
    return _diff(spark, folder)


@query(DIFF + "select type, count(*) filter (change = 'added') added, count(*) filter (change = 'removed') removed from c where kind = 'node' and change <> 'common' group by type")
def diff_type_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return g.type_deltas(_diff(spark, folder).where("kind = 'node'"))


@query("""
, r(a, b) as (select src, dst from e where type = 'reports_to' and src is not null and dst is not null union select r.a, e.dst from r join e on e.src = r.b where e.type = 'reports_to' and e.dst is not null)
select a id, b ancestor from r""")
def mgmt_chain(spark: SparkSession, folder: str) -> DataFrame:
    with Workspace(spark, "chain") as ws:
        return traverse.closure(g.TemporalGraph.load(spark, folder).edges_of("reports_to"), ws).select(F.col("a").alias("id"), F.col("b").alias("ancestor"))


@query("""
, l as (select distinct src, dst from e where type = 'reports_to' and src is not null and dst is not null),
m as (select src, min(dst) dst from l group by src),
r(a, b) as (select src, dst from m union select r.a, m.dst from r join m on m.src = r.b),
x as (select src id, dst ancestor from l union select r.a, l.dst from r join l on l.src = r.b)
select id, ancestor from x where id <> ancestor""")
def ancestors(spark: SparkSession, folder: str) -> DataFrame:
    with Workspace(spark, "ancestors") as ws:
        return traverse.ancestors(g.TemporalGraph.load(spark, folder).edges_of("reports_to"), ws)


INFER = """
, l(t, a, b) as (select type, src, dst from e where src is not null and dst is not null),
rc(a, b) as (select a, b from l where t = 'reports_to' union select rc.a, l.b from rc join l on l.a = rc.b where t = 'reports_to'),
sg(a, b) as (select a, b from l where t = 'subgoal_of' union select sg.a, l.b from sg join l on l.a = sg.b where t = 'subgoal_of'),
si(a, b) as (select a, b from l where t = 'subinitiative_of' union select si.a, l.b from si join l on l.a = si.b where t = 'subinitiative_of'),
x as (select b s, 'der:manages' p, a o from l where t = 'reports_to' union select a, 'der:reports_to_chain', b from rc union select b, 'der:manages_chain', a from rc
 union select b, 'rel:collaborates_with', a from l where t = 'collaborates_with' and not exists (select 1 from l k where k.t = l.t and k.a = l.b and k.b = l.a)
 union select a, 'der:subgoal_of_chain', b from sg union select a, 'der:subinitiative_of_chain', b from si
 union select a, 'der:advances_goal_effective', b from l where t = 'advances_goal' union select l.a, 'der:advances_goal_effective', sg.b from l join sg on sg.a = l.b where t = 'advances_goal'
 union select m.a, 'der:in_department', q.b from l m join l q on q.a = m.b where m.t = 'member_of' and q.t = 'part_of'
 union select a, 'der:in_department', b from l where t = 'leads' and b in (select id from n where type = 'Department'))
"""


@query(INFER + "select s, p, o from x")
def inference(spark: SparkSession, folder: str) -> DataFrame:
    with Workspace(spark, "infer") as ws:
        return infer.infer(g.TemporalGraph.load(spark, folder), ws)


@query(INFER + "select p, count(*) n from x group by p")
def inferred_counts(spark: SparkSession, folder: str) -> DataFrame:
    return inference(spark, folder).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


START = "department:biostatistics"
HOPS = f"""
, u(a, b, id) as (select src, dst, id from e where src is not null and dst is not null union all select dst, src, id from e where src is not null and dst is not null),
h0 as (select '{START}' id, 0 hops), h1 as (select distinct b id, 1 hops from u join h0 on a = h0.id where b not in (select id from h0)),
h2 as (select distinct b id, 2 hops from u join h1 on a = h1.id where b not in (select id from h0 union select id from h1))
"""


@query(HOPS + "select 'node' kind, id, hops from h0 union all select 'node', * from h1 union all select 'node', * from h2 union all select distinct 'edge', u.id, -1 from u where a in (select id from h0 union select id from h1)")
def khop_subgraph(spark: SparkSession, folder: str) -> DataFrame:
    with Workspace(spark, "khop") as ws:
        t = g.TemporalGraph.load(spark, folder)
        nodes, edges = traverse.khop(t.edges, spark.range(1).select(F.lit(START).alias("id")), 2, ws)
        return nodes.select(F.lit("node").alias("kind"), "id", "hops").unionByName(edges.select(F.lit("edge").alias("kind"), "id", F.lit(-1).alias("hops")))


@query(f"""
, u(a, b) as (select src, dst from e where src is not null and dst is not null union select dst, src from e where src is not null and dst is not null),
d(id, hops) as (select '{START}', 0 union select b, hops + 1 from d join u on a = d.id where hops < 9),
m as (select id, min(hops) hops from d group by id)
select m.id, m.hops, min(k.id) via from m left join u on u.b = m.id left join m k on k.id = u.a and k.hops = m.hops - 1 group by m.id, m.hops""")
def shortest_hops(spark: SparkSession, folder: str) -> DataFrame:
    with Workspace(spark, "hops") as ws:
        return traverse.distances(g.TemporalGraph.load(spark, folder).edges, START, ws)


@query("""
, u(a, b) as (select src, dst from e where type = 'collaborates_with' and src is not null and dst is not null union select dst, src from e where type = 'collaborates_with' and src is not null and dst is not null),
r(a, b) as (select a, a from u union select r.a, u.b from r join u on u.a = r.b)
select a id, min(b) component from r group by a""")
def components(spark: SparkSession, folder: str) -> DataFrame:
    with Workspace(spark, "components") as ws:
        return traverse.components(g.TemporalGraph.load(spark, folder).edges_of("collaborates_with").select(F.col("src").alias("a"), F.col("dst").alias("b")), ws)


@query("""
, l as (select src a, dst b from e where type in ('reports_to', 'collaborates_with') and src is not null and dst is not null),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on l.a = r.b)
select x.a id, least(min(x.b), x.a) scc from r x join r y on x.a = y.b and x.b = y.a group by x.a""")
def strong_components(spark: SparkSession, folder: str) -> DataFrame:
    with Workspace(spark, "scc") as ws:
        return traverse.strong_components(g.TemporalGraph.load(spark, folder).edges_of("reports_to", "collaborates_with"), ws)


@query("""
, a as (select distinct json_extract_string(t.props, '$.department') dep, src from e join (select id, props from n where type = 'Team') t on t.id = e.dst where e.type = 'member_of' and src is not null)
select dep, count(*) n from a where dep is not null group by dep""")
def members_by_department(spark: SparkSession, folder: str) -> DataFrame:
    t = g.TemporalGraph.load(spark, folder)
    teams = t.of_type("Team").select(F.col("id").alias("dst"), g.prop("department").alias("dep"))
    return t.edges_of("member_of").where("src is not null").join(teams, "dst").where("dep is not null").select("dep", "src").distinct().groupBy("dep").agg(F.count(F.lit(1)).alias("n"))


@query("""
, s as (select id, lower(coalesce(json_extract_string(props, '$.name'), json_extract_string(props, '$.title'), '')) l, lower(id) i, lower(coalesce(props, '')) p, list_transform(coalesce(aliases, []), lambda x: lower(x)) al from n),
k as (select id, l, case when l = 'cohort' then 100.0 when contains(l, 'cohort') then 70 - 0.1 * (length(l) - 6) when len(list_filter(al, lambda x: contains(x, 'cohort'))) > 0 then 50.0::double when contains(p, 'cohort') then 45.0::double when contains(i, 'cohort') then 30.0::double end::double score from s)
select id, round(score, 6) score from k where score is not null order by score desc, l, id limit 50""")
def search_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The best fifty for a term."""
    return g.search(g.TemporalGraph.load(spark, folder).nodes, "Cohort").withColumn("score", F.round("score", 6))


@query("""
, l as (select id, lower(coalesce(nullif(aliases[1], ''), nullif(json_extract_string(props, '$.name'), ''), nullif(json_extract_string(props, '$.title'), ''), nullif(json_extract_string(props, '$.statement'), ''), id)) l, lower(coalesce(array_to_string(aliases, chr(1)), '')) a,
  list_transform(case when props is null then [] else json_keys(props) end, lambda k: lower(json_extract_string(props, '$.' || k))) v from n)
select id from l where contains(lower(id), 'dosing') or contains(l, 'dosing') or contains(a, 'dosing') or len(list_filter(v, lambda x: contains(x, 'dosing'))) > 0 order by id limit 20""")
def search_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first twenty in id order that hold a term anywhere."""
    return g.first_hits(g.TemporalGraph.load(spark, folder).nodes, "dosing")


@query("select id, type, (select greatest(count(*) - 50, 0) from n) dropped from n order by id limit 50")
def capped_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty rows and how many more there are."""
    return g.capped(g.TemporalGraph.load(spark, folder).nodes.select("id", "type"), ["id"])


@query(f"""
, u(a, b) as (select src, dst from e where src is not null and dst is not null and type in ('part_of', 'works_on', 'leads') union select dst, src from e where src is not null and dst is not null and type in ('part_of', 'works_on', 'leads')),
d(id, hops) as (select '{START}', 0 union select b, hops + 1 from d join u on a = d.id where hops < 12), m as (select id, min(hops) hops from d group by id),
w as (select m.id, m.hops, min(k.id) via from m join u on u.b = m.id join m k on k.id = u.a and k.hops = m.hops - 1 group by all),
b(id, hops) as (select id, hops from m where id = 'department:drug-safety' union all select w.via, w.hops - 1 from b join w on w.id = b.id and w.hops = b.hops)
select hops step, id from b""")
def shortest_path(spark: SparkSession, folder: str) -> DataFrame:
    """One shortest path between two departments over some edge types, the smallest predecessor at every step."""
    with Workspace(spark, "path") as ws:
        return traverse.shortest_path(g.TemporalGraph.load(spark, folder).edges_of("part_of", "works_on", "leads"), START, "department:drug-safety", ws)


@query("""
select coalesce(type, '') as "type", count(*) n, count(*) filter (deleted_at is not null) n_deleted, count(*) filter (props is null) n_bare from n group by type""")
def node_states(spark: SparkSession, folder: str) -> DataFrame:
    nodes = g.TemporalGraph.load(spark, folder).nodes
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("deleted_at").isNotNull()).alias("n_deleted"), F.count_if(F.col("props").isNull()).alias("n_bare")).withColumn("type", F.coalesce("type", F.lit("")))


@query("select id, count(*) n_rows, count(distinct rev) n_revs, min(ingested_at) first_seen from nodes group by id having count(distinct rev) > 1", pre="")
def revision_history(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "nodes").groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("rev").alias("n_revs"), F.min(naive("ingested_at")).alias("first_seen"))
    return rows.where("n_revs > 1")
