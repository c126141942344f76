"""Queries that send the tables through the readers, writers, checks and scalar functions of a run on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import stable
from chronoweave.operators import graph as g
from chronoweave.operators import journal, playbook, text, validate
from chronoweave.plans.graph_queries import PRE
from chronoweave.runtime import Workspace, read_table
from chronoweave.sources import exports, runs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, pre: str = PRE):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = pre + sql
        return f

    return add


def _there_and_back(df: DataFrame, table: str, ws: Workspace) -> DataFrame:
    """The rows as canonical JSON lines of a run and read again, strictly; what is returned is a table of its own."""
    runs.write_table(df, ws.root, table)
    return ws.put(runs.read_table(df.sparkSession, ws.root, table), keep=True)


@query("select distinct id, type, created_at, props, array_to_string(aliases, '|') aliases from recon_nodes", pre="")
def jsonl_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes written as sorted canonical lines and read strictly: nulls, quotes and line breaks survive."""
    with Workspace(spark, "jsonl") as ws:
        rows = _there_and_back(read_table(spark, folder, "recon_nodes").select("id", "type", "created_at", "props", "aliases").distinct(), "nodes", ws)
        return rows.withColumn("aliases", F.array_join("aliases", "|"))


@query("select id, type, ts, parent_event, coalesce(len(subjects), 0) n_subjects, coalesce(cardinality(actors), 0)::bigint n_roles from j")
def journal_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The journal written in (timestamp, id) order and read again with its maps and lists."""
    events = g.TemporalGraph.load(spark, folder).events
    with Workspace(spark, "journal") as ws:
        rows = _there_and_back(events.select("id", "type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "actors", "subjects", "parent_event"), "events", ws)
        return rows.select("id", "type", F.col("timestamp").cast("timestamp_ntz").alias("ts"), "parent_event", F.coalesce(F.size("subjects"), F.lit(0)).cast("bigint").alias("n_subjects"), F.coalesce(F.size("actors"), F.lit(0)).cast("bigint").alias("n_roles"))


@query("""select min("timestamp") "first", max("timestamp") "last" from run_clinical_study where trim("timestamp") <> '' """, pre="")
def time_range(spark: SparkSession, folder: str) -> DataFrame:
    return runs.time_range(read_table(spark, folder, "run_clinical_study"))


@query("""
select 'nodes' "table", id, f field from (select id, unnest([case when id is null then 'id' end, case when type is null then 'type' end, case when created_at is null then 'created_at' end]) f from recon_nodes) where f is not null""", pre="")
def schema_issues(spark: SparkSession, folder: str) -> DataFrame:
    return runs.schema_issues(read_table(spark, folder, "recon_nodes"), "nodes")


_LIT = lambda x: f"chr(39) || replace(replace(replace({x}, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)), chr(10), chr(92) || 'n') || chr(39)"


@query(f"""
select '0' || id "position", 'MERGE (n:`' || type || '` {{id: ' || {_LIT('id')} || '}}) SET n.props = ' || {_LIT("coalesce(props, '{}')")} || ';' statement from n
union all select '1' || id, 'MATCH (a {{id: ' || {_LIT('src')} || '}}), (b {{id: ' || {_LIT('dst')} || '}}) MERGE (a)-[r:`' || upper(type) || '` {{id: ' || {_LIT('id')} || '}}]->(b);' from e where src in (select id from n) and dst in (select id from n)""")
def graph_statements(spark: SparkSession, folder: str) -> DataFrame:
    t = g.TemporalGraph.load(spark, folder)
    return exports.statements(t.nodes, t.edges)


@query("select 'node' kind, count(*) n, sum(length(id) + length(type)) size from n union all select 'link', count(*), sum(length(id) + length(type) + coalesce(length(src), 0) + coalesce(length(dst), 0)) from e")
def node_link_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The node-link lines, read back and summed."""
    t = g.TemporalGraph.load(spark, folder)
    v = exports.node_link(t.nodes, t.edges).select(F.from_json("line", "kind string, id string, type string, source string, target string, key string").alias("v")).select("v.*")
    size = lambda *cs: sum((F.coalesce(F.length(c), F.lit(0)) for c in cs), F.lit(0))
    return v.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(size("id", "key", "type", "source", "target")).cast("bigint").alias("size"))


@query("select id, json_extract_string(props, '$.name') \"name\", json_extract_string(props, '$.code') code, json_extract_string(props, '$.type') p_type, json_extract_string(props, '$.budget_band') budget_band from n where type = 'Project'")
def props_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The wide table of one type; a property named like a fixed column takes a prefix."""
    return exports.flattened(g.TemporalGraph.load(spark, folder).nodes, "Project", ["name", "code", "type", "budget_band"])


@query(r"""
with c as (select id, max(text) t, max(section) s from chunks group by id),
x as (select *, case when length(t) > 0 then length(t) // 2 else 0 end o, ' ' || coalesce(s, '') || ' ' p from c where t is not null)
select id, length(substr(t, 1, o)) - length(replace(substr(t, 1, o), chr(10), '')) + 1 as line, substr(t, greatest(0, o - 120) + 1, o + 10 + 120 - greatest(0, o - 120)) context,
 greatest(1, length(p) - 2) n_grams, sha256(id || chr(0) || coalesce(s, '') || chr(0)) request_key,
 case when o % 3 = 0 then 1.0 when o % 3 = 1 then least(1.0, o / 10.0) else 0.25 end confidence from x""", pre="")
def chunk_scalars(spark: SparkSession, folder: str) -> DataFrame:
    c = read_table(spark, folder, "chunks").groupBy("id").agg(F.max("text").alias("t"), F.max("section").alias("s")).where("t is not null")
    o = F.when(F.length("t") > 0, F.floor(F.length("t") / 2)).otherwise(0).cast("int")
    said = F.when(o % 3 == 0, F.lit("true")).when(o % 3 == 1, (o / 10.0).cast("string")).otherwise(F.lit("0.25"))
    return c.select(
        "id", stable.line_of(F.col("t"), o).cast("bigint").alias("line"), stable.context(F.col("t"), o, F.lit(10), F.lit("")).alias("context"),
        F.size(text.char_ngrams(F.coalesce("s", F.lit("")))).cast("bigint").alias("n_grams"), stable.request_key(F.col("id"), F.col("s")).alias("request_key"), stable.confidence(said).alias("confidence"),
    )


@query("""
with u as (select event_type model, event_id % 100 + 1 input_tokens, user_id % 50 output_tokens, event_id % 7 = 0 cached from events), p(model, a, b) as (values ('purchase', 3.0::double, 15.0::double), ('click', 0.25::double, 1.25::double))
select model, count(*) calls, round(sum(coalesce((input_tokens * a + output_tokens * b) / 1e6, 0)), 9) "cost" from u left join p using (model) where not cached group by model""", pre="")
def token_cost(spark: SparkSession, folder: str) -> DataFrame:
    usage = read_table(spark, folder, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 100 + 1).alias("input_tokens"), (F.col("user_id") % 50).alias("output_tokens"), (F.col("event_id") % 7 == 0).alias("cached"))
    prices = spark.createDataFrame([("purchase", 3.0, 15.0), ("click", 0.25, 1.25)], "model string, input_price double, output_price double")
    return stable.token_cost(usage, prices).withColumn("cost", F.round("cost", 9))


@query("""
with d(t) as (values ('2h'), ('30m'), ('1.5d'), ('day 2'), ('1..3'), ('soon'), ('')) select t "text", case t when '2h' then 7200.0 when '30m' then 1800.0 when '1.5d' then 43200.0 when 'day 2' then 57600.0 end::double "seconds" from d""", pre="")
def durations(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in ("2h", "30m", "1.5d", "day 2", "1..3", "soon", "")], "text string")
    return rows.select("text", journal.working_seconds(F.col("text")).alias("seconds"))


@query("select 'undeclared_type' kind, id \"where\", type detail from j where type not in ('VisitClosed', 'QueryRaised', 'QueryAnswered', 'ReviewComment')")
def undeclared_types(spark: SparkSession, folder: str) -> DataFrame:
    declared = spark.createDataFrame([(x,) for x in ("VisitClosed", "QueryRaised", "QueryAnswered", "ReviewComment")], "type string")
    return validate.undeclared_types(g.TemporalGraph.load(spark, folder).events, declared)


@query("""
, k as (select distinct p.type a, c.type b from j c join j p on p.id = c.parent_event), r(x) as (select type from j where trim(coalesce(parent_event, '')) = '' union select b from r join k on k.a = x),
cl(a, b) as (select a, b from k union select cl.a, k.b from cl join k on k.a = cl.b)
select 'unreachable' kind, type "where" from (select distinct type from j) where type not in (select x from r)
union all select 'unguarded_cycle', min(least(y.b, y.a)) from cl y where exists (select 1 from cl z where z.a = y.b and z.b = y.a) group by (select min(w.b) from cl w where w.a = y.a and exists (select 1 from cl z where z.a = w.b and z.b = w.a))
union all select 'no_deliverable', type from j group by type having max(deliverable) is null""")
def activation_issues(spark: SparkSession, folder: str) -> DataFrame:
    """The types of the journal as activations: which follow from none that starts a thread, which trigger themselves, which deliver nothing."""
    events = g.TemporalGraph.load(spark, folder).events
    parents = events.select(F.col("id").alias("parent_event"), F.col("type").alias("event"))
    watches = events.join(parents, "parent_event").select(F.col("type").alias("activation"), "event").distinct()
    acts = events.groupBy(F.col("type").alias("activation")).agg(
        F.bool_or(F.trim(F.coalesce("parent_event", F.lit(""))) == "").alias("root"), F.lit(False).alias("guarded"), F.max("deliverable").alias("deliverable"), F.lit(1).alias("staff"), F.lit(1).alias("per_run"),
    )
    with Workspace(spark, "activations") as ws:
        acts, watches = ws.put(acts, keep=True), ws.put(watches, keep=True)
        emits = acts.select("activation", F.col("activation").alias("event"))
        return ws.put(playbook.issues(acts, emits, watches, ws), keep=True)
