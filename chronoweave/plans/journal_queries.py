"""Queries on the journal and on bookings of the driver's events table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import graph as g
from chronoweave.operators import asof, journal, validate
from chronoweave.plans.graph_queries import PRE
from chronoweave.runtime import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}
FIRST, LAST = "2027-02-01 00:00:00", "2027-11-30 00:00:00"


def query(sql: str | None = None, pre: str = PRE):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = pre + sql
        return f

    return add


def journal_of(spark: SparkSession, folder: str) -> DataFrame:
    return g.TemporalGraph.load(spark, folder).events


DANGLING = """
, iss as (
 select 'dangling_edge' kind, id "where", 'src=' || src detail from e where src is not null and src not in (select id from n)
 union all select 'dangling_edge', id, 'dst=' || dst from e where dst is not null and dst not in (select id from n)
 union all select distinct case when role = 'subject' then 'dangling_subject' else 'dangling_actor' end, id, role || '=' || entity_id from part where entity_id not in (select id from n)
 union all select 'dangling_parent', id, parent_event from j where trim(parent_event) <> '' and parent_event not in (select id from j))
"""


@query(DANGLING + "select * from iss")
def dangling_references(spark: SparkSession, folder: str) -> DataFrame:
    return validate.dangling(g.TemporalGraph.load(spark, folder))


OUT = f"""
, oow as (select 'out_of_window' kind, id "where", 'node' detail from n where created < timestamp '{FIRST}' or created > timestamp '{LAST}'
 union all select 'out_of_window', id, 'edge' from e where created < timestamp '{FIRST}' or created > timestamp '{LAST}'
 union all select 'out_of_window', id, 'event' from j where ts < timestamp '{FIRST}' or ts > timestamp '{LAST}')
"""


@query(OUT + "select * from oow")
def out_of_window(spark: SparkSession, folder: str) -> DataFrame:
    return validate.out_of_window(g.TemporalGraph.load(spark, folder), FIRST, LAST)


BEFORE = ", cbp as (select 'child_before_parent' kind, c.id \"where\", c.parent_event detail from j c join j p on c.parent_event = p.id where c.ts < p.ts)"


@query(BEFORE + "select * from cbp")
def child_before_parent(spark: SparkSession, folder: str) -> DataFrame:
    return validate.child_before_parent(journal_of(spark, folder))


REPLY = """
, rp as (select *, coalesce(case when json_valid(payload) then json_extract_string(payload, '$.in_reply_to') end, case when trim(parent_event) <> '' then parent_event end) reply from j),
rr as (select case when p.id is null then 'reply_unresolved' else 'reply_too_late' end kind, rp.id "where", reply detail from rp left join j p on p.id = reply where reply is not null and (p.ts is null or p.ts > rp.ts))
"""


@query(REPLY + "select kind, \"where\", detail from rr")
def unresolved_replies(spark: SparkSession, folder: str) -> DataFrame:
    return validate.unresolved_replies(journal_of(spark, folder))


OFF = ", off as (select 'outside_hours' kind, id \"where\", '' detail from j where not (isodow(ts) < 6 and hour(ts) between 9 and 16))"


@query(OFF + "select * from off")
def outside_hours(spark: SparkSession, folder: str) -> DataFrame:
    return validate.outside_hours(journal_of(spark, folder))


@query("select 'repeated_participant' kind, id \"where\", entity_id detail from part where role <> 'subject' group by id, entity_id having count(*) > 1")
def repeated_participants(spark: SparkSession, folder: str) -> DataFrame:
    return validate.repeated_participants(journal_of(spark, folder))


@query(DANGLING + OUT + BEFORE + OFF + "select kind, count(*) n from (select * from iss union all select * from oow union all select * from cbp union all select * from off) group by kind")
def issue_summary(spark: SparkSession, folder: str) -> DataFrame:
    t = g.TemporalGraph.load(spark, folder)
    return validate.summary(reduce(DataFrame.unionByName, [validate.dangling(t), validate.out_of_window(t, FIRST, LAST), validate.child_before_parent(t.events), validate.outside_hours(t.events)]))


@query("""
, u as (select count(*) total, count(*) filter (entity_id is null or trim(entity_id) = '' or entity_id not in (select id from n)) unresolved from mentions)
select total, unresolved, round(case when total = 0 then 1 else 1 - unresolved / total end, 6) resolve_rate, case when total = 0 then true else 1 - unresolved / total > 0.9 end ok from u""")
def mention_resolution(spark: SparkSession, folder: str) -> DataFrame:
    ids = g.TemporalGraph.load(spark, folder).nodes.select(F.col("id").alias("entity_id"), F.lit(True).alias("there"))
    rows = read_table(spark, folder, "mentions").join(ids, "entity_id", "left").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("there").isNull() | (F.trim("entity_id") == "")).alias("unresolved"))
    rate = F.when(F.col("total") == 0, 1.0).otherwise(1 - F.col("unresolved") / F.col("total"))
    return rows.select("total", "unresolved", F.round(rate, 6).alias("resolve_rate"), (rate > 0.9).alias("ok"))


@query("select id, parent_event, p.type parent_type, date_diff('second', p.ts, c.ts) lag_s from (select id, parent_event, ts from j) c join (select id pid, type, ts from j) p on p.pid = c.parent_event")
def thread_parents(spark: SparkSession, folder: str) -> DataFrame:
    events = journal_of(spark, folder)
    parents = events.select(F.col("id").alias("parent_event"), F.col("type").alias("parent_type"), F.col("ts").alias("parent_ts"))
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return events.join(parents, "parent_event").select("id", "parent_event", "parent_type", (seconds("ts") - seconds("parent_ts")).alias("lag_s"))


@query("select type, count(ts) n, count(distinct ts::date) n_days, round(case when count(ts) > 1 then date_diff('microsecond', min(ts), max(ts)) / 86400e6 / (count(ts) - 1) else 0 end, 6) mean_gap_days from j group by type")
def cadence_plausibility(spark: SparkSession, folder: str) -> DataFrame:
    return journal.cadence(journal_of(spark, folder)).withColumn("mean_gap_days", F.round("mean_gap_days", 6))


@query("select type, round(avg(case when isodow(ts) < 6 and hour(ts) between 9 and 16 then 1.0 else 0.0 end), 6) share from j group by type")
def working_hours_adherence(spark: SparkSession, folder: str) -> DataFrame:
    return journal_of(spark, folder).groupBy("type").agg(F.round(F.avg(journal.is_working(F.col("ts")).cast("double")), 6).alias("share"))


GINI = """
, c as (select {by} k, entity_id, count(*) x from part join j using (id) where role <> 'subject' and {where} group by all),
r as (select k, x, row_number() over (partition by k order by x) i, count(*) over (partition by k) n, sum(x) over (partition by k) s from c)
"""


@query(GINI.format(by="role", where="true") + "select k \"role\", any_value(n) n, round(sum((2 * i - n - 1) * x) / (any_value(n) * any_value(s)), 6) gini from r group by k")
def role_balance(spark: SparkSession, folder: str) -> DataFrame:
    counts = g.participants(journal_of(spark, folder)).where("role <> 'subject'").groupBy("role", "entity_id").agg(F.count(F.lit(1)).alias("x"))
    return journal.gini(counts, ["role"], "x").select("role", "n", F.round("gini", 6).alias("gini"))


@query(GINI.format(by="type", where="type like '%Comment'") + "select k \"type\", any_value(n) n, round(1 - sum((2 * i - n - 1) * x) / (any_value(n) * any_value(s)), 6) balance from r group by k")
def comments_per_reviewer(spark: SparkSession, folder: str) -> DataFrame:
    events = journal_of(spark, folder).where("type like '%Comment'")
    counts = g.participants(events).where("role <> 'subject'").join(events.select("id", "type"), "id").groupBy("type", "entity_id").agg(F.count(F.lit(1)).alias("x"))
    return journal.gini(counts, ["type"], "x").select("type", "n", F.round(1 - F.col("gini"), 6).alias("balance"))


def _bookings(spark: SparkSession, folder: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    return read_table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("person"), ts.alias("start"), (ts + F.expr("interval 1 hour")).alias("end"))


@query("""
with b as (select event_id id, user_id person, ts "start", ts + interval 1 hour "end", row_number() over (partition by user_id order by ts, ts + interval 1 hour, event_id) rn from events),
h as (select *, max("end") over w held, max(rn) over w prev from b window w as (partition by person order by rn rows between unbounded preceding and 1 preceding))
select h.id, h.person, h."start", h."end", (select x.id from b x where x.person = h.person and x.rn < h.rn and x."end" = h.held order by x.rn limit 1) conflicts_with from h where h."start" < held""", pre="")
def scheduling_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return journal.conflicts(_bookings(spark, folder))


@query("select user_id person, bool_or(ts < prev) has_overlap from (select user_id, ts, lag(ts + interval 1 hour) over (partition by user_id order by ts, event_id) prev from events) group by user_id", pre="")
def has_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return journal.has_overlap(_bookings(spark, folder))


SQL["has_overlap"] = SQL["has_overlap"].replace("bool_or(ts < prev)", "coalesce(bool_or(ts < prev), false)")


def _readings(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "event_type")


@query("select event_id id, user_id, value from (select *, coalesce(lag(value <= 5) over (partition by user_id order by ts, event_id), false) was from events) where value <= 5 and not was", pre="")
def edge_trigger_low(spark: SparkSession, folder: str) -> DataFrame:
    return journal.triggers(_readings(spark, folder), "user_id", F.col("value") <= 5).select("id", "user_id", "value")


@query("select event_id id, user_id, round(greatest(0.0, 1000.0 - sum(greatest(0, value)) over (partition by user_id order by ts, event_id rows unbounded preceding)), 4) stock from events where event_type = 'purchase'", pre="")
def running_stock(spark: SparkSession, folder: str) -> DataFrame:
    return journal.running_stock(_readings(spark, folder).where("event_type = 'purchase'"), "user_id", "value", 1000.0).select("id", "user_id", F.round("stock", 4).alias("stock"))


NEXT = """
case when isodow(ts) < 6 and hour(ts) < 17 then greatest(ts, date_trunc('day', ts) + interval 9 hour)
 else date_trunc('day', ts) + interval 9 hour + to_days(case isodow(ts) when 5 then 3 when 6 then 2 else 1 end::integer) end
"""


@query(f'select event_id id, {NEXT} "at" from events', pre="")
def next_working_start(spark: SparkSession, folder: str) -> DataFrame:
    return _readings(spark, folder).select("id", journal.next_working_start(F.col("ts")).alias("at"))


ADVANCE = """
with s as (select event_id id, {next} st from events),
x as (select id, st, date_trunc('day', st) d, date_diff('microsecond', date_trunc('day', st) + interval 9 hour, st) + {hours} * 3600000000 total from s),
y as (select *, greatest(ceil(total / 28800000000.0) - 1, 0)::bigint nd from x)
select id, {more} d + to_days((nd + 2 * ((isodow(st) - 1 + nd) // 5))::integer) + interval 9 hour + to_microseconds((total - nd * 28800000000)::bigint) "at" from y
"""


@query(ADVANCE.format(next=NEXT, hours=12, more=""), pre="")
def advance_working(spark: SparkSession, folder: str) -> DataFrame:
    return journal.advance(_readings(spark, folder), "ts", F.lit(12), "at").select("id", "at")


STAGES = (("draft", 0.5), ("approved", 7.5), ("sent", 4.0), ("received", 40.0))


@query(" union all ".join(f"select * from ({ADVANCE.format(next=NEXT.replace(chr(10), ' '), hours=h, more=repr(n) + ' stage,')})" for n, h in (("draft", 0.5), ("approved", 8.0), ("sent", 12.0), ("received", 52.0))), pre="")
def order_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    return journal.lifecycle(_readings(spark, folder), STAGES)


@query("""
, b as (select id, trim(regexp_replace(lower(trim(coalesce(json_extract_string(props, '$.name'), ''))), '[^a-z0-9]+', '-', 'g'), '-') s from n),
c as (select id, case when s = '' then 'x' else s end base from b)
select id, base, case when row_number() over (partition by base order by id) = 1 then base else base || '-' || row_number() over (partition by base order by id) end unique_id from c""")
def suffix_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = g.TemporalGraph.load(spark, folder).nodes.select("id", journal.slug(F.coalesce(g.prop("name"), F.lit(""))).alias("base"))
    return journal.numbered(rows, "base", ["id"])


@query("select event_type, user_id, arg_max(event_id, (ts, event_id)) last_id from events group by all", pre="")
def last_wins(spark: SparkSession, folder: str) -> DataFrame:
    return _readings(spark, folder).groupBy("event_type", "user_id").agg(F.max_by("id", F.struct("ts", "id")).alias("last_id"))


@query("select project, arg_max(id, (ts, id)) last_event, arg_min(id, (ts, id)) first_event, count(*) n from j where project is not null group by project")
def journal_order(spark: SparkSession, folder: str) -> DataFrame:
    order = F.struct("ts", "id")
    return journal_of(spark, folder).where("project is not null").groupBy("project").agg(F.max_by("id", order).alias("last_event"), F.min_by("id", order).alias("first_event"), F.count(F.lit(1)).alias("n"))


@query("""
, p as (select id, ts, project from j where type = 'QueryRaised'), a as (select id, ts, project from j where type = 'QueryAnswered')
select a.id, (select p.id from p where p.project = a.project and p.ts < a.ts order by p.ts desc, p.id desc limit 1) asked from a where project is not null""")
def asof_thread(spark: SparkSession, folder: str) -> DataFrame:
    """Each answer with the last question of its project that was asked strictly earlier."""
    events = journal_of(spark, folder).where("project is not null")
    asked = events.where("type = 'QueryRaised'").select("project", F.col("ts").alias("asked_at"), F.col("id").alias("question"), (F.col("ts") + F.expr("interval 1 microsecond")).alias("available"))
    answers = events.where("type = 'QueryAnswered'").select("id", "project", "ts")
    met = asof.carry_forward(answers, asked, "project", "ts", "available", {"last": F.struct("asked_at", F.col("question").alias("id"))})
    return met.select("id", F.col("last.id").alias("asked"))


@query("""
, s as (select id, json_extract_string(props, '$.started_on')::date first from n where type = 'Project' and json_extract_string(props, '$.started_on') is not null)
select id, d + interval 9 hour "at" from s, generate_series(first, first + interval 27 day, interval 1 day) t(d) where isodow(d) < 6""")
def cadence_daily(spark: SparkSession, folder: str) -> DataFrame:
    start = F.to_date(g.prop("started_on"))
    spans = g.TemporalGraph.load(spark, folder).of_type("Project").where(start.isNotNull()).select("id", start.alias("first"), F.date_add(start, 27).alias("last"))
    return journal.expand_cadence(spans, "daily:workdays")


@query("""
, b as (select least(src, dst) || '<->' || greatest(src, dst) pair, count(*) weight from e where type = 'collaborates_with' and src is not null and dst is not null group by 1)
select 'edge:collaborates_with:' || pair id, weight from b""")
def affinity(spark: SparkSession, folder: str) -> DataFrame:
    pairs = g.TemporalGraph.load(spark, folder).edges_of("collaborates_with").where("src is not null and dst is not null")
    key = F.concat(F.lit("edge:collaborates_with:"), F.least("src", "dst"), F.lit("<->"), F.greatest("src", "dst"))
    return pairs.groupBy(key.alias("id")).agg(F.count(F.lit(1)).alias("weight"))


@query("""
, ld as (select entity_id id, count(*) load from part where role <> 'subject' group by entity_id),
af as (select id, count(*) affinity from (select src id from e where type = 'collaborates_with' union all select dst from e where type = 'collaborates_with') group by id),
x as (select n.id, coalesce(load, 0) load, coalesce(affinity, 0) affinity, max(coalesce(affinity, 0)) over () most, contains(coalesce(props, ''), '"data review"') m from n left join ld using (id) left join af using (id) where n.type = 'Person')
select id, round(0.1 + case when most > 0 then affinity / most else 0 end + 0.5 / (1 + load) + 0.5 * m::integer, 6) score from x""")
def participant_rank(spark: SparkSession, folder: str) -> DataFrame:
    """How eligible each person is: affinity, idleness, expertise."""
    t = g.TemporalGraph.load(spark, folder)
    load = g.participants(t.events).where("role <> 'subject'").groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("load"))
    ends = t.edges_of("collaborates_with")
    ties = ends.select(F.col("src").alias("id")).unionByName(ends.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("affinity"))
    people = t.of_type("Person").select("id", "props").join(load, "id", "left").join(ties, "id", "left").na.fill(0, ["load", "affinity"])
    people = people.crossJoin(F.broadcast(people.agg(F.max("affinity").alias("most"))))
    score = journal.rank_score(F.col("load"), F.col("affinity"), F.col("most"), F.coalesce(F.col("props").contains('"data review"'), F.lit(False)))
    return people.select("id", F.round(score, 6).alias("score"))


@query()
def greedy_booking(spark: SparkSession, folder: str) -> DataFrame:
    requests = _readings(spark, folder).select("id", F.col("user_id").alias("person"), F.col("ts").alias("wish"), F.lit(45.0).alias("minutes"))
    return journal.book(requests)


@query("select event_id id, 'cal:' || event_id || ':' || user_id calendar_id, 'has_calendar_event' edge_type, user_id person from events where event_type = 'signup'", pre="")
def calendar_nodes(spark: SparkSession, folder: str) -> DataFrame:
    rows = _readings(spark, folder).where("event_type = 'signup'")
    return rows.select("id", F.concat(F.lit("cal:"), "id", F.lit(":"), "user_id").alias("calendar_id"), F.lit("has_calendar_event").alias("edge_type"), F.col("user_id").alias("person"))


@query("""
, act(kind, watches) as (values ('answer', 'QueryRaised'), ('triage', 'AeReported'), ('sign_off', 'AeTriaged'), ('review', 'ProtocolAmended'))
select distinct kind || '@' || j.id instance, kind, j.id event_id from j join act on watches = j.type where project is not null""")
def reactive_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """Each event starts the activities that watch its type; an instance starts once."""
    acts = spark.createDataFrame([("answer", "QueryRaised"), ("triage", "AeReported"), ("sign_off", "AeTriaged"), ("review", "ProtocolAmended")], "kind string, type string")
    met = journal_of(spark, folder).where("project is not null").join(F.broadcast(acts), "type")
    return met.select(F.concat("kind", F.lit("@"), "id").alias("instance"), "kind", F.col("id").alias("event_id")).dropDuplicates(["instance"])


@query("""
, m as (select project, min(ts) ts from j where type = 'VisitClosed' and project is not null group by project)
select project, id first_event from (select m.project, j.id, row_number() over (partition by m.project order by j.ts, j.id) rn from m join j on j.project = m.project and j.ts >= m.ts) where rn = 1""")
def condition_fires_once(spark: SparkSession, folder: str) -> DataFrame:
    """Per project the first event at or after its condition (a closed visit) first holds."""
    events = journal_of(spark, folder).where("project is not null")
    held = events.where("type = 'VisitClosed'").groupBy("project").agg(F.min("ts").alias("held"))
    return events.join(held, "project").where("ts >= held").groupBy("project").agg(F.min_by("id", F.struct("ts", "id")).alias("first_event"))


@query("select id, arg_max_null(json_extract_string(props, '$.title'), rev) title, arg_max_null(json_extract_string(props, '$.department'), rev) department from nodes where type = 'Person' group by id", pre="")
def last_write(spark: SparkSession, folder: str) -> DataFrame:
    """Effects that set a property: the last one written counts."""
    rows = read_table(spark, folder, "nodes").where("type = 'Person'")
    return rows.groupBy("id").agg(F.max_by(g.prop("title"), "rev").alias("title"), F.max_by(g.prop("department"), "rev").alias("department"))
