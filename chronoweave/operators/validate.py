"""Consistency and conformance: each check gives rows (kind, where, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.graph import TemporalGraph, participants
from chronoweave.operators.journal import is_working


def _issues(df: DataFrame, kind: str, where: str = "id", detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.col(where).alias("where"), (detail if detail is not None else F.lit("")).alias("detail"))


def dangling(t: TemporalGraph) -> DataFrame:
    """Edge ends, subjects, actors and parents that name nothing."""
    ids = t.nodes.select("id")
    ends = [
        _issues(t.edges.where(f"{c} is not null").join(ids.withColumnRenamed("id", c), c, "left_anti"), "dangling_edge", detail=F.concat(F.lit(f"{c}="), c)) for c in ("src", "dst")
    ]
    who = participants(t.events).join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti")
    named = who.select(F.when(F.col("role") == "subject", "dangling_subject").otherwise("dangling_actor").alias("kind"), F.col("id").alias("where"), F.concat("role", F.lit("="), "entity_id").alias("detail"))
    parents = t.events.where("trim(parent_event) <> ''").join(t.events.select(F.col("id").alias("parent_event")), "parent_event", "left_anti")
    return reduce(DataFrame.unionByName, [*ends, named.distinct(), _issues(parents, "dangling_parent", detail=F.col("parent_event"))])


def out_of_window(t: TemporalGraph, first: str, last: str) -> DataFrame:
    """Nodes, edges and events stamped outside the window; both ends belong to it."""
    out = lambda c: (F.col(c) < F.lit(first).cast("timestamp_ntz")) | (F.col(c) > F.lit(last).cast("timestamp_ntz"))
    parts = [_issues(df.where(out(c)), "out_of_window", detail=F.lit(k)) for df, c, k in ((t.nodes, "created", "node"), (t.edges, "created", "edge"), (t.events, "ts", "event"))]
    return reduce(DataFrame.unionByName, parts)


def child_before_parent(events: DataFrame) -> DataFrame:
    """Events stamped before their parent; a parent that is not there is not judged."""
    parents = events.select(F.col("id").alias("parent_event"), F.col("ts").alias("parent_ts"))
    return _issues(events.join(parents, "parent_event").where("ts < parent_ts"), "child_before_parent", detail=F.col("parent_event"))


def unresolved_replies(events: DataFrame) -> DataFrame:
    """Replies (in_reply_to, else parent_event) that name nothing or something later."""
    reply = F.coalesce(F.get_json_object("payload", "$.in_reply_to"), F.when(F.trim("parent_event") != "", F.col("parent_event")))
    asked = events.withColumn("reply", reply).where("reply is not null")
    met = asked.join(events.select(F.col("id").alias("reply"), F.col("ts").alias("reply_ts")), "reply", "left")
    return met.where("reply_ts is null or reply_ts > ts").select(F.when(F.col("reply_ts").isNull(), "reply_unresolved").otherwise("reply_too_late").alias("kind"), F.col("id").alias("where"), F.col("reply").alias("detail"))


def outside_hours(events: DataFrame) -> DataFrame:
    return _issues(events.where(~is_working(F.col("ts"))), "outside_hours")


def repeated_participants(events: DataFrame) -> DataFrame:
    """An entity named more than once among the actors of one event."""
    acting = participants(events).where("role <> 'subject'").groupBy("id", "entity_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _issues(acting, "repeated_participant", detail=F.col("entity_id"))


def undeclared_types(events: DataFrame, declared: DataFrame) -> DataFrame:
    return _issues(events.join(declared.select(F.col(declared.columns[0]).alias("type")), "type", "left_anti"), "undeclared_type", detail=F.col("type"))


def summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
