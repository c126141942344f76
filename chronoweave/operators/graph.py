"""The temporal property graph: current state, point-in-time projection, adjacency, labels and views."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.times import iso, naive
from chronoweave.runtime import read_table


@dataclass(frozen=True)
class TemporalGraph:
    """nodes(id, type, created, props, aliases, deleted_at), edges(id, type, src, dst, created, props), events (the journal), one row per id."""

    nodes: DataFrame
    edges: DataFrame
    events: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> TemporalGraph:
        """The last revision of every node, and every edge and event once.

        What copies share is grouped by, not picked from them, so filters on it reach the Parquet scan and sums are hashed.
        """
        n = read_table(spark, folder, "nodes").withColumn("created", iso("created_at"))
        nodes = n.groupBy("id", "type").agg(
            *[F.max_by(c, "rev").alias(c) for c in ("created", "props")],
            # copies of one revision may lack the aliases
            F.max_by("aliases", F.struct("rev", F.coalesce("aliases", F.array()))).alias("aliases"), F.max(naive("deleted_at")).alias("deleted_at")
        )
        e = read_table(spark, folder, "edges").withColumn("created", iso("created_at"))
        edges = e.groupBy("id", "type", "src", "dst").agg(*[F.max(c).alias(c) for c in ("created", "props")])
        j = read_table(spark, folder, "run_clinical_study").withColumn("ts", iso("timestamp"))
        events = j.groupBy("id", "type", "project").agg(
            *[F.max(c).alias(c) for c in ("ts", "initiative", "deliverable", "parent_event", "payload")],
            F.first("actors", ignorenulls=True).alias("actors"), F.first("subjects", ignorenulls=True).alias("subjects"),
        )
        return cls(nodes, edges, events)

    def at(self, moment: str, window: str | None = None) -> TemporalGraph:
        """What existed at ``moment``: created no later and, with a window, no earlier than that long before. Both ends count."""
        end = F.lit(moment).cast("timestamp_ntz")
        inside = lambda c: (F.col(c) <= end) & ((F.col(c) >= end - F.expr(f"interval {window}")) if window else F.lit(True))
        return TemporalGraph(self.nodes.where(inside("created")), self.edges.where(inside("created")), self.events.where(inside("ts")))

    def focus(self, ids: DataFrame) -> TemporalGraph:
        """Nodes in the set; edges with both ends in the set itself; events that touch it by a subject or an actor."""
        ids = ids.select(F.col(ids.columns[0]).alias("_f")).distinct()
        edges = self.edges.join(ids, F.col("src") == F.col("_f"), "left_semi").join(ids, F.col("dst") == F.col("_f"), "left_semi")
        touching = participants(self.events).join(ids, F.col("entity_id") == F.col("_f"), "left_semi").select("id").distinct()
        return replace(self, nodes=self.nodes.join(ids, F.col("id") == F.col("_f"), "left_semi"), edges=edges, events=self.events.join(touching, "id", "left_semi"))

    def of_type(self, *types: str) -> DataFrame:
        return self.nodes.where(F.col("type").isin(*types))

    def edges_of(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))

    def type_counts(self) -> DataFrame:
        count = lambda df, kind: df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
        return count(self.nodes, "node").unionByName(count(self.edges, "edge")).unionByName(count(self.events, "event"))

    def neighbors(self, direction: str = "both", types: Sequence[str] = ()) -> DataFrame:
        """(id, neighbor): distinct neighbours that exist as nodes. Edges are read once; a direction other than in, out or both raises."""
        if direction not in ("in", "out", "both"):
            raise ValueError(f"direction is in, out or both, not {direction!r}")
        edges = self.edges_of(*types) if types else self.edges
        sides = [("src", "dst")] * (direction != "in") + [("dst", "src")] * (direction != "out")
        pairs = reduce(DataFrame.unionByName, [edges.select(F.col(a).alias("id"), F.col(b).alias("neighbor")) for a, b in sides])
        return pairs.where("id is not null").distinct().join(self.nodes.select(F.col("id").alias("neighbor")), "neighbor", "left_semi").select("id", "neighbor")

    def two_hop(self, first: str, middle_type: str, second: str, last_type: str) -> DataFrame:
        """(src, dst) along ``first`` to a node of ``middle_type`` and ``second`` to one of ``last_type``."""
        middle, last = (self.of_type(t).select("id") for t in (middle_type, last_type))
        a = self.edges_of(first).select("src", F.col("dst").alias("mid")).join(middle.withColumnRenamed("id", "mid"), "mid", "left_semi")
        b = self.edges_of(second).select(F.col("src").alias("mid"), "dst").join(last.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return a.join(b, "mid").select("src", "dst").distinct()

    def grouped(self, edge_type: str) -> DataFrame:
        """Per source the sorted distinct targets."""
        return self.edges_of(edge_type).where("src is not null and dst is not null").groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))

    def headcount(self, edge_type: str, target_type: str) -> DataFrame:
        """(id, n, members): distinct sources per target of the type; targets without any give no row."""
        pairs = self.edges_of(edge_type).where("src is not null").select(F.col("dst").alias("id"), "src").distinct()
        return pairs.join(self.of_type(target_type).select("id"), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("src")).alias("members"))


def participants(events: DataFrame) -> DataFrame:
    """(id, entity_id, role): subjects have role 'subject'."""
    acting = events.select("id", F.explode("actors").alias("role", "who")).select("id", "role", F.explode("who").alias("entity_id"))
    named = events.select("id", F.lit("subject").alias("role"), F.explode("subjects").alias("entity_id"))
    return acting.unionByName(named).where("entity_id is not null")


def prop(name: str) -> Column:
    return F.get_json_object("props", f"$.{name}")


def filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def question_label() -> Column:
    """First alias, name, title, statement, the first that is not empty; else the id."""
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(F.get("aliases", F.lit(0))), some(prop("name")), some(prop("title")), some(prop("statement")), "id")


def model_label() -> Column:
    """Title, name, statement, issue_key, kind, first alias, the first that is not blank; else the id."""
    return F.coalesce(*[filled(prop(k)) for k in ("title", "name", "statement", "issue_key", "kind")], filled(F.get("aliases", F.lit(0))), "id")


def surfaces() -> Column:
    """The canonical name (name, statement or title) and then the distinct aliases that are not empty."""
    some = lambda c: F.when(c != "", c)
    head = F.coalesce(some(prop("name")), some(prop("statement")), some(prop("title")))
    return F.array_distinct(F.filter(F.concat(F.array(head), F.coalesce("aliases", F.array())), lambda x: x.isNotNull() & (x != "")))


def artifacts_by_path(nodes: DataFrame) -> DataFrame:
    """(path, artifact_id): the largest id where several artifacts claim a path."""
    return nodes.where("type = 'Artifact'").select("id", prop("path").alias("path")).where("path <> ''").groupBy("path").agg(F.max("id").alias("artifact_id"))


def mention_edges(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge per artifact and entity that both exist; it is as old as the artifact."""
    paths = artifacts_by_path(nodes)
    pairs = mentions.select(F.col("artifact_path").alias("path"), F.col("entity_id").alias("dst")).distinct().join(paths, "path").select(F.col("artifact_id").alias("src"), "dst").distinct()
    there = pairs.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").join(nodes.select(F.col("id").alias("src"), "created"), "src")
    return there.select(F.concat(F.lit("mentions:"), "src", F.lit(":"), "dst").alias("id"), F.lit("mentions").alias("type"), "src", "dst", "created")


def groundings(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per entity the sorted distinct artifacts that mention it; unknown paths are left out."""
    pairs = mentions.select(F.col("artifact_path").alias("path"), "entity_id").distinct().join(artifacts_by_path(nodes), "path")
    return pairs.where("entity_id is not null").groupBy("entity_id").agg(F.array_sort(F.collect_set("artifact_id")).alias("artifacts"))


def triples(graph: TemporalGraph) -> DataFrame:
    """(s, p, o, is_iri) as a set: type, label, scalar properties and edges; lists and objects are left out."""
    iri = lambda c: F.concat(F.lit("ent:"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")))
    nodes, edges = graph.nodes, graph.edges
    kinds = nodes.select(iri("id").alias("s"), F.lit("rdf:type").alias("p"), F.concat(F.lit("type:"), "type").alias("o"), F.lit(True).alias("is_iri"))
    labels = nodes.select(iri("id").alias("s"), F.lit("rdfs:label").alias("p"), model_label().alias("o"), F.lit(False).alias("is_iri"))
    flat = nodes.select("id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v")).where("v is not null and not v rlike '^[\\\\[{]'")
    text = F.when(F.col("v") == "true", "True").when(F.col("v") == "false", "False").otherwise(F.col("v"))
    scalars = flat.select(iri("id").alias("s"), F.concat(F.lit("prop:"), "k").alias("p"), text.alias("o"), F.lit(False).alias("is_iri"))
    links = edges.where("src is not null and dst is not null").select(iri("src").alias("s"), F.concat(F.lit("rel:"), "type").alias("p"), iri("dst").alias("o"), F.lit(True).alias("is_iri"))
    return reduce(DataFrame.unionByName, [kinds, labels, scalars, links]).distinct()


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, type, change): added, removed or common between two sides with id and type."""
    left, right = a.select("id", F.col("type").alias("type_a")).distinct(), b.select("id", F.col("type").alias("type_b")).distinct()
    change = F.when(F.col("type_a").isNull(), "added").when(F.col("type_b").isNull(), "removed").otherwise("common")
    return left.join(right, "id", "full_outer").select("id", F.coalesce("type_b", "type_a").alias("type"), change.alias("change"))


def type_deltas(changes: DataFrame) -> DataFrame:
    return changes.groupBy("type").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed")).where("added + removed > 0")


def search(nodes: DataFrame, term: str, limit: int = 50) -> DataFrame:
    """(id, score): the best nodes for a term, ties by label and id. Equal labels score 100, then the shorter the label that holds it, an alias, a property, the id.

    A blank term finds nothing. The limit is the operator's own.
    """
    term = term.strip().lower()
    label, t = F.lower(F.coalesce(prop("name"), prop("title"), F.lit(""))), F.lit(term)
    ladder = (
        F.when(label == t, 100.0).when(label.contains(t), 70 - 0.1 * (F.length(label) - len(term))).when(F.exists(F.coalesce("aliases", F.array()), lambda x: F.lower(x).contains(t)), 50.0)
        .when(F.lower(F.coalesce("props", F.lit(""))).contains(t), 45.0).when(F.lower("id").contains(t), 30.0)
    )
    rows = nodes.select("id", label.alias("l"), (ladder if term else F.lit(None).cast("double")).alias("score")).where("score is not null")
    return rows.orderBy(F.desc("score"), "l", "id").limit(limit).select("id", "score")


def first_hits(nodes: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """(id): the first nodes in id order whose id, label, alias or text property holds the term."""
    t = F.lit(term.strip().lower())
    texts = F.map_values(F.from_json("props", "map<string,string>"))
    held = F.lower("id").contains(t) | F.lower(question_label()).contains(t) | F.exists(F.concat(F.coalesce("aliases", F.array()), F.coalesce(texts, F.array())), lambda x: F.lower(x).contains(t))
    return nodes.where(F.coalesce(held, F.lit(False))).select("id").orderBy("id").limit(limit)


def capped(rows: DataFrame, order: Sequence[str], limit: int = 50) -> DataFrame:
    """The first ``limit`` rows in the given order, each with ``dropped``: how many were left out."""
    n = rows.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("dropped"))
    return rows.orderBy(*order).limit(limit).crossJoin(F.broadcast(n))  # one row


OPS = ("eq", "ne", "in", "contains", "gte", "lte")


def matches(field: Column, op: str, value: object) -> Column:
    """A filter in which a missing value never matches, not even ``ne``."""
    if op not in OPS:
        raise ValueError(f"unknown operator {op!r}")
    test = {
        "eq": lambda: field == F.lit(value), "ne": lambda: field != F.lit(value), "in": lambda: field.isin(*value),  # type: ignore[misc]
        "contains": lambda: field.contains(F.lit(value)), "gte": lambda: field >= F.lit(value), "lte": lambda: field <= F.lit(value),
    }[op]()
    return field.isNotNull() & test  # false and null is false, and the scan understands both parts
