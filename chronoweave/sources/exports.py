"""Exports of a graph: property-graph CSV and statements, node-link lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(c: Column) -> Column:
    """A text as a quoted literal."""
    return F.concat(F.lit("'"), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("'"))


def statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(position, statement): MERGE of every node, then of every edge whose ends exist, each in id order."""
    name = lambda c: F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))
    n = nodes.select(F.concat(F.lit("0"), "id").alias("position"), F.concat(F.lit("MERGE (n:"), name(F.col("type")), F.lit(" {id: "), literal(F.col("id")), F.lit("}) SET n.props = "), literal(F.coalesce("props", F.lit("{}"))), F.lit(";")).alias("statement"))
    ids = nodes.select("id")
    whole = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = whole.select(
        F.concat(F.lit("1"), "id").alias("position"),
        F.concat(F.lit("MATCH (a {id: "), literal(F.col("src")), F.lit("}), (b {id: "), literal(F.col("dst")), F.lit("}) MERGE (a)-[r:"), name(F.upper("type")), F.lit(" {id: "), literal(F.col("id")), F.lit("}]->(b);")).alias("statement"),
    )
    return n.unionByName(e)


def write_csv(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """One folder of CSV files per node type and per edge type."""
    for df, kind, columns in ((nodes, "nodes", ("id", "created", "props")), (edges, "edges", ("id", "src", "dst", "created", "props"))):
        df.select("type", *columns).write.mode("overwrite").partitionBy("type").option("header", True).option("emptyValue", "").csv(f"{folder}/{kind}")


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line per node and link of a directed multigraph."""
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), "id", "type", "props")).alias("line"))
    return n.unionByName(edges.select(F.to_json(F.struct(F.lit("link").alias("kind"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("id").alias("key"), "type")).alias("line")))


def flattened(nodes: DataFrame, node_type: str, keys: list[str]) -> DataFrame:
    """The wide table of one node type: names made safe, reserved ones prefixed, values as text."""
    reserved = {"id", "type", "label", "order", "group"}  # fixed value: names that a property may not take
    safe = lambda k: (lambda s: f"p_{s}" if s in reserved or s[:1].isdigit() else s)("".join(c if c.isalnum() else "_" for c in k.lower()))
    return nodes.where(F.col("type") == node_type).select("id", *[F.get_json_object("props", f"$.{k}").alias(safe(k)) for k in keys])
