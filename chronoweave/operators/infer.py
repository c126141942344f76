"""Rule inference, stratified: only the three closures iterate, every other rule is one pass over their results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.graph import TemporalGraph
from chronoweave.operators.traverse import closure
from chronoweave.runtime import Workspace


def infer(graph: TemporalGraph, ws: Workspace) -> DataFrame:
    """(s, p, o): derived facts as a set, without those stated already. ``rel:`` facts extend the stated relation, ``der:`` are new ones."""

    def rel(kind: str) -> DataFrame:
        return graph.edges_of(kind).where("src is not null and dst is not null").select(F.col("src").alias("s"), F.col("dst").alias("o")).distinct()

    def named(pairs: DataFrame, predicate: str) -> DataFrame:
        return pairs.select("s", F.lit(predicate).alias("p"), "o")

    def chain(kind: str) -> DataFrame:
        return closure(rel(kind).select(F.col("s").alias("src"), F.col("o").alias("dst")), ws).select(F.col("a").alias("s"), F.col("b").alias("o"))

    def turned(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("o").alias("s"), F.col("s").alias("o"))

    def through(pairs: DataFrame, onward: DataFrame) -> DataFrame:
        return pairs.select("s", F.col("o").alias("m")).join(onward.select(F.col("s").alias("m"), "o"), "m").select("s", "o")

    def both_ways(pairs: DataFrame, predicate: str, back: str) -> DataFrame:
        fact = lambda s, p, o: F.struct(F.col(s).alias("s"), F.lit(p).alias("p"), F.col(o).alias("o"))
        return pairs.select(F.inline(F.array(fact("s", predicate, "o"), fact("o", back, "s"))))

    reports, subgoals, subinits = chain("reports_to"), chain("subgoal_of"), chain("subinitiative_of")
    together, advances = rel("collaborates_with"), rel("advances_goal")
    departments = graph.of_type("Department").select(F.col("id").alias("o"))
    in_department = through(rel("member_of"), rel("part_of")).unionByName(rel("leads").join(departments, "o", "left_semi"))
    # each part is a set and has predicates of its own, so that what closures give needs no shuffle
    parts = [
        named(turned(rel("reports_to")), "der:manages"),
        both_ways(reports, "der:reports_to_chain", "der:manages_chain"),
        named(turned(together).join(together, ["s", "o"], "left_anti"), "rel:collaborates_with"),
        named(subgoals, "der:subgoal_of_chain"),
        named(subinits, "der:subinitiative_of_chain"),
        named(advances.unionByName(through(advances, subgoals)).distinct(), "der:advances_goal_effective"),
        named(in_department.distinct(), "der:in_department"),
    ]
    return reduce(DataFrame.unionByName, parts)
