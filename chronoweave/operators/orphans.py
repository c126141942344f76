"""References to records that do not exist: a fixpoint cascade over a foreign-key graph."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.runtime import Workspace

REFS = "tab string, row_key string, field_name string, ref_id string, arrived timestamp_ntz"


@dataclass(frozen=True)
class ForeignKey:
    """``tab.field_name`` names a record of one of ``targets``; ``rows`` has row_key, ref_id and arrived."""

    tab: str
    field_name: str
    rows: DataFrame
    targets: tuple[str, ...]


def references(keys: Sequence[ForeignKey]) -> DataFrame:
    """One row per record and field with its first arrival. Null and blank references are left out; so are null row keys'
    duplicates: a record delivered twice counts once, at its earliest arrival."""
    parts = [
        k.rows.select(F.lit(k.tab).alias("tab"), F.col("row_key"), F.lit(k.field_name).alias("field_name"), F.col("ref_id"), F.col("arrived")).where(F.trim("ref_id") != "")
        for k in keys
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("tab", "row_key", "field_name", "ref_id").agg(F.min("arrived").alias("arrived"))


def direct_orphans(keys: Sequence[ForeignKey], records: dict[str, DataFrame], refs: DataFrame | None = None) -> DataFrame:
    """References that fail at their record's arrival, with state missing, deleted or late.

    ``records[name]`` has id, first_seen and deleted_at (null if never). The target side is reduced to one row per id
    before the join, so a hot reference meets exactly one target row and the join never multiplies; its rows are
    split by adaptive skew handling, as nothing after the join needs the same partitioning. ``refs`` are the ``references(keys)`` if
    they are at hand.
    """
    refs = references(keys) if refs is None else refs
    out = []
    for names in sorted({k.targets for k in keys}):
        known = reduce(DataFrame.unionByName, [records[n].select("id", "first_seen", "deleted_at") for n in names])
        known = known.groupBy(F.col("id").alias("ref_id")).agg(F.min("first_seen").alias("first_seen"), F.max("deleted_at").alias("deleted_at"))
        mine = [(F.col("tab") == k.tab) & (F.col("field_name") == k.field_name) for k in keys if k.targets == names]
        out.append(refs.where(reduce(lambda a, b: a | b, mine)).join(known, "ref_id", "left"))
    state = (
        F.when(F.col("first_seen").isNull(), "missing")
        .when(F.col("deleted_at") <= F.col("arrived"), "deleted")
        .when(F.col("first_seen") > F.col("arrived"), "late")
    )
    joined = reduce(DataFrame.unionByName, out).withColumn("state", state)
    return joined.where("state is not null").select("tab", "row_key", "field_name", "ref_id", "arrived", "state")


def cascade(keys: Sequence[ForeignKey], records: dict[str, DataFrame], workspace: Workspace) -> DataFrame:
    """Direct and inherited orphans: (tab, row_key, field_name, ref_id, arrived, state, kind, depth).

    kind 'direct' has depth 0. A record that refers to an orphaned record, with no failing reference of its own
    through that field, is 'inherited' with state 'orphaned_parent' and the length of the shortest chain. The frontier
    of each round is semi-joined down the foreign-key graph and only its rows that are new go on. A round whose
    tables nobody refers to ends the loop without a Spark job; self-references iterate until nothing is new, so circles end.
    Nulls and blanks are no references. Empty tables give no rows. Columns beyond those named are ignored.
    """
    refs = workspace.put(references(keys))
    direct = workspace.put(direct_orphans(keys, records, refs).withColumn("kind", F.lit("direct")).withColumn("depth", F.lit(0)), keep=True)
    found, frontier, tabs, depth = [direct], direct, {k.tab for k in keys}, 0
    while True:
        down = [k for k in keys if set(k.targets) & tabs]
        if not down:
            break
        depth += 1
        steps = []
        for k in down:
            for target in sorted(set(k.targets) & tabs):
                parents = frontier.where(F.col("tab") == target).select(F.col("row_key").alias("ref_id")).distinct()
                mine = refs.where((F.col("tab") == k.tab) & (F.col("field_name") == k.field_name))
                steps.append(mine.join(parents, "ref_id", "left_semi"))
        seen = reduce(DataFrame.unionByName, [f.select("tab", "row_key", "field_name", "ref_id") for f in found])
        fresh = reduce(DataFrame.unionByName, steps).distinct().join(seen, ["tab", "row_key", "field_name", "ref_id"], "left_anti")
        fresh = fresh.withColumn("state", F.lit("orphaned_parent")).withColumn("kind", F.lit("inherited")).withColumn("depth", F.lit(depth)).select(direct.columns)
        tabs = {k.tab for k in down}
        frontier = workspace.put(fresh, keep=True)
        found.append(frontier)
        if any(set(k.targets) & tabs for k in keys) and frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month of arrival, state and kind."""
    return orphans.groupBy("tab", F.date_format("arrived", "yyyy-MM").alias("month"), "kind", "state").agg(
        F.count(F.lit(1)).alias("n_refs"), F.countDistinct("ref_id").alias("n_targets")
    )
