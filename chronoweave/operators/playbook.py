"""Static checks of activation tables: dead triggers, reachability, unguarded circles, volume."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.traverse import activation_fixpoint, strong_components
from chronoweave.runtime import Workspace


def _edges(emits: DataFrame, watches: DataFrame) -> DataFrame:
    return emits.select(F.col("activation").alias("src"), "event").join(watches.select(F.col("activation").alias("dst"), "event"), "event").select("src", "dst").distinct()


def issues(activations: DataFrame, emits: DataFrame, watches: DataFrame, ws: Workspace, most_per_run: int = 100_000) -> DataFrame:
    """(kind, where): ``activations`` has activation, root, guarded, deliverable, staff, per_run; ``emits`` and ``watches`` activation and event.

    dead_trigger: a watched event nobody emits. unreachable: no root leads there. unguarded_cycle: a circle without a guard.
    no_deliverable, no_staff, volume: what the activation lacks or exceeds.
    """
    links = _edges(emits, watches)
    issue = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("where")).distinct()
    dead = watches.join(emits.select("event"), "event", "left_anti")
    alive = activation_fixpoint(links, activations.where("root").select("activation"), ws)
    lost = activations.join(alive.select(F.col("id").alias("activation")), "activation", "left_anti")
    circles = strong_components(links, ws).join(activations.select(F.col("activation").alias("id"), "guarded"), "id")
    open_ = circles.groupBy("scc").agg(F.bool_or("guarded").alias("any")).where("not any")
    parts = [
        issue(dead, "dead_trigger", "event"), issue(lost, "unreachable", "activation"), issue(open_, "unguarded_cycle", "scc"),
        issue(activations.where("deliverable is null"), "no_deliverable", "activation"), issue(activations.where("staff < 1"), "no_staff", "activation"),
        issue(activations.where(F.col("per_run") > most_per_run), "volume", "activation"),
    ]
    return reduce(DataFrame.unionByName, parts)
