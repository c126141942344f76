"""Attributes as known at event time: one sorted pass over the union of events and attribute changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.runtime import Workspace, hot_keys, shuffle_partitions

#: Ties in availability time: a change is taken before an event of the same instant ("not after" is inclusive).
CHANGE, EVENT = 0, 1


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def slice_cuts(rows: DataFrame, key: str, at: str) -> DataFrame:
    """(key, _cuts) of the keys with more than half a fair partition's rows: the times, from quantiles of the key's own, that cut it into fair slices.

    Keys and cuts together are some for each partition at most, so the result may be broadcast.
    """
    slices = max(2, shuffle_partitions(rows.sparkSession))
    hot = hot_keys(rows, [key])
    fine = rows.join(F.broadcast(hot), key).groupBy(key).agg(F.max("_pieces").alias("_pieces"), F.percentile_approx(_micros(at), [i / slices for i in range(1, slices)], 20 * slices).alias("_fine"))
    every_nth = F.transform(F.sequence(F.lit(1), F.col("_pieces") - 1), lambda i: F.col("_fine")[F.least((i * slices / F.col("_pieces")).cast("int"), F.lit(slices - 1)) - 1])
    # a time that takes up more than a slice gets one to itself: a cut just before it and one after
    crowded = F.filter(F.col("_fine"), lambda t, i: (i > 0) & (t == F.col("_fine")[i - 1]))
    cuts = F.array_sort(F.array_distinct(F.concat(every_nth, crowded, F.transform(crowded, lambda t: t - 1))))
    return fine.select(key, F.when(F.col("_pieces") > 1, cuts).otherwise(F.array().cast("array<bigint>")).alias("_cuts"))


def with_slice(rows: DataFrame, cuts: DataFrame, key: str, at: str) -> DataFrame:
    """``rows`` with _slice: how many cuts of its key lie before it; 0 for keys without cuts. Equal times share a slice.

    ``_alone`` says that the slice is one time and nothing else.
    """
    met = rows.join(F.broadcast(cuts), key, "left").withColumn("_at_micros", _micros(at))
    met = met.withColumn("_slice", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_at_micros"))), F.lit(0)))
    alone = (F.col("_slice") > 0) & (F.get("_cuts", F.col("_slice") - 1) + 1 == F.get("_cuts", "_slice"))
    return met.withColumn("_alone", F.coalesce(alone, F.lit(False))).withColumn("_slice", F.when(F.col("_cuts").isNull(), 0).otherwise(F.col("_slice"))).drop("_cuts", "_at_micros")


def carry_forward(events: DataFrame, changes: DataFrame, key: str, at: str, available: str, tracks: dict[str, Column], workspace: Workspace | None = None) -> DataFrame:
    """``events`` with one column per track: the best change among those available no later than the event.

    ``events`` has ``key`` and a time ``at``; ``changes`` has ``key`` and ``available``, and each track is an orderable
    expression over ``changes`` (null where a row is no change of that track). Both sides are united, sorted by key,
    time and priority, and the running maximum of each track is carried to the events. Rows with a null key or time on
    the change side never apply; an event with a null key or time gets null tracks, as does one with no earlier change.

    Columns of ``events`` named like a track are replaced. An empty side gives no rows or null tracks.

    The united rows are written once. Keys holding a large share of them are cut into slices of time at quantiles of that key's own times:
    each slice is sorted by itself, and the maxima of the earlier slices of its key are brought in from a table of one row
    per key and slice. A single time that fills a slice needs no order: its changes all come before its events, which are spread over
    tasks. Without such keys nothing of this is planned.
    """
    if workspace is None:
        with Workspace(events.sparkSession, "asof") as own:
            return carry_forward(events, changes, key, at, available, tracks, own)
    names = list(tracks)
    events = events.drop("_at", "_prio", "_slice", "_alone", "_sub", "_cuts", "_pieces", *names)
    left = events.withColumn("_at", F.col(at)).withColumn("_prio", F.lit(EVENT)).withColumns({n: F.lit(None).cast(changes.select(c).dtypes[0][1]) for n, c in tracks.items()})
    right = changes.where(F.col(key).isNotNull() & F.col(available).isNotNull()).select(F.col(key), F.col(available).alias("_at"), F.lit(CHANGE).alias("_prio"), *[c.alias(n) for n, c in tracks.items()])
    both = workspace.put(left.unionByName(right, allowMissingColumns=True), keep=True)
    cuts = workspace.put(slice_cuts(both, key, "_at"), keep=True)
    known = F.col(at).isNotNull()

    if cuts.isEmpty():
        running = Window.partitionBy(key).orderBy("_at", "_prio").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        carried = both.withColumns({n: F.max(n).over(running) for n in names}).where(F.col("_prio") == EVENT)
        return carried.withColumns({n: F.when(known, F.col(n)) for n in names}).drop("_at", "_prio")

    sliced = with_slice(both, cuts, key, "_at")
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(shuffle_partitions(both.sparkSession)))
    sliced = sliced.withColumn("_sub", F.when(F.col("_alone"), spread).otherwise(0))
    summary = with_slice(both.where(F.col("_prio") == CHANGE).join(F.broadcast(cuts.select(key)), key, "left_semi"), cuts, key, "_at").groupBy(key, "_slice").agg(*[F.max(n).alias(n) for n in names])
    every = cuts.select(key, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_slice")).join(summary, [key, "_slice"], "left")
    upto = Window.partitionBy(key).orderBy("_slice")
    earlier, inclusive = upto.rowsBetween(Window.unboundedPreceding, -1), upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = workspace.put(every.select(key, "_slice", *[F.max(n).over(w).alias(f"_{p}_{n}") for n in names for p, w in (("before", earlier), ("upto", inclusive))]), keep=True)

    running = Window.partitionBy(key, "_slice", "_sub").orderBy("_at", "_prio").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = sliced.withColumns({n: F.max(n).over(running) for n in names}).where(F.col("_prio") == EVENT)
    best = {n: F.when(known, F.greatest(n, F.when(F.col("_alone"), F.col(f"_upto_{n}")).otherwise(F.col(f"_before_{n}")))) for n in names}
    out = carried.join(F.broadcast(before), [key, "_slice"], "left").withColumns(best)
    return out.drop("_at", "_prio", "_slice", "_alone", "_sub", *[f"_{p}_{n}" for n in names for p in ("before", "upto")])


def before_slices(rows: DataFrame, cuts: DataFrame, key: str, at: str, of: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with _slice, and (key, _slice, one column each of ``of``): an aggregate over each slice of the cut keys, for what a window brings in from before its slice."""
    sliced = with_slice(rows, cuts, key, at).drop("_alone")
    return sliced, sliced.join(F.broadcast(cuts.select(key)), key, "left_semi").groupBy(key, "_slice").agg(*[c.alias(n) for n, c in of.items()])
