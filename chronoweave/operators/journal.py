"""Journal operators: working time, conflicts, cadence, balance, threads, stock, lifecycles, bookings, conformance."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.operators.asof import before_slices, slice_cuts, with_slice

#: The working day in minutes from midnight, Monday to Friday.
OPEN, CLOSE = 9 * 60, 17 * 60




def is_working(t: Column) -> Column:
    """Whether the instant lies on a weekday from opening up to but not including closing."""
    return (F.weekday(t) < 5) & (F.hour(t) * 60 + F.minute(t) >= OPEN) & (F.hour(t) * 60 + F.minute(t) < CLOSE)


def next_working_start(t: Column) -> Column:
    """The earliest working instant that is not before ``t``."""
    day = F.date_trunc("day", t).cast("timestamp_ntz")
    late = F.hour(t) * 60 + F.minute(t) >= CLOSE
    skip = F.when(F.weekday(t) == 4, F.when(late, 3).otherwise(0)).when(F.weekday(t) == 5, 2).when(F.weekday(t) == 6, 1).otherwise(F.when(late, 1).otherwise(0))
    opening = day + F.make_dt_interval(skip, F.lit(OPEN // 60))
    return F.when(skip > 0, opening).otherwise(F.greatest(t, opening))


def advance(rows: DataFrame, t: str, hours: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: ``hours`` of working time after ``t``; landing on closing time is allowed, zero leaves ``t`` unchanged."""
    length = (CLOSE - OPEN) * 60
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    x = rows.withColumn("_hours", hours.cast("double")).withColumn("_start", next_working_start(F.col(t))).withColumn("_day", F.date_trunc("day", "_start").cast("timestamp_ntz"))
    x = x.withColumn("_total", seconds("_start") - seconds("_day") - OPEN * 60 + F.col("_hours") * 3600)
    x = x.withColumn("_days", F.greatest(F.ceil(F.col("_total") / length) - 1, F.lit(0)).cast("int"))
    x = x.withColumn("_over", F.floor((F.weekday("_start") + F.col("_days")) / 5).cast("int") * 2)
    moved = F.col("_day") + F.make_dt_interval(F.col("_days") + F.col("_over"), F.lit(OPEN // 60), F.lit(0), (F.col("_total") - F.col("_days") * length).cast("decimal(18,6)"))
    return x.withColumn(out, F.when(F.col("_hours") == 0, F.col(t)).otherwise(moved)).drop("_hours", "_start", "_day", "_total", "_days", "_over")


def working_seconds(text: Column) -> Column:
    """Seconds of working time in '2h', '30m', '1.5d' or 'day 2' (a day is a working day); null for anything else."""
    number = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1).cast("double")
    unit = F.lower(F.regexp_extract(text, r"^\s*(day|[0-9.]+\s*([mhd]))", 0))
    return F.when(unit.startswith("day") | unit.endswith("d"), number * (CLOSE - OPEN) * 60).when(unit.endswith("h"), number * 3600).when(unit.endswith("m"), number * 60)


def conflicts(bookings: DataFrame, person: str = "person") -> DataFrame:
    """Bookings that start before the latest end so far of the same person, with the booking that holds that end.

    Touching is no conflict; among equal ends the first holds. Rows without a person or a time are skipped. People with very
    many bookings are cut into slices of time; the latest end of the slices before is brought in from one row a slice.
    """
    rows = bookings.where(F.col(person).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()).select("id", person, "start", "end")
    cuts = slice_cuts(rows.select(person, "start"), person, "start")
    sliced = with_slice(rows, cuts, person, "start").drop("_alone")
    earlier = Window.partitionBy(person).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = sliced.join(F.broadcast(cuts.select(person)), person, "left_semi").groupBy(person, "_slice").agg(F.max("end").alias("_e"))
    carried = ends.select(person, "_slice", F.max("_e").over(earlier).alias("_carried"))
    here = Window.partitionBy(person, "_slice").orderBy("start", "end", "id").rowsBetween(Window.unboundedPreceding, -1)
    held = sliced.withColumn("_here", F.max("end").over(here)).join(F.broadcast(carried), [person, "_slice"], "left").withColumn("held", F.greatest("_here", "_carried"))
    late = held.where("start < held").select("id", person, "start", "end", "held")
    # the holder is the first booking with that end; it comes before this one, since the running maximum was reached there
    holders = rows.groupBy(person, F.col("end").alias("held")).agg(F.min_by("id", F.struct("start", "id")).alias("conflicts_with"))
    return late.join(holders, [person, "held"]).select("id", person, "start", "end", "conflicts_with")


def gini(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Gini coefficient of the counts of each group: 0 for an empty, single or all-zero group.

    Equal counts are counted together first, so what is sorted per group are its distinct counts, not its members.
    """
    w = Window.partitionBy(*by)
    runs = values.groupBy(*by, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_m"))
    placed = runs.withColumn("_below", F.coalesce(F.sum("_m").over(w.orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_m").over(w))
    # the i-th smallest of n weighs 2i - n - 1; over a run of m equal ones above s smaller ones that adds up to m(2s + m - n)
    moment = F.sum(F.col("_x") * F.col("_m") * (2 * F.col("_below") + F.col("_m") - F.col("_n")))
    n, total = F.sum("_m"), F.sum(F.col("_x") * F.col("_m"))
    return placed.groupBy(*by).agg(n.alias("n"), F.when(total > 0, moment / (n * total)).otherwise(0.0).alias("gini"))


def cadence(events: DataFrame, by: str = "type") -> DataFrame:
    """Per group: count, distinct days, and the mean gap in days between consecutive times."""
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 86_400e6
    n = F.count("ts")
    return events.groupBy(by).agg(n.alias("n"), F.countDistinct(F.to_date("ts")).alias("n_days"), F.when(n > 1, span / (n - 1)).otherwise(0.0).alias("mean_gap_days"))


def previous(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``rows`` (id, ts, ``value``) with _was: the value of the row before, in order of time and id within ``by``; null for the first.

    Keys with very many rows are cut into slices of time; the last value before a slice comes from one row a slice.
    """
    order = F.struct("ts", "id")
    sliced, ends = before_slices(rows, slice_cuts(rows.select(by, "ts"), by, "ts"), by, "ts", {"_end": F.max(F.struct(order.alias("o"), F.col(value).alias("v")))})
    earlier = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(by, "_slice", F.max("_end").over(earlier)["v"].alias("_before"), F.lit(True).alias("_cut"))
    here = Window.partitionBy(by, "_slice").orderBy("ts", "id")
    met = sliced.withColumn("_n", F.row_number().over(here)).withColumn("_here", F.lag(value).over(here)).join(F.broadcast(carried), [by, "_slice"], "left")
    return met.withColumn("_was", F.when(F.col("_cut") & (F.col("_n") == 1), F.col("_before")).otherwise(F.col("_here"))).drop("_slice", "_n", "_here", "_before", "_cut")


def triggers(readings: DataFrame, by: str, low: Column) -> DataFrame:
    """The first reading of each run of low ones; it is armed again once a reading is not low."""
    met = previous(readings.withColumn("_low", F.coalesce(low, F.lit(False))), by, "_low")
    return met.where("_low and not coalesce(_was, false)").drop("_low", "_was")


def has_overlap(bookings: DataFrame, person: str = "person") -> DataFrame:
    """(person, has_overlap): whether a booking starts before the one before it ends."""
    met = previous(bookings.select("id", person, F.col("start").alias("ts"), "end"), person, "end")
    return met.groupBy(person).agg(F.coalesce(F.bool_or(F.col("ts") < F.col("_was")), F.lit(False)).alias("has_overlap"))


def running_stock(demand: DataFrame, by: str, amount: str, initial: float) -> DataFrame:
    """Stock left after each demand: as demands are not negative, the clamped running difference is the clamped running sum.

    Keys with very many demands are cut into slices of time; what the slices before took comes from one row a slice.
    """
    taken = F.greatest(F.lit(0.0), F.col(amount))
    sliced, sums = before_slices(demand, slice_cuts(demand.select(by, "ts"), by, "ts"), by, "ts", {"_sum": F.sum(taken)})
    earlier = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(by, "_slice", F.sum("_sum").over(earlier).alias("_before"))
    here = Window.partitionBy(by, "_slice").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = sliced.withColumn("_here", F.sum(taken).over(here)).join(F.broadcast(carried), [by, "_slice"], "left")
    return met.withColumn("stock", F.greatest(F.lit(0.0), F.lit(initial) - F.col("_here") - F.coalesce("_before", F.lit(0.0)))).drop("_slice", "_here", "_before")


def lifecycle(starts: DataFrame, stages: Sequence[tuple[str, float]]) -> DataFrame:
    """One row per stage with the instant it is reached: lead times in working hours run on from the start."""
    reached, rows = 0.0, []
    for name, hours in stages:
        reached += hours
        rows.append(F.struct(F.lit(name).alias("stage"), F.lit(reached).alias("_reached")))
    each = starts.select("id", "ts", F.explode(F.array(*rows)).alias("s")).select("id", "ts", "s.*")
    return advance(each, "ts", F.col("_reached"), "at").select("id", "stage", "at")


def book(requests: DataFrame, person: str = "person") -> DataFrame:
    """Greedy booking per person in order of wish: the first gap of the working days that follow which is long enough.

    ``requests`` has id, person, wish and minutes. A request longer than a working day is forced: it takes the next working instant,
    whatever else is booked then. Each person's calendar is kept by one task as sorted intervals that do not touch, so a place is found by search;
    a person's requests are that person's own work.
    """

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        begins: list[pd.Timestamp] = []
        ends: list[pd.Timestamp] = []
        day = pd.Timedelta(minutes=CLOSE - OPEN)
        out = []
        for r in rows.sort_values(["wish", "id"]).itertuples():
            length = pd.Timedelta(minutes=float(r.minutes))
            at, forced = _working(r.wish), length > day
            while not forced:
                if at + length > at.normalize() + pd.Timedelta(minutes=CLOSE):
                    at = _working(at.normalize() + pd.Timedelta(days=1))
                    continue
                i = bisect_right(ends, at)
                if i == len(ends) or begins[i] >= at + length:
                    break
                at = _working(ends[i])
            i, j = bisect_left(ends, at), bisect_right(begins, at + length)
            begins[i:j], ends[i:j] = [min([at, *begins[i : i + 1]]) if i < j else at], [max([at + length, *ends[j - 1 : j]]) if i < j else at + length]
            out.append((r.id, getattr(r, person), at, at + length, forced))
        return pd.DataFrame(out, columns=["id", person, "start", "end", "forced"])

    kinds = dict(requests.dtypes)
    return requests.groupBy(person).applyInPandas(place, f"id {kinds['id']}, {person} {kinds[person]}, start timestamp_ntz, end timestamp_ntz, forced boolean")


def _working(t: pd.Timestamp) -> pd.Timestamp:
    day = t.normalize()
    if t.weekday() < 5 and t < day + pd.Timedelta(minutes=CLOSE):
        return max(t, day + pd.Timedelta(minutes=OPEN))
    day += pd.Timedelta(days=1)
    while day.weekday() > 4:
        day += pd.Timedelta(days=1)
    return day + pd.Timedelta(minutes=OPEN)


def expand_cadence(spans: DataFrame, rule: str) -> DataFrame:
    """(id, at) of a rule between first and last day: 'daily:workdays', 'weekly:MON', 'every:2w' or 'every:3d', at opening time."""
    days = spans.select("id", "first", F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("day"))
    kind, _, rest = rule.partition(":")
    if kind == "daily":
        kept = days.where(F.weekday("day") < 5)
    elif kind == "weekly":
        kept = days.where(F.date_format("day", "EEE") == rest.title())
    elif kind == "every":
        step = int(rest[:-1]) * (7 if rest.endswith("w") else 1)
        kept = days.where(F.datediff("day", "first") % step == 0)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return kept.select("id", (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(OPEN // 60))).alias("at"))


def slug(text: Column, fallback: str = "x") -> Column:
    """Lower case, other than letters a to z and digits to single hyphens, none at the ends; the fallback if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.when(s != "", s), F.lit(fallback))


def numbered(rows: DataFrame, base: str, order: Sequence[str]) -> DataFrame:
    """Ids made unique: the n-th holder of a base in the given order gets -n from the second on."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return rows.withColumn("unique_id", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n)))


def rank_score(load: Column, affinity: Column, most: Column, match: Column) -> Column:
    """Floor plus weighted affinity, idleness and expertise: 0.1 + affinity share + 0.5 of the inverse load + 0.5 if matched."""
    return 0.1 + F.when(most > 0, affinity / most).otherwise(0.0) + 0.5 / (1 + load) + 0.5 * match.cast("int")


