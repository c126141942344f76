"""The journal as a stream: late and repeated events, windowed counts, edge-triggered alerts with keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def once(events: DataFrame, key: str, time: str, delay: str = "2 hours") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts(events: DataFrame, time: str, by: str, window: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Counts per window and group; what is later than the watermark is dropped by the engine, and a window is final once it passes."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, delay).groupBy(w, by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def _alerts(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    was = bool(state.get[0]) if state.exists else False
    rows = pd.concat(list(frames)).sort_values(["ts", "id"])
    out = []
    for r in rows.itertuples():
        low = bool(r.low)
        if low and not was:
            out.append((key[0], r.id, r.ts))
        was = low
    state.update((was,))
    yield pd.DataFrame(out, columns=["key", "id", "ts"])


def alerts(readings: DataFrame) -> DataFrame:
    """(key, id, ts) of the first low reading of each run, across batches: ``readings`` has key, id, ts and low. State is one flag per key."""
    kinds = dict(readings.dtypes)
    return readings.groupBy("key").applyInPandasWithState(_alerts, f"key {kinds['key']}, id {kinds['id']}, ts {kinds['ts']}", "was boolean", "append", GroupStateTimeout.NoTimeout)
