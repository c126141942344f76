"""Reproducible values: sub-seeds, arrivals, digests. What a fixed seed gives never depends on partitioning."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from chronoweave.runtime import small


def subseed(root: int, *parts: object) -> int:
    """64 bits of BLAKE2b over the root and its parts, joined by the unit separator."""
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, (root, *parts))).encode(), digest_size=8).digest(), "big")


@F.pandas_udf(LongType())
def subseed_column(root: pd.Series, part: pd.Series) -> pd.Series:
    """The same over columns, as a signed 64-bit value."""
    return pd.Series([(lambda v: v - (1 << 64) if v >= 1 << 63 else v)(subseed(r, p)) for r, p in zip(root, part, strict=True)])


def digest(config: dict, without: tuple[str, ...] = ("output_dir", "scale")) -> str:
    """SHA-256 of the configuration as compact sorted JSON, without what does not shape the result."""
    kept = {k: v for k, v in config.items() if k not in without}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def request_key(*fields: Column) -> Column:
    """SHA-256 over the fields, each followed by NUL."""
    return F.sha2(F.concat(*[x for f in fields for x in (F.coalesce(f.cast("string"), F.lit("")), F.lit("\x00"))]), 256)


def arrivals(keys: DataFrame, seed: int, per_day: float, days: int) -> DataFrame:
    """(key, n, hours): exponential gaps from a generator seeded by each key; one key is one small run of numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key in f["key"]:
                rng, at, n = random.Random(subseed(seed, key)), 0.0, 0
                while (at := at + rng.expovariate(per_day / 24)) < days * 24:
                    out.append((key, n, at))
                    n += 1
            yield pd.DataFrame(out, columns=["key", "n", "hours"])

    return keys.select("key").distinct().mapInPandas(run, f"key {dict(keys.dtypes)['key']}, n int, hours double")


def confidence(c: Column) -> Column:
    """A JSON text as a number kept between 0 and 1; what is no number counts as 1, a number in quotes included."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.try_cast("double"))), F.lit(1.0))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of an offset from 0."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def context(text: Column, offset: Column, length: Column, surface: Column, reach: int = 120) -> Column:
    """The text around a located span, else its surface form."""
    begin = F.greatest(F.lit(0), offset - reach)
    return F.when((offset >= 0) & text.isNotNull(), F.substring(text, begin + 1, offset + length + reach - begin)).otherwise(surface)


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per model of (model, input_tokens, output_tokens, cached): cached calls cost nothing, prices are per million tokens."""
    paid = usage.where("not cached").join(small(prices), "model", "left")
    cost = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6
    return paid.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce(cost, F.lit(0.0))).alias("cost"))
