"""Time expressions. Times are naive, so everything is TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(column: str) -> Column:
    """An ISO time with either separator and any fraction; null where the text is no time."""
    return F.expr(f"try_cast(trim(`{column}`) as timestamp_ntz)")


def naive(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz")


def month(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM")
