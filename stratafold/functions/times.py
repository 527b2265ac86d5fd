"""Month buckets, minute differences and trailing windows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_of(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes as an exact decimal with six digits; NULL when either side is.

    The decimal makes sums independent of the order of addition, so an average
    does not change with the partitioning.
    """
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / F.lit(Decimal("60.0"))


def trailing_start(df: DataFrame, ts: str, days: int) -> Column:
    """Start of the window of ``days`` days that ends at the newest ``ts`` of ``df``.

    An uncorrelated scalar subquery: evaluated once, then used as a literal by the scan.
    """
    newest = df.agg(F.max(ts).alias("newest"))
    return newest.select(F.col("newest") - F.expr(f"INTERVAL {int(days)} DAYS")).scalar()
