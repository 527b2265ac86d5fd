"""Keep-latest deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.operators.sizing import null_spread


def keep_latest(
    df: DataFrame,
    keys: Sequence[str],
    newest: str,
    ties: Sequence[Column | str] = (),
    null_keys: str = "collapse",
) -> DataFrame:
    """One row per key: the greatest ``newest`` (NULL ranks last), then ``ties``.

    ``row_number = 1`` lets Spark cut every key to one row per input partition ahead
    of the shuffle, so a hot key, or all rows without a key, cost no more than a cold
    one, whatever the size of the input.

    ``null_keys``: "collapse" keeps one row for the NULL key, "keep" keeps them all,
    "drop" removes them.
    """
    if null_keys not in ("collapse", "keep", "drop"):
        raise ValueError(f"null_keys: {null_keys}")
    keys = list(keys)
    if null_keys == "drop":
        df = df.dropna(subset=keys)
    by = [F.col(k) for k in keys]
    if null_keys == "keep":
        df = df.withColumn("_spread", null_spread(keys, df))
        by.append(F.col("_spread"))
    order = [F.col(newest).desc_nulls_last(), *(F.col(t) if isinstance(t, str) else t for t in ties)]
    window = Window.partitionBy(*by).orderBy(*order)
    first = df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") == 1)
    return first.drop("_rank", "_spread")


def null_key_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows ``keep_latest(..., null_keys="drop")`` leaves out, for a quarantine table."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    return df.filter(missing)
