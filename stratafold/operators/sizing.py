"""Size checks behind every broadcast and every plan choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest side that is ever broadcast, and largest input for which one group may
# be the whole table without trouble.
BROADCAST_BYTES = 64 * 1024 * 1024
SMALL_BYTES = 512 * 1024 * 1024
# Most rows of one key that a single task is asked to sort.
HOT_ROWS = 20_000_000


# Beside its values a row in memory takes about this much.
ROW_BYTES = 64


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: of the files, so compressed, and blind to
    generators.  It can rule a side out, but no decision rests on it alone."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def row_bytes(df: DataFrame) -> Column:
    """Size of a row in memory: its texts as they are, numbers by their width."""
    size = F.lit(ROW_BYTES + 8 * len(df.columns))
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType | T.BinaryType):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
            text = F.to_json(F.struct(column.alias("v")))
            size = size + 2 * F.coalesce(F.octet_length(text), F.lit(0))
    return size.cast("long")


def memory_bytes(df: DataFrame) -> int:
    """Rows times their width, counted in one aggregation over ``df``."""
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether all rows of ``df`` stay within the limit in memory.

    The estimate of the plan comes first; only a side that passes is counted.
    """
    return plan_bytes(df) <= limit and memory_bytes(df) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def spread(df: DataFrame) -> Column:
    """A whole number that scatters rows, copies of one row included.

    It depends on a row's content and on the task that reads it, never on the order
    of rows inside the task, so a repeated task gives every row the same number.
    Columns that Spark cannot hash (maps) are left out.
    """
    columns = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    return (F.xxhash64(*columns) if columns else F.lit(0).cast("long")) + F.spark_partition_id()


def null_spread(keys: list[str], df: DataFrame) -> Column:
    """A helper join key that scatters rows with a NULL key over all partitions.

    Such rows never match an equality, so the extra key changes no result; without
    it an outer or anti join sends all of them to one task.
    """
    any_null = F.lit(False)
    for key in keys:
        any_null = any_null | F.col(key).isNull()
    return F.when(any_null, spread(df)).otherwise(F.lit(0).cast("long"))
