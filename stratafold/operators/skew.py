"""Ordered and interval work on keys of any size.

A window partitioned by a key, or a join on it, sends the whole key to one task.
That is fine until a key holds a large part of the table.  The helpers here find
such keys by a partial aggregation, cut or salt them, and carry what crosses a
cut, so no task gets a whole hot key and every row is kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.operators.sizing import (
    BROADCAST_BYTES,
    HOT_ROWS,
    SMALL_BYTES,
    broadcast_if_small,
    fits_broadcast,
    plan_bytes,
    spread,
)
from stratafold.session import staged

# Staged helper tables are compressed files; keep a margin for their size in memory.
_STAGED_BYTES = BROADCAST_BYTES // 4


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int) -> DataFrame:
    """(keys, rows) for keys of more than ``max_rows`` rows: at most rows/max_rows keys."""
    sizes = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("_rows"))
    return sizes.filter(F.col("_rows") > max_rows)


def range_borders(
    df: DataFrame,
    key: str,
    order: str,
    max_rows: int,
    rows_per_range: int | None = None,
) -> DataFrame | None:
    """(key, borders) for every hot key, or None when there is none.

    ``borders`` are approximate quantiles of ``order``, about ``rows_per_range`` rows
    apart.  They are written once, because every later use must see the same cut
    points.  A coarser copy, every ``_step``-th border, makes the lookup of a value short.
    """
    hot = hot_keys(df, [key], max_rows)
    largest = hot.agg(F.max("_rows")).first()[0]
    if largest is None:
        return None
    parts = max(2, -(-largest // (rows_per_range or max(1, max_rows // 2))))
    step = max(2, ceil(parts ** (1 / 2)))
    cuts = [i / parts for i in range(1, parts)]
    rows = df.select(key, order).join(hot.select(key), key, "left_semi")
    borders = rows.groupBy(key).agg(
        F.array_distinct(F.percentile_approx(order, cuts, 20 * parts)).alias("_borders")
    )
    coarse = F.filter("_borders", lambda _, i: i % step == 0)
    return staged(borders.withColumns({"_coarse": coarse, "_step": F.lit(step)}), "borders")


def add_range(df: DataFrame, borders: DataFrame, key: str, orders: dict[str, str], **limits: int) -> DataFrame:
    """Add, per (name, order column), the number of the key's borders at or below it.

    0 for keys without borders.  Also adds ``_hot``.  The coarse borders are searched
    first and then the few between two of them, which are a row of their own: a row
    never carries all borders of its key.
    """
    columns = df.columns
    limits = {"broadcast_bytes": _STAGED_BYTES, **limits}
    step = F.col("_step")
    parts = F.transform(F.sequence(F.lit(0), F.size("_coarse") - 1), lambda i: F.slice("_borders", i * step + 1, step))
    fine = borders.select(key, F.posexplode(parts).alias("_part", "_fine"))
    df = salted_join(df, borders.select(key, "_coarse", "_step"), [key], "left", **limits)
    hot = F.col("_coarse").isNotNull()
    for name, order in orders.items():
        df = df.withColumn(f"_part_{name}", F.when(hot, _upto(F.col("_coarse"), order) - 1))
    df = df.withColumn("_hot", hot).drop("_coarse")
    for name, order in orders.items():
        df = df.withColumnRenamed(f"_part_{name}", "_part")
        df = salted_join(df, fine, [key, "_part"], "left", **limits)
        found = F.col("_part") * step + _upto(F.col("_fine"), order)
        df = df.withColumn(name, F.coalesce(F.when(F.col("_part") >= 0, found), F.lit(0))).drop("_part", "_fine")
    return df.select(*columns, *orders, "_hot")


def _upto(sorted_values: Column, order: str) -> Column:
    return F.size(F.filter(sorted_values, lambda value: value <= F.col(order)))


def neighbour(
    df: DataFrame,
    key: str,
    order: str,
    value: Column,
    name: str,
    step: int = 1,
    hot_rows: int = HOT_ROWS,
    small_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """Add ``value`` of the next (``step=1``) or previous (``step=-1``) row of the key.

    ``order`` must be unique within a key.  Inputs small enough for one task take a
    plain window.  Larger ones are checked for hot keys; those are cut into ranges,
    and the first or last value of the neighbouring range fills the gap at a border.
    """
    if step not in (1, -1):
        raise ValueError("step must be 1 or -1")
    shift = F.lead if step == 1 else F.lag
    borders = None
    if plan_bytes(df) > small_bytes:
        borders = range_borders(df, key, order, hot_rows)
    if borders is None:
        return df.withColumn(name, shift(value).over(Window.partitionBy(key).orderBy(order)))

    packed = df.withColumn("_value", F.struct(value.alias("v")))
    ranged = add_range(packed, borders, key, {"_range": order}, hot_rows=hot_rows, small_bytes=small_bytes)
    edge = F.min_by if step == 1 else F.max_by
    # One row per hot key and range: bounded by the number of borders.
    edges = (
        ranged.filter("_hot")
        .groupBy(key, "_range")
        .agg(edge("_value", order).alias("_edge"))
        .withColumn("_edge", shift("_edge").over(Window.partitionBy(key).orderBy("_range")))
    )
    within = Window.partitionBy(key, "_range").orderBy(order)
    local = ranged.withColumn("_local", shift("_value").over(within))
    filled = local.join(edges, [key, "_range"], "left")
    return filled.select(*df.columns, F.coalesce("_local", "_edge").getField("v").alias(name))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    residual: Column | None = None,
    hot_rows: int = HOT_ROWS,
    small_bytes: int = SMALL_BYTES,
    broadcast_bytes: int | None = BROADCAST_BYTES,
) -> DataFrame:
    """Equi-join (inner or left) on same-named ``keys`` plus an optional residual.

    A right side of checked size is broadcast; with ``broadcast_bytes=None`` the caller
    has checked it.  Otherwise hot left keys are salted
    over several tasks and only their right rows are repeated, once per salt, so
    each left row still meets each right row of its key exactly once.  NULL left
    keys, which match nothing, are scattered too.  The result keeps the left
    columns and the right columns other than ``keys``.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how: {how}")
    keys = list(keys)
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    extras = [c for c in right.columns if c not in keys]
    names = {k: f"_r_{k}" for k in keys}

    if broadcast_bytes is None or fits_broadcast(right, broadcast_bytes):
        right = F.broadcast(right.withColumnsRenamed(names))
        return left.join(right, _condition(names, residual), how).select(*left.columns, *extras)

    hot = None
    if plan_bytes(left) > small_bytes:
        found = hot_keys(left, keys, hot_rows)
        found = staged(found.select(*keys, (F.floor(F.col("_rows") / hot_rows) + 1).alias("_salts")), "hot")
        hot = None if found.isEmpty() else found
    columns = left.columns
    scattered = spread(left)
    salt = F.lit(0).cast("long")
    if hot is None:
        right = right.withColumn("_salt", salt)
    else:
        left = left.join(broadcast_if_small(hot, _STAGED_BYTES), keys, "left")
        right = right.join(broadcast_if_small(hot, _STAGED_BYTES), keys, "left")
        salts = F.coalesce("_salts", F.lit(1).cast("long"))
        salt = F.pmod(scattered, salts)
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
        right = right.drop("_salts")
    if how == "left":
        any_null = F.lit(False)
        for key in keys:
            any_null = any_null | F.col(key).isNull()
        salt = F.when(any_null, scattered).otherwise(salt)
    left = left.withColumn("_salt", salt).drop("_salts")
    names["_salt"] = "_r__salt"
    joined = left.join(right.withColumnsRenamed(names), _condition(names, residual), how)
    return joined.select(*columns, *extras)


def _condition(names: dict[str, str], residual: Column | None) -> Column:
    on = None
    for left_name, right_name in names.items():
        part = F.col(left_name) == F.col(right_name)
        on = part if on is None else on & part
    return on if residual is None else on & residual
