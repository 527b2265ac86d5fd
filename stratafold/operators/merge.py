"""Upserts as DataFrame expressions, for tables without row-level writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.operators.sizing import BROADCAST_BYTES, fits_broadcast, null_spread, plan_bytes


def newest_wins(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    version: str,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Target after an upsert with ``source``.

    A matched row is replaced as a whole when ``source.version > target.version``; a
    tie or a NULL on either side keeps the target.  Unmatched source rows are
    inserted, NULL keys included.  Keys must be unique within each side (run
    ``keep_latest`` on the batch first).

    A batch of checked size, and much smaller than the target, is broadcast: the
    target is read once more by key but never shuffled.  Otherwise both sides meet
    in a full outer join.
    """
    keys = list(keys)
    columns = target.columns
    source = source.select(*columns)
    if fits_broadcast(source, broadcast_bytes) and plan_bytes(target) > 4 * plan_bytes(source):
        packed = source.select(
            *[F.col(k).alias(f"_s_{k}") for k in keys], F.struct(*columns).alias("_s")
        )
        on = _equal(target, packed, keys)
        kept = target.join(F.broadcast(packed), on, "left")
        newer = F.col(f"_s.{version}") > F.col(version)
        kept = kept.select(*[F.when(newer, F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) for c in columns])
        return kept.unionByName(absent_rows(source, target, keys, broadcast_bytes))

    left = target.select(
        *[F.col(k).alias(f"_t_{k}") for k in keys],
        null_spread(keys, target).alias("_t_spread"),
        F.struct(*columns).alias("_t"),
    )
    right = source.select(
        *[F.col(k).alias(f"_s_{k}") for k in keys],
        null_spread(keys, source).alias("_s_spread"),
        F.struct(*columns).alias("_s"),
    )
    on = F.col("_t_spread") == F.col("_s_spread")
    for key in keys:
        on = on & (F.col(f"_t_{key}") == F.col(f"_s_{key}"))
    both = left.join(right, on, "full_outer")
    take_source = F.col("_t").isNull() | (F.col(f"_s.{version}") > F.col(f"_t.{version}"))
    return both.select(F.when(take_source, F.col("_s")).otherwise(F.col("_t")).alias("_row")).select(
        *[F.col(f"_row.{c}").alias(c) for c in columns]
    )


def absent_rows(
    source: DataFrame, target: DataFrame, keys: Sequence[str], broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Source rows whose key the target does not hold (NULL keys count as absent)."""
    keys = list(keys)
    known = target.select(*keys)
    if fits_broadcast(source.select(*keys), broadcast_bytes):
        # Only the keys found in the batch are kept, so what reaches the shuffle
        # is no larger than the batch.
        known = known.join(F.broadcast(source.select(*keys)), keys, "left_semi").distinct()
    known = known.withColumn("_spread", F.lit(0).cast("long"))
    spread = source.withColumn("_spread", null_spread(keys, source))
    return spread.join(known, [*keys, "_spread"], "left_anti").select(*source.columns)


def insert_if_absent(
    target: DataFrame, source: DataFrame, keys: Sequence[str], broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Target plus every source row whose key it lacks; no existing row changes."""
    fresh = absent_rows(source.select(*target.columns), target, keys, broadcast_bytes)
    return target.unionByName(fresh)


def _equal(left: DataFrame, packed: DataFrame, keys: Sequence[str]):
    on = F.lit(True)
    for key in keys:
        on = on & (left[key] == packed[f"_s_{key}"])
    return on
