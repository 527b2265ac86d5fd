"""Slowly changing dimension history (type 2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.domains import OPEN_END
from stratafold.operators.dedup import keep_latest
from stratafold.operators.merge import insert_if_absent
from stratafold.operators.sizing import (
    BROADCAST_BYTES,
    HOT_ROWS,
    SMALL_BYTES,
    fits_broadcast,
    null_spread,
)
from stratafold.operators.skew import neighbour

INTERVAL = ("valid_from", "valid_to", "is_current")


def _open_end(df: DataFrame, version: str) -> Column:
    return F.lit(OPEN_END).cast(df.schema[version].dataType)


def stamp_versions(batch: DataFrame, version: str = "updated_at") -> DataFrame:
    """A batch as open versions: valid from ``version`` on, current."""
    return batch.withColumns(
        {
            "valid_from": F.col(version),
            "valid_to": _open_end(batch, version),
            "is_current": F.lit(True),
        }
    )


def close_superseded(
    history: DataFrame, batch: DataFrame, key: str, version: str = "updated_at"
) -> DataFrame:
    """Close every current version that has a newer one in the batch.

    More than one newer batch row for a current version is an error, as in a merge.
    Only the two newest batch rows of a key are needed to tell, so a key that fills
    the batch is cut down before the shuffle.
    """
    newest_first = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last())
    newest = (
        batch.filter(F.col(key).isNotNull() & F.col(version).isNotNull())
        .select(key, version)
        .withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") <= 2)
        .groupBy(key)
        .agg(
            F.max(F.when(F.col("_rank") == 1, F.col(version))).alias("_newest"),
            F.max(F.when(F.col("_rank") == 2, F.col(version))).alias("_second"),
        )
        .withColumn("_key_spread", F.lit(0).cast("long"))
        .withColumnRenamed(key, "_key")
    )
    if fits_broadcast(batch):
        newest = F.broadcast(newest)
    spread_history = history.withColumn("_spread", null_spread([key], history))
    joined = spread_history.join(
        newest, (F.col(key) == F.col("_key")) & (F.col("_spread") == F.col("_key_spread")), "left"
    )
    newer = F.col("is_current") & (F.col("_newest") > F.col(version))
    twice = F.col("is_current") & (F.col("_second") > F.col(version))
    ambiguous = F.raise_error(
        F.format_string("several newer rows in the batch for key %s", F.col(key).cast("string"))
    ).cast(history.schema["valid_to"].dataType)
    changed = {
        "valid_to": F.when(twice, ambiguous).when(newer, F.col("_newest")).otherwise(F.col("valid_to")),
        "is_current": F.when(newer, F.lit(False)).otherwise(F.col("is_current")),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in history.columns])


def apply_two_step(
    history: DataFrame, batch: DataFrame, key: str, version: str = "updated_at"
) -> DataFrame:
    """Close superseded versions, then insert the batch rows that are absent.

    A late row is inserted open and closes nothing, and attributes are not compared.
    """
    stamped = stamp_versions(batch, version)
    closed = close_superseded(history, stamped, key, version)
    return insert_if_absent(closed, stamped, [key, "valid_from"])


def rebuild(
    versions: DataFrame,
    key: str,
    version: str = "updated_at",
    track: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
    small_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """History from versions that are unique by (key, version), in one pass.

    ``valid_to`` is the start of the next version.  With ``track``, a version whose
    tracked columns equal those of the version before it is left out.
    """
    df = versions.drop(*INTERVAL)
    columns = df.columns
    limits = {"hot_rows": hot_rows, "small_bytes": small_bytes}
    if track:
        now = F.struct(*track)
        df = neighbour(df, key, version, now, "_before", step=-1, **limits)
        df = df.filter(~F.col("_before").eqNullSafe(now)).select(*columns)
    df = neighbour(df, key, version, F.col(version), "_next", **limits)
    return df.select(
        *columns,
        F.col(version).alias("valid_from"),
        F.coalesce(F.col("_next"), _open_end(df, version)).alias("valid_to"),
        F.col("_next").isNull().alias("is_current"),
    )


def apply_one_pass(
    history: DataFrame,
    batch: DataFrame,
    key: str,
    version: str = "updated_at",
    track: Sequence[str] = (),
    ties: Sequence[Column | str] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """History with the batch merged in and all intervals of its keys rebuilt.

    Late rows and several versions of a key in one batch end up in their place, so
    the result does not depend on how rows were split into batches.  A row already
    in the history wins over a batch row with the same (key, version).  Rows without
    a key or a version are left out of the rebuild and kept as they came.

    Only the keys of the batch are rebuilt, whatever its size: a batch of checked size
    is broadcast, so that all other rows pass without a shuffle, and a larger one
    meets the history by key.
    """
    columns = history.columns
    stamped = stamp_versions(batch, version).select(*columns)
    whole = F.col(key).isNotNull() & F.col(version).isNotNull()
    known, fresh = history.filter(whole), stamped.filter(whole)
    unkeyed = insert_if_absent(history.filter(~whole), stamped.filter(~whole), [key, "valid_from"])

    touched_keys = fresh.select(key).distinct()
    if fits_broadcast(touched_keys, broadcast_bytes):
        touched_keys = F.broadcast(touched_keys)
    untouched = known.join(touched_keys, key, "left_anti").select(*columns)
    known = known.join(touched_keys, key, "left_semi").select(*columns)
    rows = known.withColumn("_old", F.lit(1)).unionByName(fresh.withColumn("_old", F.lit(0)))
    rows = keep_latest(rows, [key, version], "_old", ties).drop("_old")
    rebuilt = rebuild(rows, key, version, track).select(*columns)
    return rebuilt.unionByName(unkeyed).unionByName(untouched)
