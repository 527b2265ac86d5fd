"""Sets of keys as mergeable bitmaps over stable numbers.

A key gets a number once and keeps it.  A set is then a few binary values of 32,768 bits,
one per ``slot`` of numbers; sets made apart are united with ``bitmap_or_agg``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers are dealt in this many independent series; fixed, as stored numbers depend on it.
LANES = 1024


def new_numbers(known: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(key, number) of the keys that ``known`` has not numbered; NULL gets none.

    A number is a place in a lane times the number of lanes, plus the lane, from 1.  Lanes follow
    a hash of the key, so each task deals numbers alone and they stay dense.
    """
    fresh = keys.select(key).filter(F.col(key).isNotNull()).distinct().join(known, key, "left_anti")
    # One row per lane.
    used = known.groupBy(((F.col("number") - 1) % LANES).alias("_lane")).agg(
        F.max(F.expr(f"(number - 1) div {LANES}")).alias("_used")
    )
    place = F.coalesce("_used", F.lit(-1)) + F.row_number().over(Window.partitionBy("_lane").orderBy(key))
    return (
        fresh.withColumn("_lane", F.pmod(F.xxhash64(key), F.lit(LANES)))
        .join(F.broadcast(used), "_lane", "left")
        .withColumn("_place", place)
        .select(key, (F.col("_place") * LANES + F.col("_lane") + 1).cast("long").alias("number"))
    )


def construct(members: DataFrame, by: list[str], number: str = "number") -> DataFrame:
    """(*by, slot, bits) of the numbers of each group."""
    return members.groupBy(*by, F.bitmap_bucket_number(number).alias("slot")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
    )


def united(sets: DataFrame, by: list[str]) -> DataFrame:
    """The union of the sets of each group, slot by slot."""
    return sets.groupBy(*by, "slot").agg(F.bitmap_or_agg("bits").alias("bits"))


def common_counts(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """(*by, members): how many numbers each set of one side has in common with each of the other.

    ``by`` names the groups of both sides.  Sets meet slot by slot and stay in the task of
    their slot until they are counted; pairs without a common number have no row.
    """
    pairs = left.withColumnRenamed("bits", "_left").join(right.withColumnRenamed("bits", "_right"), "slot")
    both = pairs.select(*by, "slot", F.explode(F.array("_left", "_right")).alias("bits"))
    met = both.groupBy("slot", *by).agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("_n"))
    return met.groupBy(*by).agg(F.sum("_n").alias("members")).filter("members > 0")
