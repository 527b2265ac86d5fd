"""The paths for hot keys, forced by small limits, against the plain plans."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratafold.operators import quality
from stratafold.operators.scd2 import rebuild
from stratafold.operators.skew import hot_keys, neighbour, range_borders, salted_join
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of 3,000 rows on one key, the rest on 200 keys and NULL."""
    return spark.range(3000).selectExpr(
        "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('k', id % 200) end k",
        "id * 7 % 3001 pos",
        "id v",
    )


def test_hot_keys_are_found_and_bounded(spark, skewed):
    found = hot_keys(skewed, ["k"], 500)
    assert rows(found) == [("hot", 1000)]
    assert range_borders(skewed, "k", "pos", 5000) is None


@pytest.mark.parametrize("step", [1, -1])
@pytest.mark.parametrize("hot_rows", [50, 400])
def test_neighbour_over_ranges_equals_the_window(skewed, step, hot_rows):
    df = skewed.filter("k is not null")
    shift = F.lead if step == 1 else F.lag
    plain = df.withColumn("n", shift("v").over(Window.partitionBy("k").orderBy("pos")))
    cut = neighbour(df, "k", "pos", F.col("v"), "n", step, hot_rows=hot_rows, small_bytes=0)
    assert cut.columns == plain.columns
    assert rows(cut) == rows(plain)


def test_neighbour_keeps_null_values_apart_from_missing_ones(spark):
    df = spark.range(400).selectExpr("'hot' k", "id pos", "if(id % 5 = 0, null, id) v")
    plain = df.withColumn("n", F.lead("v").over(Window.partitionBy("k").orderBy("pos")))
    cut = neighbour(df, "k", "pos", F.col("v"), "n", hot_rows=20, small_bytes=0)
    assert rows(cut) == rows(plain)


def test_history_of_a_hot_key(skewed):
    versions = skewed.filter("k is not null").selectExpr("k", "timestamp_seconds(pos) updated_at", "v % 3 plan")
    for track in ([], ["plan"]):
        plain = rebuild(versions, "k", track=track)
        cut = rebuild(versions, "k", track=track, hot_rows=60, small_bytes=0)
        assert rows(cut) == rows(plain)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "small_bytes": 0, "hot_rows": 40}])
def test_salted_join_equals_the_join(spark, skewed, how, limits):
    right = spark.range(150).selectExpr("if(id < 2, 'hot', concat('k', id)) key", "id w")
    expected = rows(skewed.join(right, F.col("k") == F.col("key"), how).select("k", "v", "w"))
    result = salted_join(skewed, right.withColumnRenamed("key", "k"), ["k"], how, **limits)
    assert rows(result, "k", "v", "w") == expected


def test_salt_spreads_copies_of_one_row(spark):
    copies = spark.range(0, 4000, 1, 8).selectExpr("'hot' k", "1 v")
    right = spark.createDataFrame([("hot", 5)], "k string, w int")
    joined = salted_join(copies, right, ["k"], broadcast_bytes=0, small_bytes=0, hot_rows=500)
    assert joined.count() == 4000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan


def test_checks_count_a_hot_key_once(skewed):
    assert rows(quality.surplus_keys(skewed, ["k"])) == [(3000 - skewed.select("k").dropna().distinct().count(),)]
    dimension = skewed.filter("k <> 'hot'").select(F.col("k").alias("d")).distinct()
    assert rows(quality.missing_references(skewed, dimension, "k", "d")) == [(1000,)]
