import pytest
from pyspark.sql import functions as F

from stratafold.operators.pit import LEVEL, block_sizes, cover, listed, pit_join
from stratafold.operators.scd2 import rebuild
from stratafold.operators.skew import add_range, range_borders
from tests.conftest import rows


def facts(spark, *data):
    df = spark.createDataFrame(list(data), "c string, day string, n int")
    return df.select("c", F.col("day").cast("timestamp").alias("at"), "n")


def history(spark):
    df = spark.createDataFrame(
        [("c1", "2026-01-02", "free"), ("c1", "2026-01-05", "pro"), ("c2", "2026-01-01", "pro")],
        "c string, d string, plan string",
    )
    return rebuild(df.select("c", F.col("d").cast("timestamp").alias("updated_at"), "plan"), "c")


VERSION = ("c", "plan", "valid_from", "valid_to")
LIMITS = [
    {},
    {"broadcast_bytes": 0},
    {"broadcast_bytes": 0, "small_bytes": 0, "hot_rows": 1},
    {"many_versions": 1},
    {"many_versions": 1, "broadcast_bytes": 0, "small_bytes": 0, "hot_rows": 1},
]


@pytest.mark.parametrize("limits", LIMITS)
class TestPointInTime:
    def test_boundary_fact_meets_both_versions_when_closed(self, spark, limits):
        df, versions = facts(spark, ("c1", "2026-01-05", 1)), history(spark).select(*VERSION)
        closed = pit_join(df, versions, "c", "at", **limits)
        half_open = pit_join(df, versions, "c", "at", bounds="half_open", **limits)
        assert rows(closed, "n", "plan") == [(1, "free"), (1, "pro")]
        assert rows(half_open, "n", "plan") == [(1, "pro")]

    def test_fact_before_the_first_version(self, spark, limits):
        df = facts(spark, ("c1", "2026-01-01", 1), ("c9", "2026-01-03", 2), (None, "2026-01-03", 3))
        versions = history(spark).select(*VERSION)
        assert pit_join(df, versions, "c", "at", **limits).count() == 0
        left = pit_join(df, versions, "c", "at", how="left", **limits)
        assert rows(left, "n", "plan") == [(1, None), (2, None), (3, None)]

    def test_copies_of_a_fact_all_stay(self, spark, limits):
        df = facts(spark, *[("c1", "2026-01-03", 7)] * 40, ("c2", "2026-01-03", 8))
        result = pit_join(df, history(spark).select(*VERSION), "c", "at", **limits)
        assert rows(result.groupBy("n", "plan").count()) == [(7, "free", 40), (8, "pro", 1)]

    def test_overlapping_versions_all_match(self, spark, limits):
        versions = spark.createDataFrame(
            [("c1", f"v{i}", f"2026-01-0{i}", "9999-12-31") for i in range(1, 9)], "c string, plan string, f string, t string"
        ).select("c", "plan", F.col("f").cast("timestamp").alias("valid_from"), F.col("t").cast("timestamp").alias("valid_to"))
        df = facts(spark, ("c1", "2026-01-04", 1), ("c1", "2026-01-08", 2))
        result = pit_join(df, versions, "c", "at", **limits)
        assert rows(result.groupBy("n").count()) == [(1, 4), (2, 8)]


def test_key_with_thousands_of_versions_against_brute_force(spark):
    at = "timestamp_seconds(1700000000 + {} * 60)"
    versions = spark.range(3000).selectExpr(
        "if(id % 10 = 0, 'cold', 'hot') c", f"{at.format('id')} updated_at", "cast(id as string) plan"
    )
    versions = rebuild(versions, "c").select(*VERSION)
    df = spark.range(9000).selectExpr("if(id % 3 = 0, 'cold', 'hot') c", f"{at.format('id div 3')} at", "id n")
    brute = df.join(versions.withColumnRenamed("c", "k"), F.expr("c = k and at >= valid_from and at <= valid_to"))
    expected = rows(brute, "n", "plan")
    for limits in ({}, {"broadcast_bytes": 0, "small_bytes": 0, "hot_rows": 500}):
        assert rows(pit_join(df, versions, "c", "at", **limits), "n", "plan") == expected


@pytest.mark.parametrize("first,last", [(0, 0), (3, 6), (3, 7), (0, 781), (1, 780), (5, 1023), (512, 1023), (7, 4000)])
def test_cover_is_exact_and_short(spark, first, last):
    blocks = spark.range(1).select(cover(F.lit(first).cast("long"), F.lit(last).cast("long"))).first()[0]
    held = [r for b in blocks for r in range((b % LEVEL) << (b // LEVEL), ((b % LEVEL) + 1) << (b // LEVEL))]
    assert sorted(held) == list(range(first, last + 1))
    assert len(blocks) <= max(4, 2 * (last + 1).bit_length())


def open_versions(spark, n, share_open):
    """Versions of one key, in order, of which a share never ends; a few of another key."""
    return spark.range(n).selectExpr(
        "if(id % 1000 = 7, 'cold', 'hot') c",
        "cast(id as string) plan",
        "timestamp_seconds(1700000000 + id * 60) valid_from",
        f"if(id % 100 < {share_open}, timestamp '9999-12-31', timestamp_seconds(1700000000 + id * 60 + id % 7 * 40000)) valid_to",
    )


def test_open_versions_are_listed_few_times(spark):
    versions = open_versions(spark, 100_000, 100)
    borders = range_borders(versions, "c", "valid_from", 512, 128)
    rows_ = listed(versions, borders, "c", "valid_from", "valid_to")
    assert 100_000 <= rows_.count() < 20 * 100_000
    assert block_sizes(rows_, "c").count() == 1


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("bounds", ["closed", "half_open"])
@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0, "small_bytes": 0, "hot_rows": 100}])
def test_overlapping_versions_of_a_hot_key_against_brute_force(spark, how, bounds, limits):
    versions = open_versions(spark, 4000, 5)
    df = spark.range(-30, 400).selectExpr(
        "case when id % 90 = 0 then null when id % 50 = 1 then 'none' when id % 5 = 0 then 'cold' else 'hot' end c",
        "timestamp_seconds(1700000000 + id * 613) at",
        "id n",
    )
    df = df.unionByName(df.filter("n % 40 = 3"))
    until = "at <= valid_to" if bounds == "closed" else "at < valid_to"
    brute = df.join(versions.withColumnRenamed("c", "k"), F.expr(f"c = k and at >= valid_from and {until}"), how)
    got = pit_join(df, versions, "c", "at", bounds=bounds, how=how, many_versions=200, **limits)
    summed = [F.count("*").alias("rows"), F.sum(F.xxhash64("plan").cast("decimal(38,0)")).alias("plans")]
    assert got.columns == ["c", "at", "n", "plan", "valid_from", "valid_to"]
    assert rows(got.groupBy("n").agg(*summed)) == rows(brute.groupBy("n").agg(*summed))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("bounds", ["closed", "half_open"])
@pytest.mark.parametrize("limits", [{}, {"many_versions": 200, "broadcast_bytes": 0, "small_bytes": 0, "hot_rows": 100}])
def test_totals_are_those_of_the_pairs(spark, how, bounds, limits):
    more = spark.sql("select 'hot' c, 'x' plan, timestamp_seconds(1700000000 + id * 613) valid_from, if(id = 1, null, timestamp_seconds(1700000000 + id * 613)) valid_to from range(5)")
    versions = open_versions(spark, 4000, 5).unionByName(more).withColumn("v", F.when(F.col("plan") != "50", F.hash("plan")))
    df = spark.range(-30, 400).selectExpr(
        "case when id % 90 = 0 then null when id % 50 = 1 then 'none' when id % 5 = 0 then 'cold' else 'hot' end c",
        "if(id = 7, null, timestamp_seconds(1700000000 + id * 613)) at",
        "id k",
    )
    df = df.unionByName(df.filter("k % 40 = 3"))
    got = pit_join(df, versions, "c", "at", bounds=bounds, how=how, totals="v", **limits)
    assert got.columns == ["c", "at", "k", "n", "least", "greatest"] and got.count() <= df.count()
    pairs = pit_join(df.distinct(), versions, "c", "at", bounds=bounds, how=how)
    summed = pairs.groupBy("c", "at", "k").agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"))
    assert rows(got.distinct()) == rows(summed)
    assert got.filter("k % 40 = 3").count() == 2 * summed.filter("k % 40 = 3").count()


def test_borders_are_looked_up_part_by_part(spark):
    versions = open_versions(spark, 40_000, 0).select("c", "valid_from")
    borders = range_borders(versions, "c", "valid_from", 100, 20)
    found = add_range(versions.limit(3000), borders, "c", {"n": "valid_from"}, broadcast_bytes=0)
    both = borders.select(F.col("c").alias("k"), "_borders")
    brute = versions.limit(3000).join(both, F.expr("c = k"), "left")
    expected = brute.select("c", "valid_from", F.expr("coalesce(size(filter(_borders, b -> b <= valid_from)), 0) n"))
    assert rows(found.select("c", "valid_from", "n")) == rows(expected)
    # A row meets the square root of all borders at each step.
    assert borders.agg(F.max(F.size("_coarse"))).first()[0] < 60 < borders.agg(F.max(F.size("_borders"))).first()[0]


def test_arguments_are_checked(spark):
    df, versions = facts(spark, ("c1", "2026-01-05", 1)), history(spark).select(*VERSION)
    with pytest.raises(ValueError):
        pit_join(df, versions, "c", "at", bounds="open")
    with pytest.raises(ValueError):
        pit_join(df, versions, "c", "at", how="right")
    with pytest.raises(ValueError, match="both sides"):
        pit_join(df, versions.withColumn("n", F.lit(1)), "c", "at")
