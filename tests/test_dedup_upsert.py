import pytest
from pyspark.sql import functions as F

from stratafold.operators.dedup import keep_latest, null_key_rows
from stratafold.operators.merge import absent_rows, insert_if_absent, newest_wins
from tests.conftest import rows

SCHEMA = "k string, at timestamp, v string"
NINE, TEN, LATER = "2026-01-01 09:00:00", "2026-01-01 10:00:00", "2026-01-01 10:05:00"


def table(spark, *data):
    df = spark.createDataFrame(list(data), "k string, at string, v string")
    return df.withColumn("at", F.col("at").cast("timestamp"))


class TestKeepLatest:
    def test_newest_of_a_key(self, spark):
        df = table(spark, ("e1", TEN, "a"), ("e1", LATER, "b"), ("e2", TEN, "c"), ("e2", None, "d"))
        assert rows(keep_latest(df, ["k"], "at"), "k", "v") == [("e1", "b"), ("e2", "c")]

    def test_ties_are_settled_by_the_given_columns(self, spark):
        df = table(spark, ("e1", TEN, "a"), ("e1", TEN, "b"))
        up = keep_latest(df, ["k"], "at", [F.col("v").asc()])
        down = keep_latest(df, ["k"], "at", [F.col("v").desc()])
        assert rows(up, "v") == [("a",)]
        assert rows(down, "v") == [("b",)]

    @pytest.mark.parametrize("mode, kept", [("collapse", 2), ("keep", 3), ("drop", 1)])
    def test_null_keys(self, spark, mode, kept):
        df = table(spark, (None, TEN, "a"), (None, TEN, "b"), ("e1", TEN, "c"))
        result = keep_latest(df, ["k"], "at", ["v"], null_keys=mode)
        assert result.count() == kept
        assert result.columns == df.columns
        assert null_key_rows(df, ["k"]).count() == 2


def test_keys_are_cut_before_the_shuffle(spark):
    df = table(spark, ("e1", TEN, "a"))
    plan = keep_latest(df, ["k"], "at")._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.index("Exchange") < plan.index("Partial")


# A broadcast needs a target several times the size of the batch.
def padded(spark, *data):
    filler = [(f"pad{i}", NINE, "pad") for i in range(50)]
    return table(spark, *data, *filler)


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 40])
class TestNewestWins:
    def merged(self, spark, target, source, broadcast_bytes):
        big = padded(spark, *target)
        result = newest_wins(big, table(spark, *source), ["k"], "at", broadcast_bytes)
        return rows(result.filter("v <> 'pad'"), "k", "v")

    def test_newer_replaces_older_keeps(self, spark, broadcast_bytes):
        target = [("e1", TEN, "x"), ("e2", TEN, "x")]
        source = [("e1", LATER, "y"), ("e2", NINE, "y"), ("e3", NINE, "y")]
        assert self.merged(spark, target, source, broadcast_bytes) == [("e1", "y"), ("e2", "x"), ("e3", "y")]

    def test_equal_keeps_the_target(self, spark, broadcast_bytes):
        assert self.merged(spark, [("e1", TEN, "x")], [("e1", TEN, "y")], broadcast_bytes) == [("e1", "x")]

    def test_null_version_on_either_side_keeps_the_target(self, spark, broadcast_bytes):
        target = [("e1", None, "x"), ("e2", TEN, "x")]
        source = [("e1", TEN, "y"), ("e2", None, "y")]
        assert self.merged(spark, target, source, broadcast_bytes) == [("e1", "x"), ("e2", "x")]

    def test_null_keys_are_inserted_again(self, spark, broadcast_bytes):
        merged = self.merged(spark, [(None, TEN, "x")], [(None, TEN, "y")], broadcast_bytes)
        assert merged == [(None, "x"), (None, "y")]

    def test_the_whole_row_is_replaced(self, spark, broadcast_bytes):
        assert self.merged(spark, [("e1", NINE, "x")], [("e1", TEN, None)], broadcast_bytes) == []

    def test_a_second_application_changes_nothing(self, spark, broadcast_bytes):
        target, source = padded(spark, ("e1", TEN, "x")), table(spark, ("e1", LATER, "y"), ("e4", TEN, "z"))
        once = newest_wins(target, source, ["k"], "at", broadcast_bytes)
        assert rows(newest_wins(once, source, ["k"], "at", broadcast_bytes)) == rows(once)


def test_a_small_batch_does_not_shuffle_the_target(spark, tmp_path):
    for name, count in (("target", 100_000), ("source", 10)):
        spark.range(count).selectExpr("cast(id as string) k", "timestamp'2026-01-01' at", "'x' v").write.parquet(
            str(tmp_path / name)
        )
    target, source = (spark.read.parquet(str(tmp_path / n)) for n in ("target", "source"))
    plan = newest_wins(target, source, ["k"], "at")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin FullOuter" not in plan
    kept = plan[: plan.index("LeftAnti")]
    assert "BroadcastHashJoin" in kept and "Exchange hashpartitioning" not in kept.split("Union")[0]


def test_insert_if_absent_on_two_columns(spark):
    target = table(spark, ("c1", NINE, "old"), ("c2", None, "old"))
    source = table(spark, ("c1", NINE, "new"), ("c1", TEN, "new"), ("c2", None, "new"), (None, TEN, "new"))
    expected = [(None, "new"), ("c1", "new"), ("c1", "old"), ("c2", "new"), ("c2", "old")]
    for limit in (0, 1 << 40):
        assert rows(insert_if_absent(target, source, ["k", "at"], limit), "k", "v") == expected
        assert absent_rows(source, target, ["k", "at"], limit).count() == 3
