"""The history by hash buckets: a batch rewrites the buckets of its keys and leaves the others in place."""

import pytest
from pyspark.sql import functions as F

from stratafold.functions import lineage
from stratafold.operators.scd2 import apply_one_pass
from stratafold.plans.silver import load_silver_customers, typed_customers
from stratafold.schemas import BUCKET
from tests.conftest import rows

VERSION = ("customer_id", "plan", "valid_from", "valid_to", "is_current")


def customers(spark, *data):
    df = spark.createDataFrame(list(data), "customer_id string, plan string, updated_at string")
    more = {c: F.lit("x") for c in ("company_name", "segment", "country")}
    return df.withColumns(more | {"signup_date": F.lit("2026-01-01"), "is_active": F.lit("true")})


def load(layers, day, df, **options):
    layers.create("bronze.customers")
    layers.replace_batch("bronze.customers", df.withColumns(lineage(day, "customers")), day)
    load_silver_customers(layers, day, **options)


def files_by_bucket(layers):
    df = layers.read("silver.customers", physical=True)
    found = df.groupBy(BUCKET).agg(F.sort_array(F.collect_set("_metadata.file_path")).alias("files"))
    return {r[0]: r[1] for r in found.collect()}


FIRST = [(f"c{i}", "free", "2026-03-01T00:00:00.000000Z") for i in range(80)]


@pytest.mark.parametrize("mode", ["one_pass", "two_step"])
def test_a_batch_of_one_customer_leaves_all_other_files(spark, layers, mode):
    load(layers, "2026-03-02", customers(spark, *FIRST), mode=mode)
    before = files_by_bucket(layers)
    load(layers, "2026-03-03", customers(spark, ("c7", "pro", "2026-03-02T00:00:00.000000Z")), mode=mode)
    after = files_by_bucket(layers)
    assert len(before) > 8 and before.keys() == after.keys()
    assert sum(before[b] != after[b] for b in before) == 1
    versions = layers.read("silver.customers").filter("customer_id = 'c7'")
    assert rows(versions.select("plan", "is_current")) == [("free", False), ("pro", True)]
    assert layers.read("silver.customers").count() == 81 and BUCKET not in layers.read("silver.customers").columns


def test_batches_by_bucket_equal_one_history(spark, layers):
    data = [(None if i % 23 == 0 else f"c{i % 30}", f"p{i % 7}", f"2026-03-{1 + i * 13 % 28:02d}T00:00:00.000000Z") for i in range(200)]
    whole = None
    for k, day in enumerate(("2026-04-01", "2026-04-02", "2026-04-03")):
        part = customers(spark, *data[k::3])
        load(layers, day, part)
        batch = typed_customers(part.withColumns(lineage(day, "customers")))
        if whole is None:
            whole = layers.read("silver.customers").limit(0)
        whole = apply_one_pass(whole, batch, "customer_id")
    got = layers.read("silver.customers")
    # Equal versions of one batch may come from either row; the intervals are the same.
    keys = ("customer_id", "valid_from", "valid_to", "is_current")
    assert rows(got.select(*keys)) == rows(whole.select(*keys))


def test_an_empty_batch_changes_nothing_and_the_number_of_buckets_stays(spark, layers):
    load(layers, "2026-03-02", customers(spark, *FIRST))
    before = files_by_bucket(layers)
    layers.buckets = 3
    load(layers, "2026-03-03", customers(spark, *FIRST[:1]).limit(0))
    assert files_by_bucket(layers) == before
    load(layers, "2026-03-04", customers(spark, ("c1", "pro", "2026-03-02T00:00:00.000000Z")))
    assert layers.read("silver.customers").filter("customer_id = 'c1'").count() == 2


def test_a_stopped_change_is_completed_before_the_gate_reads(spark, layers, monkeypatch):
    load(layers, "2026-03-02", customers(spark, *FIRST))
    point = type(layers)._point_partitions

    def stopped(self, table, places):
        point(self, table, places[:1])
        raise RuntimeError("stopped")

    later = [(c, "pro", "2026-03-02T00:00:00.000000Z") for c, _, _ in FIRST]
    layers.replace_batch("bronze.customers", customers(spark, *later).withColumns(lineage("2026-03-03", "customers")), "2026-03-03")
    monkeypatch.setattr(type(layers), "_point_partitions", stopped)
    with pytest.raises(RuntimeError):
        load_silver_customers(layers, "2026-03-03")
    monkeypatch.undo()
    assert 80 < layers.read("silver.customers").count() < 160
    assert layers.recover("silver.events", "silver.customers")
    assert layers.read("silver.customers").count() == 160
