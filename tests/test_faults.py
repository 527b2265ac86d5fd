"""Faulty input: what the checks, the stream and the registered queries over it show."""

import os

from stratafold.operators import quality
from stratafold.plans.silver import quarantine_folder
from stratafold.registry import faults
from stratafold.sources import landing
from stratafold.streaming.silver_stream import stream_events

DAY = "2026-03-01"


def test_every_check_fails_on_faulty_tables(spark, sf_dir):
    rows = faults.faulty_report(spark, sf_dir).collect()
    assert len(rows) == 5 and {r.status for r in rows} == {quality.FAILED}


def test_only_current_customers_count(spark, sf_dir):
    events, customers = faults.faulty_events(spark, sf_dir), faults.faulty_customers(spark, sf_dir)
    current = customers.filter("is_current")
    lost = [quality.missing_references(events, c, "customer_id", "customer_id").first()[0] for c in (current, customers)]
    assert lost[0] > lost[1]
    plans = [quality.illegal_plans(c).first()[0] for c in (customers, current)]
    assert plans[0] == plans[1] < customers.filter("plan = 'gold'").count()


def test_the_stream_keeps_the_text_of_broken_lines(spark, layers):
    layers.create("silver.events")
    folder = f"{landing.batch_folder(layers.root, 'events', DAY)}/since=0"
    os.makedirs(folder)
    with open(f"{folder}/a.json", "w") as out:
        out.write('{"event_id": "e1", "updated_at": "2026-03-01T10:00:00Z"}\n{broken line\n[1]\n')
    stream_events(layers, f"{layers.root}/checkpoint")
    assert [r.event_id for r in layers.read("silver.events").collect()] == ["e1"]
    apart = spark.read.parquet(quarantine_folder(layers, "events", "stream-0"))
    assert sorted(r["_corrupt_record"] for r in apart.collect()) == ["[1]", "{broken line"]
