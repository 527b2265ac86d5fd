import json
import os

import pytest

from stratafold.__main__ import execute, parser
from stratafold.plans.aliases import create_views
from stratafold.sources.layers import Layers
from tests.conftest import rows

B1, B2 = "2026-03-11", "2026-09-01"


def drop(folder, name, records):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w", encoding="utf-8") as out:
        out.writelines(json.dumps(r) + "\n" for r in records)


def event(event_id, at, kind="login", ticket=None, **more):
    return {
        "event_id": event_id,
        "customer_id": "c1",
        "event_type": kind,
        "occurred_at": at,
        "updated_at": at,
        "channel": "web",
        "properties": {"ticket_id": ticket},
        **more,
    }


def customer(plan, at):
    return {
        "customer_id": "c1",
        "company_name": "One",
        "plan": plan,
        "segment": "S",
        "signup_date": "2026-03-01",
        "country": "BR",
        "is_active": True,
        "updated_at": at,
    }


def test_steps_one_by_one_then_whole_runs(spark, tmp_path):
    root, landing = str(tmp_path / "lake"), str(tmp_path / "landing")
    base = ["--root", root, "--prefix", "cmd_", "--events-landing", f"{landing}/e", "--customers-landing", f"{landing}/c"]

    def run(step, *more):
        execute(spark, parser().parse_args([step, *base, *more]))

    drop(f"{landing}/e", "1", [event("e1", "2026-03-10T10:00:00Z", "ticket_opened", "t1")])
    drop(f"{landing}/c", "1", [customer("free", "2026-03-01T00:00:00Z")])
    run("create")
    for step in ("ingest", "bronze-events", "bronze-customers", "silver-events", "silver-customers", "quality"):
        run(step, "--batch", B1)
    run("marts")
    layers = Layers(spark, root, "cmd_")
    assert rows(layers.read("gold.response_time"), "plan", "unanswered_tickets") == [("free", 1)]

    drop(f"{landing}/e", "2", [event("e2", "2026-08-31T10:00:00Z", "ticket_replied", "t1", source_app="x")])
    drop(f"{landing}/c", "2", [customer("pro", "2026-08-01T00:00:00Z")])
    run("run", "--batch", B2)
    run("backfill", "--batch", B2, B1)
    run("counts")
    assert rows(layers.read("gold.response_time"), "plan", "answered_tickets") == [("free", 1)]
    assert rows(layers.read("bronze.events"), "event_id", "source_app") == [("e1", None), ("e2", "x")]

    # Reports written against the older names keep working, through later rebuilds too.
    sql = "SELECT plan, mes, tickets_com_resposta FROM cmd_gold.tempo_resposta_ticket ORDER BY mes, plan"
    assert rows(spark.sql(sql)) == [("free", "2026-03", 1)]
    assert rows(spark.sql("SELECT customer_id, total_eventos FROM cmd_gold.top_clientes_30d")) == [("c1", 1)]
    assert rows(spark.sql("SELECT cohort_month, retencao_pct FROM cmd_gold.retencao_coorte")) == [
        ("2026-03", 100.0)
    ] * 2
    assert len(create_views(layers)) == 3


def test_a_step_needs_its_batch(spark, tmp_path):
    with pytest.raises(SystemExit):
        execute(spark, parser().parse_args(["quality", "--root", str(tmp_path)]))
    with pytest.raises(SystemExit):
        parser().parse_args(["unknown", "--root", "x"])
