"""Command line: ``spark-submit stratafold/__main__.py <step> --root ... [--batch ...]``.

Every step of a run can be started alone, as a scheduler would; ``run`` does all
of them behind the quality gate and ``backfill`` replays several dates.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from stratafold.plans.activity import refresh
from stratafold.plans.aliases import create_views
from stratafold.plans.bronze import load_bronze
from stratafold.plans.gate import run_gate
from stratafold.plans.medallion import backfill, build_marts, run_batch
from stratafold.plans.silver import load_silver_customers, load_silver_events
from stratafold.schemas import RAW_CUSTOMERS, RAW_EVENTS
from stratafold.session import build_session
from stratafold.sources.ingest import Feeds, feed_of, ingest
from stratafold.sources.landing import read_landing
from stratafold.sources.layers import Layers
from stratafold.sources.relational import customer_extract, jdbc_table

STEPS = (
    "create",
    "ingest",
    "bronze-events",
    "bronze-customers",
    "silver-events",
    "silver-customers",
    "quality",
    "marts",
    "activity",
    "run",
    "backfill",
    "counts",
)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratafold", description=__doc__)
    p.add_argument("step", choices=STEPS)
    p.add_argument("--root", required=True, help="folder of the raw zone and the tables")
    p.add_argument("--prefix", default="", help="prefix of the namespaces")
    p.add_argument("--batch", nargs="+", default=[], help="batch date(s), yyyy-MM-dd")
    p.add_argument("--events-landing", help="folder of JSON lines the event feed is dropped into")
    p.add_argument("--customers-landing", help="folder of JSON lines with customer records")
    p.add_argument("--customers-jdbc", help="JDBC url of the customer database")
    p.add_argument("--customers-table", default="crm.customers")
    p.add_argument("--customers-split", help="numeric or time column to read the table in parallel by")
    p.add_argument("--customers-range", nargs=2, metavar=("LOWER", "UPPER"), help="its bounds")
    p.add_argument("--customers-parts", type=int, default=8, help="how many ranges are read at a time")
    p.add_argument("--history", choices=("one_pass", "two_step"), default="one_pass")
    return p


def feeds(spark: SparkSession, args: argparse.Namespace) -> Feeds:
    def events(since):
        return feed_of(read_landing(spark, args.events_landing, RAW_EVENTS))(since)

    def customers(since):
        if args.customers_jdbc:
            split = {}
            if args.customers_split:
                lower, upper = args.customers_range or (None, None)
                split = {
                    "partition_column": args.customers_split,
                    "lower": lower,
                    "upper": upper,
                    "partitions": args.customers_parts,
                }
            table = jdbc_table(spark, url=args.customers_jdbc, table=args.customers_table, **split)
            return customer_extract(table, since)
        return feed_of(read_landing(spark, args.customers_landing, RAW_CUSTOMERS))(since)

    return Feeds(events, customers)


def execute(spark: SparkSession, args: argparse.Namespace) -> None:
    layers = Layers(spark, args.root, args.prefix)
    step, options = args.step, {"history_mode": args.history}
    if step == "backfill":
        backfill(layers, lambda _: feeds(spark, args), args.batch, **options)
        return
    if step in ("create", "marts", "counts"):
        layers.create_all()
        if step == "marts":
            build_marts(layers)
        if step == "counts":
            layers.row_counts().show(truncate=False)
        else:
            create_views(layers)
        return
    if step == "activity":
        refresh(layers)
        return
    if len(args.batch) != 1:
        raise SystemExit(f"{step} needs exactly one --batch")
    if step in ("ingest", "run") and not (args.events_landing and (args.customers_landing or args.customers_jdbc)):
        raise SystemExit(f"{step} needs --events-landing and --customers-landing or --customers-jdbc")
    (batch,) = args.batch
    actions = {
        "ingest": lambda: ingest(layers, feeds(spark, args), batch),
        "bronze-events": lambda: load_bronze(layers, "events", batch),
        "bronze-customers": lambda: load_bronze(layers, "customers", batch),
        "silver-events": lambda: load_silver_events(layers, batch),
        "silver-customers": lambda: load_silver_customers(layers, batch, args.history),
        "quality": lambda: run_gate(layers, batch),
        "run": lambda: run_batch(layers, feeds(spark, args), batch, **options),
    }
    actions[step]()


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    args = parser().parse_args(argv)
    execute(build_session(f"stratafold {args.step}"), args)


if __name__ == "__main__":
    main()
