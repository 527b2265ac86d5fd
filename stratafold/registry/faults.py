"""Queries over faulty input: failing checks, a blocked run, broken lines, and marts row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold import schemas
from stratafold.functions import json_attribute
from stratafold.operators import quality
from stratafold.operators.dedup import null_key_rows
from stratafold.plans.bronze import load_bronze, with_lineage
from stratafold.plans.gate import GateFailed, log_results
from stratafold.plans.medallion import run_batch
from stratafold.plans.silver import load_silver_events, quarantine_folder
from stratafold.registry import fixtures as fx
from stratafold.sources import landing
from stratafold.sources.layers import Layers

DAY = "2024-01-20"


def faulty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches dated four days after their events, logins of no legal type, one batch stored twice."""
    late = F.date_format(F.date_add("occurred_at", 4), "yyyy-MM-dd")
    kind = F.when(F.col("event_type") == "login", "sign_up").otherwise(F.col("event_type"))
    events = fx.silver_events(spark, sf_dir).withColumns({"_batch_id": late, "event_type": kind})
    return events.unionByName(events.filter(F.col("_batch_id") == DAY))


def faulty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a last digit 3, or 17, have left; those with a last digit 7 have no legal plan."""
    key = F.col("customer_id")
    plan = F.when(key.endswith("7"), "gold").otherwise(F.col("plan"))
    left = key.endswith("3") | key.endswith("17")
    return fx.silver_customers(spark, sf_dir).withColumns({"plan": plan, "is_current": ~left})


def _report(spark: SparkSession, sf_dir: str, day: str = DAY) -> DataFrame:
    return quality.report(faulty_events(spark, sf_dir), faulty_customers(spark, sf_dir), day)


def faulty_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five checks of one day fail."""
    return _report(spark, sf_dir)


def faulty_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failed rows in the log of two days."""
    layers = fx.scratch_layers(spark, "faults")
    for day in (DAY, "2024-01-24"):
        log_results(layers, _report(spark, sf_dir, day))
    failed = quality.failed_rows(layers.read("quality.check_results"))
    return failed.select("check_name", "severity", "status", "metric_value", "threshold_value", "batch_id")


def faulty_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failed checks that stop a run."""
    return quality.blocking_failures(_report(spark, sf_dir))


def _key(*names: str) -> Column:
    return F.concat_ws("|", *names).alias("key")


def _marts(layers: Layers) -> DataFrame:
    """The rows of the three marts in one form."""
    top = layers.read("gold.top_customers_30d").select(
        F.lit("top").alias("mart"),
        _key("customer_id", "company_name", "plan", "segment"),
        F.col("total_events").alias("n"),
        F.lit(None).cast("long").alias("of"),
        F.lit(None).cast("double").alias("value"),
    )
    response = layers.read("gold.response_time").select(
        F.lit("response").alias("mart"),
        _key("plan", "month"),
        F.col("answered_tickets").alias("n"),
        F.col("unanswered_tickets").alias("of"),
        F.col("avg_response_minutes").alias("value"),
    )
    retention = layers.read("gold.cohort_retention").select(
        F.lit("retention").alias("mart"),
        _key("cohort_month", "activity_month"),
        F.col("active_customers").alias("n"),
        F.col("cohort_customers").alias("of"),
        F.col("retention_pct").alias("value"),
    )
    return top.unionByName(response).unionByName(retention)


def gated_marts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marts after two batches that passed the gate."""
    layers = fx.scratch_layers(spark, "gated-marts")
    for day in ("2024-01-16", "2024-01-31"):
        run_batch(layers, fx.feeds_until(spark, sf_dir, day), day)
    return _marts(layers)


def blocked_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marts after a batch that passed and one whose events are too old: still those of the first."""
    layers = fx.scratch_layers(spark, "blocked")
    run_batch(layers, fx.feeds_until(spark, sf_dir, "2024-01-16"), "2024-01-16")
    stopped = []
    try:
        run_batch(layers, fx.feeds_until(spark, sf_dir, "2024-01-31"), "2024-02-20")
    except GateFailed as failure:
        stopped = failure.checks
    return _marts(layers).withColumn("stopped_by", F.lit(",".join(stopped)))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each event: as it is, a field in another case, a new field in two spellings, broken."""
    events = fx.silver_events(spark, sf_dir).select(
        *[F.col(c).cast("string").alias(c) for c in schemas.RAW_EVENTS.fieldNames()]
    )
    others = [F.col(c) for c in events.columns if c != "channel"]
    turn = F.col("event_id").cast("long") % 4
    capital = F.to_json(F.struct(*others, F.col("channel").alias("Channel"), F.lit("one").alias("source_app")))
    spelled = F.to_json(F.struct(*others, F.col("channel"), F.lit("two").alias("Source_App")))
    line = (
        F.when(turn == 0, capital)
        .when(turn == 1, F.concat(F.lit('{"event_id": "'), F.col("event_id")))
        .when(turn == 2, spelled)
        .otherwise(F.to_json(F.struct(*events.columns)))
    )
    return events.select(line.alias("value"))


def faulty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze and quarantine of a batch with broken lines and drifting names."""
    layers = fx.scratch_layers(spark, "lines")
    _lines(spark, sf_dir).write.text(landing.extract_folder(layers.root, "events", DAY, None), compression="gzip")
    load_bronze(layers, "events", DAY)
    load_silver_events(layers, DAY)
    apart = spark.read.parquet(quarantine_folder(layers, "events", DAY))
    columns = (
        "event_id",
        "channel",
        "source_app",
        json_attribute("properties", "ticket_id").alias("ticket_id"),
        F.col("_corrupt_record").alias("line"),
    )
    bronze = layers.read("bronze.events").select(F.lit("bronze").alias("zone"), *columns)
    return bronze.unionByName(null_key_rows(apart, ["event_id"]).select(F.lit("quarantine").alias("zone"), *columns))


def flag_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose source gives a boolean: Bronze holds its text."""
    stamped = with_lineage(fx.raw_customers(spark, sf_dir), DAY, "raw/customers/")
    return stamped.select("customer_id", "updated_at", "is_active", "_batch_id", "_source_file")


QUERIES = {
    f.__name__: f
    for f in (faulty_report, faulty_log, faulty_blocking, gated_marts, blocked_run, faulty_lines, flag_as_text)
}
