"""The quality gate: log five results, then stop the run if a blocking one failed."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.operators import quality
from stratafold.plans import activity
from stratafold.session import staged
from stratafold.sources.layers import Layers

logger = logging.getLogger(__name__)

LOG = "quality.check_results"


class GateFailed(RuntimeError):
    def __init__(self, checks: list[str]):
        super().__init__(f"blocking checks failed: {checks}; see {LOG}")
        self.checks = checks


def log_results(layers: Layers, rows: DataFrame) -> None:
    """Append results to the history; a rerun adds to it on purpose."""
    layers.create(LOG)
    layers.append(LOG, rows.withColumn("executed_at", F.current_timestamp()).coalesce(1))


def run_gate(layers: Layers, batch_id: str) -> DataFrame:
    """Run all checks, log all of them, then raise if a blocking one failed."""
    layers.recover("silver.events", "silver.customers")
    profile = None
    if activity.kept(layers):
        activity.refresh(layers)
        profile = activity.batch_profiles(layers)
    found = quality.report(layers.read("silver.events"), layers.read("silver.customers"), batch_id, profile)
    rows = staged(found, "checks")
    log_results(layers, rows)
    # Five rows.
    status = {row["check_name"]: row["status"] for row in rows.select("check_name", "status").collect()}
    failed = sum(s == quality.FAILED for s in status.values())
    logger.info("quality checks: %d passed, %d failed", len(status) - failed, failed)
    stopping = sorted(row[0] for row in quality.blocking_failures(rows).collect())
    if stopping:
        raise GateFailed(stopping)
    return rows
