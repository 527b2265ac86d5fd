"""Data-quality checks.

Every metric is one row of a tall (name, value, text) relation built from a few
aggregated passes; the checks turn the metrics into result rows.  Nothing but the
finished rows ever reaches the driver.

Passes: keys of all events (uniqueness), one row per batch (volume, domain,
freshness), events per customer against current customers (references), and
current customers (domain).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold import domains

BLOCKING, WARNING = "BLOCKING", "WARNING"
PASSED, FAILED = "PASSED", "FAILED"

RESULT_COLUMNS = (
    "check_name",
    "check_type",
    "severity",
    "status",
    "table_name",
    "metric_value",
    "threshold_value",
    "details",
    "batch_id",
)


@dataclass(frozen=True)
class Check:
    name: str
    kind: str
    severity: str
    table: str


UNIQUENESS = Check("event_id_uniqueness", "uniqueness", BLOCKING, "silver.events")
REFERENCES = Check("customer_reference", "referential_integrity", WARNING, "silver.events")
VOLUME = Check("event_volume", "volume", WARNING, "silver.events")
DOMAINS = Check("domain_values", "domain", WARNING, "silver.events,silver.customers")
FRESHNESS = Check("event_freshness", "freshness", BLOCKING, "silver.events")
CHECKS = (UNIQUENESS, REFERENCES, VOLUME, DOMAINS, FRESHNESS)


def surplus_keys(df: DataFrame, keys: Sequence[str], name: str = "duplicates") -> DataFrame:
    """Rows minus distinct keys, in one row; a NULL key counts as a surplus row.

    Counting per key first keeps a hot key at one row per input partition.
    """
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    surplus = F.coalesce(F.sum("_n"), F.lit(0)) - F.count_if(whole)
    return per_key.agg(surplus.cast("long").alias(name))


def missing_references(
    df: DataFrame, dimension: DataFrame, key: str, dimension_key: str, name: str = "orphans"
) -> DataFrame:
    """Rows whose non-NULL ``key`` is absent from the dimension, in one row.

    Rows are counted per key before the anti-join, so the join sees each key once.
    """
    per_key = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    known = dimension.select(F.col(dimension_key).alias("_known"))
    lost = per_key.join(known, F.col(key) == F.col("_known"), "left_anti")
    return lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias(name))


def outside(value: str, legal: Sequence[str]) -> Column:
    return F.col(value).isNotNull() & ~F.col(value).isin(*legal)


def batch_profile(
    events: DataFrame,
    batch: str = "_batch_id",
    event_type: str = "event_type",
    at: str = "occurred_at",
    legal: Sequence[str] = domains.EVENT_TYPES,
) -> DataFrame:
    """One row per batch: rows, illegal event types, newest event."""
    return events.groupBy(F.col(batch).alias("batch")).agg(
        F.count("*").alias("rows"),
        F.count_if(outside(event_type, legal)).alias("illegal"),
        F.max(at).alias("newest"),
    )


def batch_summary(
    profile: DataFrame, batch_id: str, history: int = domains.VOLUME_HISTORY_BATCHES, stored: bool = False
) -> DataFrame:
    """Everything the checks need from the events of one batch, in one row.

    ``average`` and ``deviation_pct`` compare the volume with the ``history`` other
    batches of the greatest ids, NULL without any.  ``lag_days`` runs from the newest
    event of the batch to its date: 0 for an empty batch, negative when the data is
    newer than the date.

    The profile is read once.  The list built on the way has one small entry per
    batch ever loaded, never one per event.  A ``stored`` profile, cheap to read, is read
    twice instead, and the other batches are the top of an order: ``history`` rows a task.
    """
    own = F.col("batch") == batch_id
    others = F.collect_list(F.when(F.col("batch") != batch_id, F.struct("batch", "rows")))
    row = profile.agg(
        F.coalesce(F.sum(F.when(own, F.col("rows"))), F.lit(0)).alias("volume"),
        *([] if stored else [F.slice(F.sort_array(others, asc=False), 1, history).getField("rows").alias("_others")]),
        F.coalesce(F.sum("illegal"), F.lit(0)).alias("illegal_event_types"),
        F.max(F.when(own, F.col("newest"))).alias("newest"),
    )
    if stored:
        recent = profile.filter(~own).orderBy(F.desc("batch")).limit(history)
        average = recent.agg(F.sum("rows") / F.nullif(F.count("*"), F.lit(0))).scalar()
    else:
        total = F.aggregate("_others", F.lit(0).cast("long"), lambda sum_, n: sum_ + n)
        average = total / F.nullif(F.size("_others"), F.lit(0))
    lag = F.datediff(F.lit(batch_id).cast("date"), F.col("newest"))
    row = row.withColumn("average", average)
    deviation = F.abs(F.col("volume") - F.col("average")) / F.nullif("average", F.lit(0.0)) * 100
    return row.select(
        "volume",
        "average",
        deviation.alias("deviation_pct"),
        "illegal_event_types",
        "newest",
        F.coalesce(lag, F.lit(0)).cast("long").alias("lag_days"),
    )


def volume_deviation(profile: DataFrame, batch_id: str) -> DataFrame:
    return batch_summary(profile, batch_id).select("volume", "average", "deviation_pct")


def freshness_lag(profile: DataFrame, batch_id: str) -> DataFrame:
    return batch_summary(profile, batch_id).select("newest", "lag_days")


def illegal_plans(customers: DataFrame, plans: Sequence[str] = domains.PLANS) -> DataFrame:
    """Current customers with a plan outside the domain, in one row."""
    current = customers.filter(F.col("is_current"))
    return current.agg(F.count_if(outside("plan", plans)).alias("illegal_plans"))


def _tall(row: DataFrame) -> DataFrame:
    """One row of measures as (name, value, text); timestamps as text, the rest as numbers."""
    nothing = {"value": F.lit(None).cast("double"), "text": F.lit(None).cast("string")}
    entries = []
    for name in row.columns:
        fields = {"name": F.lit(name), **nothing}
        if name == "newest":
            fields["text"] = F.date_format(name, "yyyy-MM-dd HH:mm:ss")
        else:
            fields["value"] = F.col(name).cast("double")
        entries.append(F.struct(*[column.alias(field) for field, column in fields.items()]))
    return row.select(F.inline(F.array(*entries)))


MEASURES = (
    "duplicates",
    "orphans",
    "volume",
    "average",
    "deviation_pct",
    "illegal_event_types",
    "illegal_plans",
    "lag_days",
)


def results(metrics: DataFrame, batch_id: str, checks: Sequence[Check] = CHECKS) -> DataFrame:
    """Turn tall metrics into one result row per check."""
    wide = metrics.agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in MEASURES],
        F.max(F.when(F.col("name") == "newest", F.col("text"))).alias("newest"),
    )
    rows = [_row(check, batch_id) for check in checks]
    return wide.select(F.inline(F.array(*rows)))


def _row(check: Check, batch_id: str) -> Column:
    value, threshold, details = _RULES[check.name](batch_id)
    value, threshold = value.cast("double"), threshold.cast("double")
    # Without history the volume is reported against a threshold of 0, and passes.
    failed = value > threshold
    if check is VOLUME:
        failed = F.col("deviation_pct") > domains.VOLUME_MAX_DEVIATION_PCT
    fields = {
        "check_name": F.lit(check.name),
        "check_type": F.lit(check.kind),
        "severity": F.lit(check.severity),
        "status": F.when(failed, FAILED).otherwise(PASSED),
        "table_name": F.lit(check.table),
        "metric_value": value,
        "threshold_value": threshold,
        "details": details,
        "batch_id": F.lit(batch_id),
    }
    return F.struct(*[column.alias(name) for name, column in fields.items()])


def _whole(name: str) -> Column:
    return F.col(name).cast("long")


def _uniqueness(_: str) -> tuple[Column, Column, Column]:
    return (
        F.col("duplicates"),
        F.lit(0),
        F.format_string("%d duplicate event ids", _whole("duplicates")),
    )


def _references(_: str) -> tuple[Column, Column, Column]:
    return (
        F.col("orphans"),
        F.lit(0),
        F.format_string("%d events without a current customer", _whole("orphans")),
    )


def _volume(_: str) -> tuple[Column, Column, Column]:
    compared = F.col("deviation_pct").isNotNull()
    return (
        F.when(compared, F.round("deviation_pct", 2)).otherwise(F.col("volume")),
        F.when(compared, F.lit(domains.VOLUME_MAX_DEVIATION_PCT)).otherwise(F.lit(0.0)),
        F.when(
            compared,
            F.format_string(
                "volume %d | average %.0f | deviation %.1f%%",
                _whole("volume"),
                F.col("average"),
                F.col("deviation_pct"),
            ),
        ).otherwise(F.lit("no history to compare the volume with")),
    )


def _domains(_: str) -> tuple[Column, Column, Column]:
    return (
        F.col("illegal_event_types") + F.col("illegal_plans"),
        F.lit(0),
        F.format_string(
            "%d illegal event types | %d illegal plans",
            _whole("illegal_event_types"),
            _whole("illegal_plans"),
        ),
    )


def _freshness(batch_id: str) -> tuple[Column, Column, Column]:
    return (
        F.col("lag_days"),
        F.lit(domains.FRESHNESS_MAX_LAG_DAYS),
        F.format_string(
            "batch %s | newest event %s | lag %d days",
            F.lit(batch_id),
            F.coalesce("newest", F.lit("none")),
            _whole("lag_days"),
        ),
    )


_RULES = {
    UNIQUENESS.name: _uniqueness,
    REFERENCES.name: _references,
    VOLUME.name: _volume,
    DOMAINS.name: _domains,
    FRESHNESS.name: _freshness,
}


def report(
    events: DataFrame, customers: DataFrame, batch_id: str, profile: DataFrame | None = None
) -> DataFrame:
    """The five result rows of a batch (without the execution time); ``profile`` is a stored one."""
    current = customers.filter(F.col("is_current"))
    if profile is None:
        summary = batch_summary(batch_profile(events), batch_id)
    else:
        summary = batch_summary(profile, batch_id, stored=True)
    measured = [
        surplus_keys(events, ["event_id"]),
        missing_references(events, current, "customer_id", "customer_id"),
        summary,
        illegal_plans(customers),
    ]
    metrics = _tall(measured[0])
    for row in measured[1:]:
        metrics = metrics.unionByName(_tall(row))
    return results(metrics, batch_id)


def failed_rows(log: DataFrame) -> DataFrame:
    """Failed checks of a result log, newest first."""
    return log.filter(F.col("status") == FAILED).orderBy(F.col("executed_at").desc(), "check_name")


def latest_rows(log: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` rows of a result log, newest first."""
    return log.orderBy(F.col("executed_at").desc(), "check_name").limit(n)


def blocking_failures(rows: DataFrame) -> DataFrame:
    """Names of failed checks that stop a run."""
    return rows.filter((F.col("severity") == BLOCKING) & (F.col("status") == FAILED)).select("check_name")
