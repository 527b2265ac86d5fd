"""Schemas of every layer, as StructType constants."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, TS, DAY, FLAG = T.StringType(), T.TimestampType(), T.DateType(), T.BooleanType()
LONG, DOUBLE = T.LongType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


def _strings(*names: str) -> list[tuple[str, T.DataType]]:
    return [(name, STRING) for name in names]


LINEAGE = [("_ingested_at", TS), ("_source_file", STRING), ("_batch_id", STRING)]

RAW_EVENTS = _struct(
    *_strings(
        "event_id", "customer_id", "event_type", "occurred_at", "updated_at", "channel", "properties"
    )
)
# is_active is read as text: the conversion to a boolean belongs to Silver.
RAW_CUSTOMERS = _struct(
    *_strings(
        "customer_id",
        "company_name",
        "plan",
        "segment",
        "signup_date",
        "country",
        "is_active",
        "updated_at",
    )
)

BRONZE_EVENTS = _struct(*[(f.name, f.dataType) for f in RAW_EVENTS], *LINEAGE)
BRONZE_CUSTOMERS = _struct(*[(f.name, f.dataType) for f in RAW_CUSTOMERS], *LINEAGE)

SILVER_EVENTS = _struct(
    *_strings("event_id", "customer_id", "event_type"),
    ("occurred_at", TS),
    ("updated_at", TS),
    *_strings("channel", "properties"),
    ("_customer_exists", FLAG),
    *LINEAGE,
)
SILVER_CUSTOMERS = _struct(
    *_strings("customer_id", "company_name", "plan", "segment"),
    ("signup_date", DAY),
    ("country", STRING),
    ("is_active", FLAG),
    ("updated_at", TS),
    ("valid_from", TS),
    ("valid_to", TS),
    ("is_current", FLAG),
    *LINEAGE,
)

TOP_CUSTOMERS_30D = _struct(
    *_strings("customer_id", "company_name", "plan", "segment"),
    ("total_events", LONG),
    ("_generated_at", TS),
)
RESPONSE_TIME = _struct(
    *_strings("plan", "month"),
    ("avg_response_minutes", DOUBLE),
    ("answered_tickets", LONG),
    ("unanswered_tickets", LONG),
    ("_generated_at", TS),
)
COHORT_RETENTION = _struct(
    *_strings("cohort_month", "activity_month"),
    ("cohort_customers", LONG),
    ("active_customers", LONG),
    ("retention_pct", DOUBLE),
    ("_generated_at", TS),
)

CHECK_RESULTS = _struct(
    *_strings("check_name", "check_type", "severity", "status", "table_name"),
    ("metric_value", DOUBLE),
    ("threshold_value", DOUBLE),
    *_strings("details", "batch_id"),
    ("executed_at", TS),
)

WATERMARKS = _struct(*_strings("source", "last_updated_at", "updated_at"))

# Physical partition column of silver.events; readers never see it.
EVENT_DATE = "event_date"
# And of the history: a hash bucket of the key, so that a batch rewrites only the buckets of its keys.
BUCKET = "key_bucket"
BUCKETED = {"silver.customers": "customer_id"}

# table -> (schema, partition columns, format)
TABLES: dict[str, tuple[T.StructType, tuple[str, ...], str]] = {
    "control.watermarks": (WATERMARKS, (), "json"),
    "bronze.events": (BRONZE_EVENTS, ("_batch_id",), "parquet"),
    "bronze.customers": (BRONZE_CUSTOMERS, ("_batch_id",), "parquet"),
    "silver.events": (
        T.StructType([*SILVER_EVENTS, T.StructField(EVENT_DATE, DAY, True)]),
        (EVENT_DATE,),
        "parquet",
    ),
    "silver.customers": (
        T.StructType([*SILVER_CUSTOMERS, T.StructField(BUCKET, T.IntegerType(), True)]),
        (BUCKET,),
        "parquet",
    ),
    "gold.top_customers_30d": (TOP_CUSTOMERS_30D, (), "parquet"),
    "gold.response_time": (RESPONSE_TIME, (), "parquet"),
    "gold.cohort_retention": (COHORT_RETENTION, (), "parquet"),
    "quality.check_results": (CHECK_RESULTS, (), "parquet"),
}
LAYERS = ("control", "bronze", "silver", "gold", "quality")

CUSTOMER_NUMBERS = _struct(("customer_id", STRING), ("number", LONG))
ACTIVE_CUSTOMERS = _struct(("month", DAY), ("slot", LONG), ("bits", T.BinaryType()), (EVENT_DATE, DAY))
BATCH_PROFILES = _struct(("batch", STRING), ("rows", LONG), ("illegal", LONG), ("newest", TS), (EVENT_DATE, DAY))

# Kept between runs so that marts need not read old events; not among the tables that are inspected.
STATE_TABLES: dict[str, tuple[T.StructType, tuple[str, ...], str]] = {
    "state.customer_numbers": (CUSTOMER_NUMBERS, (), "parquet"),
    "state.batch_profiles": (BATCH_PROFILES, (EVENT_DATE,), "parquet"),
    "state.active_customers": (ACTIVE_CUSTOMERS, (EVENT_DATE,), "parquet"),
}
ALL_TABLES = TABLES | STATE_TABLES
