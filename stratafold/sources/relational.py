"""Incremental extracts from a relational source and from a landing zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.domains import FIRST_RUN
from stratafold.functions import iso_timestamp, utc_text

CUSTOMER_COLUMNS = (
    "customer_id",
    "company_name",
    "plan",
    "segment",
    "signup_date",
    "country",
    "is_active",
    "updated_at",
)


def jdbc_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: str | None = None,
    upper: str | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    **more: str,
) -> dict[str, str]:
    """Reader options; with a partition column the extract is read in parallel ranges."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **more}
    if partition_column:
        if lower is None or upper is None:
            raise ValueError("a partition column needs lower and upper bounds")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": lower,
            "upperBound": upper,
            "numPartitions": str(partitions),
        }
    return options


def jdbc_table(spark: SparkSession, **options) -> DataFrame:
    """A relational table.  Later filters and column lists are sent to the database."""
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def changed_since(df: DataFrame, since: str | None, updated_at: str = "updated_at") -> DataFrame:
    """Rows strictly newer than ``since``; the start of time when there is none.

    Text is compared as the instant it names, so a fraction of a second more or less
    in its form changes nothing.  Text that names none is let through, for the raw
    zone to set aside; a missing timestamp is older than all.  Typed timestamps are
    compared as such, and the filter reaches the source.
    """
    kind, mark = df.schema[updated_at].dataType, since or FIRST_RUN
    if kind.typeName() != "string":
        return df.filter(F.col(updated_at) > F.lit(mark).cast(kind))
    newer = iso_timestamp(updated_at) > iso_timestamp(F.lit(mark))
    return df.filter(newer | unreadable(updated_at))


def unreadable(updated_at: str = "updated_at") -> Column:
    """Text that is there but names no instant."""
    return F.col(updated_at).isNotNull() & iso_timestamp(updated_at).isNull()


def customer_extract(table: DataFrame, since: str | None) -> DataFrame:
    """The eight customer columns changed since the mark; dates and times as ISO text."""
    rows = changed_since(table, since).select(*CUSTOMER_COLUMNS)
    return rows.withColumns(
        {"signup_date": F.col("signup_date").cast("string"), "updated_at": utc_text("updated_at")}
    )


def high_water_mark(df: DataFrame, updated_at: str = "updated_at") -> DataFrame:
    """Greatest ``updated_at``; rows without a readable one are ignored."""
    return df.agg(mark_of(df, updated_at).alias("last_updated_at"))


def mark_of(df: DataFrame, updated_at: str = "updated_at") -> Column:
    """The text, or value, of the latest instant; the greatest text of equal ones."""
    if df.schema[updated_at].dataType.typeName() != "string":
        return F.max(updated_at)
    at = iso_timestamp(updated_at)
    return F.max(F.when(at.isNotNull(), F.struct(at.alias("at"), F.col(updated_at).alias("text")))).getField("text")
