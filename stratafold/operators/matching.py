"""First-response matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions import minutes_between
from stratafold.operators.sizing import BROADCAST_BYTES, HOT_ROWS, SMALL_BYTES
from stratafold.operators.skew import salted_join


def first_response(
    opened: DataFrame,
    replies: DataFrame,
    ticket: str,
    at: str,
    hot_rows: int = HOT_ROWS,
    small_bytes: int = SMALL_BYTES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Every opening with the first reply to its ticket and the minutes in between.

    Openings without a reply, or without a ticket id, stay with NULLs.  Every
    opening of a ticket counts, and a reply may precede the opening.
    """
    first = (
        replies.filter(F.col(ticket).isNotNull())
        .groupBy(ticket)
        .agg(F.min(at).alias("first_reply_at"))
    )
    matched = salted_join(
        opened,
        first,
        [ticket],
        "left",
        hot_rows=hot_rows,
        small_bytes=small_bytes,
        broadcast_bytes=broadcast_bytes,
    )
    return matched.withColumn("response_minutes", minutes_between(F.col(at), F.col("first_reply_at")))
