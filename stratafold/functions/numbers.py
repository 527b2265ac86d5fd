from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``100 * part / whole`` rounded half up as a decimal, NULL when ``whole`` is 0."""
    share = F.lit(Decimal("100.0")) * part / F.nullif(whole, F.lit(0))
    return F.round(share, digits).cast("double")
