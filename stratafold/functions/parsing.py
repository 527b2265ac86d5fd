"""Text to typed values and back.  Malformed text becomes NULL under ANSI mode too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UTC_PATTERNS = {
    "second": "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "micro": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
}


def iso_timestamp(text: Column | str) -> Column:
    return F.try_to_timestamp(_col(text))


def iso_date(text: Column | str) -> Column:
    return _col(text).try_cast("date")


def truth(text: Column | str) -> Column:
    return _col(text).try_cast("boolean")


def utc_text(ts: Column | str, precision: str = "micro") -> Column:
    """ISO-8601 UTC text.  Microseconds are the default so that a stored high-water
    mark never sits just below the value it stands for."""
    return F.date_format(_col(ts), _UTC_PATTERNS[precision])


def json_attribute(text: Column | str, name: str) -> Column:
    return F.get_json_object(_col(text), f"$.{name}")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
