"""Column expressions; all built in, none of them a Python UDF."""

from stratafold.functions.columns import canonical_order, lineage
from stratafold.functions.numbers import percent
from stratafold.functions.parsing import iso_date, iso_timestamp, json_attribute, truth, utc_text
from stratafold.functions.times import minutes_between, month_of, trailing_start

__all__ = [
    "canonical_order",
    "iso_date",
    "iso_timestamp",
    "json_attribute",
    "lineage",
    "minutes_between",
    "month_of",
    "percent",
    "trailing_start",
    "truth",
    "utc_text",
]
