from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_order(present: Iterable[str], known: Iterable[str]) -> list[str]:
    """Known columns in their declared order, then unknown ones by name."""
    known = list(known)
    return [*known, *sorted(set(present) - set(known))]


def lineage(batch_id: str, source: str, run_at: datetime | None = None) -> dict[str, Column]:
    """The three control columns; one instant for the whole run."""
    run_at = run_at or datetime.now(timezone.utc)
    return {
        "_ingested_at": F.lit(run_at.isoformat()).cast("timestamp"),
        "_source_file": F.lit(source),
        "_batch_id": F.lit(batch_id),
    }
