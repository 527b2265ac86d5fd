"""The extract step: mark -> extract -> raw files -> new mark, in that order."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from stratafold.sources import landing
from stratafold.sources.layers import Layers
from stratafold.sources.relational import changed_since
from stratafold.sources.watermarks import read_watermark, write_watermark

logger = logging.getLogger(__name__)

# Takes the mark (None on a first run) and returns the rows newer than it.
Extract = Callable[[str | None], DataFrame]


@dataclass(frozen=True)
class Feeds:
    """The two sources of a run."""

    events: Extract
    customers: Extract


def feed_of(df: DataFrame) -> Extract:
    """A feed over a DataFrame whose ``updated_at`` is ISO text."""
    return lambda since: changed_since(df, since)


def ingest_source(layers: Layers, source: str, extract: Extract, batch_id: str) -> bool:
    """Extract one source; False when there was nothing new.

    The mark moves only after the rows are stored, so a failure in between repeats
    the extract instead of losing it.
    """
    since = read_watermark(layers, source)
    saved = landing.save_raw(extract(since), layers.root, source, batch_id, since)
    if saved is None:
        logger.info("%s: nothing newer than %s", source, since)
        return False
    logger.info("%s: %d rows stored, %d set aside", source, saved.rows, saved.rejected)
    if saved.mark is not None:
        write_watermark(layers, source, saved.mark)
    return True


def ingest(layers: Layers, feeds: Feeds, batch_id: str) -> dict[str, bool]:
    """Events first, then customers."""
    return {
        "events": ingest_source(layers, "events", feeds.events, batch_id),
        "customers": ingest_source(layers, "customers", feeds.customers, batch_id),
    }
