"""Raw files to Silver as an incremental stream.

The checkpoint takes the place of the stored high-water mark: each run handles
the files that arrived since the last one and then stops.  A micro-batch may be
delivered twice after a failure; the newest-wins upsert makes that harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stratafold.functions import lineage
from stratafold.operators.dedup import null_key_rows
from stratafold.plans.silver import quarantine, typed_events, upsert_events
from stratafold.schemas import RAW_EVENTS
from stratafold.sources.landing import CORRUPT
from stratafold.sources.layers import TEXT_TIMESTAMPS, Layers


def raw_stream(
    spark: SparkSession, folder: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    """Lines that are no JSON object keep their text in ``_corrupt_record``."""
    options: dict[str, str] = {
        "recursiveFileLookup": "true",
        "columnNameOfCorruptRecord": CORRUPT,
        **TEXT_TIMESTAMPS,
    }
    if max_files:
        options["maxFilesPerTrigger"] = str(max_files)
    wide = T.StructType([*schema, T.StructField(CORRUPT, T.StringType(), True)])
    return spark.readStream.schema(wide).options(**options).json(folder)


def run_available(
    stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Hand every pending micro-batch to ``apply`` and return the finished query."""
    query = (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(apply)
        .start()
    )
    query.awaitTermination()
    return query


def stream_events(layers: Layers, checkpoint: str, max_files: int | None = None) -> StreamingQuery:
    """Upsert new raw event files into ``silver.events``."""

    def apply(rows: DataFrame, epoch: int) -> None:
        # The folder name ingestion_date=<day> is the batch id, as in a batch run.
        day = F.regexp_extract("_source_file", "ingestion_date=([^/]+)", 1)
        columns = lineage("", "")
        columns |= {"_batch_id": day, "_source_file": F.col("_source_file")}
        rows = rows.withColumns(columns)
        quarantine(layers, "events", null_key_rows(rows, ["event_id"]), f"stream-{epoch}")
        upsert_events(layers, typed_events(rows, null_keys="drop"))

    folder = f"{layers.root}/raw/events"
    stream = raw_stream(layers.spark, folder, RAW_EVENTS, max_files)
    stream = stream.withColumn("_source_file", F.col("_metadata.file_path"))
    return run_available(stream, checkpoint, apply)
