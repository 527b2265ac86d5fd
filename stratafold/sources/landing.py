"""Raw zone: gzip JSON lines below ``raw/<source>/ingestion_date=<day>/``.

Each extract of a day has its own folder, named by the mark it started from, so a
rerun overwrites its own files and a later extract of the same day adds to it.
"""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.domains import FIRST_RUN
from stratafold.sources import files
from stratafold.sources.layers import TEXT_TIMESTAMPS
from stratafold.sources.relational import mark_of, unreadable

logger = logging.getLogger(__name__)

# Column for the text of lines that are no JSON object.
CORRUPT = "_corrupt_record"

JSON_WRITE = {"compression": "gzip", "ignoreNullFields": "false", **TEXT_TIMESTAMPS}


def batch_folder(root: str, source: str, batch_id: str) -> str:
    return f"{root.rstrip('/')}/raw/{source}/ingestion_date={batch_id}"


def extract_folder(root: str, source: str, batch_id: str, since: str | None) -> str:
    mark = re.sub(r"[^0-9A-Za-z]", "", since or FIRST_RUN)
    return f"{batch_folder(root, source, batch_id)}/since={mark}"


def reject_folder(root: str, source: str, batch_id: str, since: str | None) -> str:
    """Where rows of an extract go that no later step could place in time."""
    return extract_folder(root, source, batch_id, since).replace("/raw/", "/rejected/", 1)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").options(**JSON_WRITE).json(folder)


@dataclass(frozen=True)
class Saved:
    """A stored extract: its folder, its greatest ``updated_at``, and how many rows
    were stored and set aside."""

    folder: str
    mark: str | None
    rows: int
    rejected: int


def save_raw(
    df: DataFrame,
    root: str,
    source: str,
    batch_id: str,
    since: str | None = None,
    updated_at: str = "updated_at",
) -> Saved | None:
    """Write one extract; None, and no folder, when it is empty.

    Mark and counts are taken from the rows as they are written: no pass to see
    whether there are any, and no gap between what is stored and what the mark stands
    for.  Rows whose ``updated_at`` names no instant go to the reject folder instead;
    only when there are some is the extract read once more.
    """
    folder = extract_folder(root, source, batch_id, since)
    if files.exists(df.sparkSession, folder) and df.isEmpty():
        return None  # what an earlier attempt has stored stays
    bad = unreadable(updated_at) if df.schema[updated_at].dataType.typeName() == "string" else F.lit(False)
    seen = Observation()
    # A gzip file is read by one task, so the rows of a source read by few tasks are dealt
    # evenly first; counted behind that, where a repeated task counts once.
    counted = df.hint("repartition").observe(
        seen,
        mark_of(df, updated_at).alias("mark"),
        F.count("*").alias("all"),
        F.count_if(bad).alias("bad"),
    )
    write_json(counted.filter(~bad), folder)
    found = seen.get
    rejected = reject_folder(root, source, batch_id, since)
    if found["bad"]:
        write_json(df.filter(bad), rejected)
        logger.warning("%s: %d rows without a readable %s in %s", source, found["bad"], updated_at, rejected)
    stored = found["all"] - found["bad"]
    if not stored:
        files.delete(df.sparkSession, folder)
        for above in (batch_folder(root, source, batch_id), f"{root}/raw/{source}", f"{root}/raw"):
            if files.exists(df.sparkSession, above) and not files.names(df.sparkSession, above):
                files.delete(df.sparkSession, above)
        return None
    return Saved(folder, found["mark"], stored, found["bad"])


def read_json(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Read with a schema: no inference pass, and a JSON object read into a STRING
    column keeps its text as it was."""
    reader = spark.read.schema(schema).options(
        recursiveFileLookup=True, columnNameOfCorruptRecord=CORRUPT, **TEXT_TIMESTAMPS
    )
    return reader.json(folder)


def read_landing(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Every file below ``folder``; a missing folder is an empty table.

    Top-level fields outside ``schema`` become text columns.  Names that differ by
    case only are one column, with the first value found.  Lines that are no JSON
    object keep their text in ``_corrupt_record``, a column that is there only if
    there are such lines.
    """
    if not files.exists(spark, folder):
        return spark.createDataFrame([], schema)
    forms = field_names(spark, folder)
    text = lambda name: T.StructField(name, T.StringType(), True)
    known = {f.name.lower(): f for f in schema}
    wanted = {f.name.lower(): f.name for f in schema}
    for name in forms:
        if name != CORRUPT:
            wanted.setdefault(name.lower(), name)
    # Every spelling is read under a name of its own and merged afterwards.
    if all(forms_of == [wanted[low]] for low, forms_of in _spellings(forms, wanted).items()):
        extra = [text(n) for low, n in wanted.items() if low not in known]
        corrupt = [text(CORRUPT)] if CORRUPT in forms else []
        return read_json(spark, folder, T.StructType([*schema, *extra, *corrupt]))
    lines = spark.read.options(recursiveFileLookup=True).text(folder)
    parsed = lines.select("value", F.from_json("value", "map<string,string>").alias("fields"))
    merged = {
        name: F.coalesce(*[F.try_element_at("fields", F.lit(f)) for f in _spellings(forms, wanted).get(low, [name])])
        for low, name in wanted.items()
    }
    columns = [
        (c.try_cast(known[low].dataType) if low in known else c).alias(name)
        for (low, name), c in zip(wanted.items(), merged.values(), strict=True)
    ]
    if CORRUPT in forms:
        columns.append(F.when(F.json_object_keys("value").isNull(), F.col("value")).alias(CORRUPT))
    return parsed.select(*columns)


def _spellings(forms: list[str], wanted: dict[str, str]) -> dict[str, list[str]]:
    """By lower case: all spellings found, the wanted one first."""
    out: dict[str, list[str]] = {}
    for name in forms:
        if name != CORRUPT:
            out.setdefault(name.lower(), []).append(name)
    return {low: sorted(names, key=lambda n: (n != wanted[low], n)) for low, names in out.items()}


def read_raw(
    spark: SparkSession, root: str, source: str, batch_id: str, schema: T.StructType
) -> DataFrame:
    """All extracts of one day; a day without any is an empty batch."""
    return read_landing(spark, batch_folder(root, source, batch_id), schema)


def field_names(spark: SparkSession, folder: str) -> list[str]:
    """All top-level field names, and ``_corrupt_record`` if a line is no JSON object.

    One distributed pass over the keys; only the distinct names reach the driver.
    """
    lines = spark.read.options(recursiveFileLookup=True).text(folder).filter("trim(value) <> ''")
    keys = F.coalesce(F.json_object_keys("value"), F.array(F.lit(CORRUPT)))
    names = lines.select(F.explode(keys).alias("name")).distinct()
    return sorted(row["name"] for row in names.collect())


def drift_fields(spark: SparkSession, folder: str, schema: T.StructType) -> list[str]:
    """Names of top-level fields the schema lacks."""
    known = {name.lower() for name in schema.fieldNames()}
    return [n for n in field_names(spark, folder) if n.lower() not in known and n != CORRUPT]
