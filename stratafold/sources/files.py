"""Small files and folders through Hadoop's file systems, wherever the tables are."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the target and rename, so that no reader meets half a file."""
    fs, where = _at(spark, path)
    half = where.suffix(".half")
    out = fs.create(half, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(where, False)
    fs.rename(half, where)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None when there is none."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    """A file, or a folder with all it holds."""
    fs, where = _at(spark, path)
    fs.delete(where, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, sorted; nothing when it is missing."""
    fs, where = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def age_days(spark: SparkSession, folder: str) -> dict[str, float]:
    """Days since each entry of a folder was last changed."""
    fs, where = _at(spark, folder)
    if not fs.exists(where):
        return {}
    now = spark._jvm.java.lang.System.currentTimeMillis()
    return {s.getPath().getName(): (now - s.getModificationTime()) / 86_400_000 for s in fs.listStatus(where)}
