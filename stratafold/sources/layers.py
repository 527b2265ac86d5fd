"""The layer tables: creation, batch replacement, snapshot swaps, inspection.

Tables are ordinary Spark catalog tables over Parquet (JSON for the control
table).  A write never touches files a reader may hold: it fills a new folder and
then points the table, or the partitions concerned, to it.  One writer per table.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.functions import canonical_order
from stratafold.schemas import ALL_TABLES, BUCKET, BUCKETED, EVENT_DATE, LAYERS, TABLES
from stratafold.sources import files


class Layers:
    """Names and folders of one set of layer tables.

    ``prefix`` goes before every namespace, so several sets can share a catalog.
    ``buckets`` holds for history tables created from now on: enough that one bucket is
    quickly rewritten (some GB), as few as the catalog should repoint in one batch.
    """

    def __init__(self, spark: SparkSession, root: str, prefix: str = "", buckets: int = 16):
        self.spark = spark
        self.root = root.rstrip("/")
        self.prefix = prefix
        self.buckets = buckets

    # -- names -----------------------------------------------------------------

    def name(self, table: str) -> str:
        layer, short = table.split(".")
        return f"`{self.prefix}{layer}`.`{short}`"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(table).replace("`", ""))

    def _new_folder(self, table: str) -> str:
        return f"{self.root}/{table.replace('.', '/')}/snapshot-{uuid.uuid4().hex}"

    # -- creation --------------------------------------------------------------

    def create_namespace(self, layer: str) -> None:
        self.spark.sql(
            f"CREATE NAMESPACE IF NOT EXISTS `{self.prefix}{layer}` LOCATION '{self.root}/{layer}'"
        )

    def create(self, table: str) -> None:
        """Create a table from its schema constant, and its namespace, if absent."""
        self.create_namespace(table.split(".")[0])
        schema, partitions, kind = ALL_TABLES[table]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = f"PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
        options = "OPTIONS (compression 'snappy')" if kind == "parquet" else ""
        properties = f"TBLPROPERTIES ('buckets' = '{self.buckets}')" if table in BUCKETED else ""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({columns}) USING {kind} "
            f"{options} {by} LOCATION '{self._new_folder(table)}' {properties}"
        )

    def create_all(self) -> None:
        for layer in LAYERS:
            self.create_namespace(layer)
        for table in TABLES:
            self.create(table)

    # -- reading ---------------------------------------------------------------

    def read(self, table: str, physical: bool = False) -> DataFrame:
        """The table in declared column order, drift columns last.

        ``physical=True`` keeps the day or bucket column that a table is stored by.
        """
        df = self.spark.table(self.name(table))
        known = ALL_TABLES[table][0].fieldNames()
        df = df.select(*canonical_order(df.columns, known))
        return df if physical else df.drop(EVENT_DATE, BUCKET)

    def batch(self, table: str, batch_id: str) -> DataFrame:
        """The slice of one batch; reads only its partition where stored by batch."""
        return self.read(table).filter(F.col("_batch_id") == batch_id)

    # -- writing ---------------------------------------------------------------

    def replace_batch(self, table: str, df: DataFrame, batch_id: str) -> None:
        """Replace the rows of one batch.

        Columns the table does not have are added to it first and are NULL on
        older rows.  The new rows become visible in one step.
        """
        if not re.fullmatch(r"[0-9A-Za-z_.-]+", batch_id):
            raise ValueError(f"batch id: {batch_id!r}")
        known = ALL_TABLES[table][0].fieldNames()
        self._add_columns(table, df)
        folder = self._new_folder(table)
        ordered = df.select(*canonical_order(df.columns, known)).drop("_batch_id")
        ordered.write.parquet(folder)
        self._point_partitions(table, [({"_batch_id": batch_id}, folder)])

    def _add_columns(self, table: str, df: DataFrame) -> None:
        have = {c.lower() for c in self.spark.table(self.name(table)).columns}
        fresh = sorted((f for f in df.schema if f.name.lower() not in have), key=lambda f: f.name)
        if fresh:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh)
            self.spark.sql(f"ALTER TABLE {self.name(table)} ADD COLUMNS ({columns})")

    def swap(self, table: str, df: DataFrame) -> None:
        """Full overwrite: write a new snapshot, then point the table to it.

        The plan of ``df`` may read the table itself.  Of a bucketed table all buckets
        are replaced, one after the other.
        """
        if table in BUCKETED:
            buckets = range(self._buckets(table))
            return self.swap_partitions(table, self.bucketed(table, df), buckets)
        schema, _, kind = ALL_TABLES[table]
        folder = self._new_folder(table)
        df.select(*schema.fieldNames()).write.format(kind).save(folder)
        self.spark.sql(f"ALTER TABLE {self.name(table)} SET LOCATION '{folder}'")
        self.spark.catalog.refreshTable(self.name(table))

    def _buckets(self, table: str) -> int:
        """The number of buckets that the table was created with."""
        return int(self.spark.sql(f"SHOW TBLPROPERTIES {self.name(table)} ('buckets')").first()["value"])

    def bucketed(self, table: str, df: DataFrame) -> DataFrame:
        """Rows with the bucket of their key; rows without a key share one."""
        bucket = F.pmod(F.xxhash64(F.col(BUCKETED[table])), F.lit(self._buckets(table))).cast("int")
        return df.withColumn(BUCKET, bucket)

    def swap_partitions(self, table: str, df: DataFrame, touched: Iterable) -> None:
        """Replace the ``touched`` partitions with the rows of ``df``.

        A touched partition without rows is dropped.  ``df`` holds rows of touched
        partitions only.  Large partitions are split over several files and small
        ones are not shredded: the layout is left to adaptive rebalancing.
        """
        schema, (column,), kind = ALL_TABLES[table]
        folder = self._new_folder(table)
        laid_out = df.select(*schema.fieldNames()).hint("rebalance", column)
        laid_out.write.format(kind).partitionBy(column).save(folder)
        written = self.spark.read.schema(schema).format(kind).load(folder)
        # Partition values only: bounded by the number of days in the table.
        filled = {row[0] for row in written.select(column).distinct().collect()}
        change = {
            "column": column,
            "filled": {str(v): f"{folder}/{column}={v}" for v in touched if v in filled},
            "gone": [str(value) for value in touched if value not in filled],
        }
        # All files are there: from here on the change is either noted or not begun.
        files.write_text(self.spark, self._change_note(table), json.dumps(change))
        self._apply(table, change)

    def _change_note(self, table: str) -> str:
        return f"{self.root}/{table.replace('.', '/')}/change.json"

    def _apply(self, table: str, change: dict) -> None:
        """Point the partitions of a noted change to their folders; repeatable."""
        column = change["column"]
        self._point_partitions(table, [({column: v}, place) for v, place in change["filled"].items()])
        for value in change["gone"]:
            self.spark.sql(
                f"ALTER TABLE {self.name(table)} DROP IF EXISTS PARTITION ({_spec({column: value})})"
            )
        files.delete(self.spark, self._change_note(table))
        self.spark.catalog.refreshTable(self.name(table))

    def recover(self, *tables: str) -> bool:
        """Complete changes of several partitions that were interrupted; before a table is read."""
        return any([self._recover(table) for table in tables])

    def _recover(self, table: str) -> bool:
        note = files.read_text(self.spark, self._change_note(table))
        if note is None:
            return False
        self._apply(table, json.loads(note))
        return True

    def vacuum(self, table: str, keep_days: float = 7.0) -> list[str]:
        """Delete snapshot folders that the table no longer points to and that no reader
        that started within ``keep_days`` can hold; returns their names."""
        folder = f"{self.root}/{table.replace('.', '/')}"
        rows = self.spark.sql(f"DESCRIBE EXTENDED {self.name(table)}").filter("col_name = 'Location'").collect()
        used = " ".join(r["data_type"] for r in rows)
        if ALL_TABLES[table][1]:
            parts = self.spark.sql(f"SHOW PARTITIONS {self.name(table)}").collect()
            specs = [dict(p.split("=", 1) for p in r[0].split("/")) for r in parts]
            for spec in specs:
                about = self.spark.sql(f"DESCRIBE EXTENDED {self.name(table)} PARTITION ({_spec(spec)})")
                used += " " + " ".join(r["data_type"] for r in about.filter("col_name = 'Location'").collect())
        ages = files.age_days(self.spark, folder)
        gone = [n for n, age in ages.items() if n.startswith("snapshot-") and n not in used and age >= keep_days]
        for name in gone:
            files.delete(self.spark, f"{folder}/{name}")
        return sorted(gone)

    def append(self, table: str, df: DataFrame) -> None:
        df.select(*ALL_TABLES[table][0].fieldNames()).write.insertInto(self.name(table))

    def _point_partitions(self, table: str, places: list[tuple[dict, str]]) -> None:
        """Point partitions to their new folders; the new ones are added in one step."""
        name = self.name(table)
        have = {row[0] for row in self.spark.sql(f"SHOW PARTITIONS {name}").collect()}
        fresh = []
        for partition, folder in places:
            if "/".join(f"{k}={v}" for k, v in partition.items()) in have:
                self.spark.sql(f"ALTER TABLE {name} PARTITION ({_spec(partition)}) SET LOCATION '{folder}'")
            else:
                fresh.append(f"PARTITION ({_spec(partition)}) LOCATION '{folder}'")
        if fresh:
            self.spark.sql(f"ALTER TABLE {name} ADD {' '.join(fresh)}")
        self.spark.catalog.refreshTable(name)

    # -- inspection ------------------------------------------------------------

    def tables(self) -> list[tuple[str, str]]:
        """(namespace, table) of every existing layer table."""
        found = []
        for layer in LAYERS:
            space = f"{self.prefix}{layer}"
            if self.spark.catalog.databaseExists(space):
                found += [(layer, t.name) for t in self.spark.catalog.listTables(space)]
        return sorted(pair for pair in found if ".".join(pair) in TABLES)

    def columns(self) -> DataFrame:
        """(table_name, column_name, data_type, position) of every layer table."""
        rows = []
        for layer, short in self.tables():
            table = f"{layer}.{short}"
            fields = self.read(table, physical=True).schema
            rows += [(table, f.name, f.dataType.simpleString(), i) for i, f in enumerate(fields)]
        schema = "table_name string, column_name string, data_type string, position int"
        return self.spark.createDataFrame(rows, schema)

    def describe(self, table: str) -> DataFrame:
        return self.spark.sql(f"DESCRIBE {self.name(table)}")

    def preview(self, table: str, n: int = 20) -> DataFrame:
        return self.read(table).limit(n)

    def count_by_batch(self, table: str) -> DataFrame:
        return self.read(table).groupBy("_batch_id").agg(F.count("*").alias("rows"))

    def row_counts(self) -> DataFrame:
        """(table_name, rows, current_rows); the last only where versions exist."""
        parts = []
        for layer, short in self.tables():
            table = f"{layer}.{short}"
            df = self.read(table)
            current = F.count_if("is_current") if "is_current" in df.columns else F.lit(None).cast("long")
            parts.append(
                df.agg(F.count("*").alias("rows"), current.alias("current_rows")).select(
                    F.lit(table).alias("table_name"), "rows", "current_rows"
                )
            )
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result


def _spec(partition: dict) -> str:
    return ", ".join(f"`{name}` = '{value}'" for name, value in partition.items())


# Keeps microseconds; the default patterns of the text formats cut to milliseconds.
TEXT_TIMESTAMPS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def export_delimited(df: DataFrame, folder: str, separator: str = "\t") -> None:
    """Delimited text with a header.  One file per partition of ``df``; a mart is small."""
    df.write.options(sep=separator, header=True, **TEXT_TIMESTAMPS).csv(folder)


def read_delimited(
    spark: SparkSession, folder: str, schema: T.StructType, separator: str = "\t"
) -> DataFrame:
    return spark.read.schema(schema).options(sep=separator, header=True, **TEXT_TIMESTAMPS).csv(folder)


def register_view(df: DataFrame, name: str, columns: Sequence[str] = ()) -> DataFrame:
    """Publish ``df``, or some of its columns, to SQL under ``name``."""
    df = df.select(*columns) if columns else df
    df.createOrReplaceTempView(name)
    return df
