"""Exact deduplication with a heavy-hitter split.  [native]

Every text is normalised (white space removed) and digested once; only the digest,
the id and the length travel.  A Misra-Gries summary of the digests names every
digest above ``support`` of the rows, possibly with false ones.  An exact count
verifies them and finds their winners: at most ``1 / support`` rows, which are
broadcast, so rows of a hot group are decided where they lie.  All other digests
are rarer than ``support`` and go the ordinary way: a partially aggregated
grouping, joined back on the digest.

Results by case: null text counts as empty, and all empty texts are one group; a
null id ranks after every other id; rows that share id and text are all returned,
with ``kept`` true for one of them only if ids differ, as the decision is by id
(``keep_exact`` keeps one row of each group in any case); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import WHITE, checked, staged, text_of

#: A digest on more than this share of the rows is heavy; its inverse bounds the broadcast.
SUPPORT = 0.001


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, chars: one row per document."""
    text = text_of()
    bare = F.translate(text, WHITE, "")
    return checked(docs, "doc_id", "text").select(
        "doc_id",
        F.sha2(bare.cast("binary"), 256).alias("text_sha256"),
        F.char_length(text).cast("long").alias("chars"),
    )


def _winner():
    """The longest original text, then the smallest id; a null id loses ties."""
    rank = F.struct(
        (-F.col("chars")).alias("shortness"),
        F.col("doc_id").isNull().alias("nameless"),
        F.col("doc_id").alias("id"),
    )
    return F.min(rank)


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("text_sha256").agg(_winner().alias("w"), F.count("*").alias("group_size")).select(
        "text_sha256", F.col("w.id").alias("keep_id"), "group_size"
    )


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row, dropped ones too."""
    rows = staged(digests(docs), "digests")
    # Frequent-item counting of Spark (Misra-Gries with 1 / support counters), one row.
    suspects = rows.stat.freqItems(["text_sha256"], support).select(
        F.explode("text_sha256_freqItems").alias("text_sha256")
    )
    suspects = F.broadcast(suspects)
    heavy = staged(_groups(rows.join(suspects, "text_sha256", "left_semi")), "heavy").withColumnRenamed(
        "text_sha256", "heavy_sha256"
    )
    # One row per suspect: at most 1 / support rows of a digest and two numbers.
    marked = rows.join(
        F.broadcast(heavy), rows.text_sha256 == heavy.heavy_sha256, "left"
    )
    done = marked.filter("heavy_sha256 is not null").drop("heavy_sha256")
    rest = marked.filter("heavy_sha256 is null").select(*rows.columns)
    rest = rest.join(_groups(rest), "text_sha256")
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    return (
        done.select(*columns)
        .unionByName(rest.select(*columns))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    )


def keep_exact(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows that stay, with the columns they came with: one for each group of equal texts."""
    winners = (
        exact_dedup(docs, support)
        .filter("kept")
        .groupBy(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha256"))
        .agg((F.count("*") > 1).alias("_repeated"))
    )
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    bare = F.translate(text_of(), WHITE, "")
    # The columns of the documents travel in a struct, so that their names cannot clash.
    held = docs.select(columns.alias("row"), "doc_id", F.sha2(bare.cast("binary"), 256).alias("own_sha256"))
    same = held["doc_id"].eqNullSafe(winners["_keep"]) & (held["own_sha256"] == winners["_sha256"])
    held = staged(held.join(winners, same).drop("doc_id", "own_sha256"), "kept-rows")
    # Of rows that share id and digest the longest text, then the first by content.
    text = F.coalesce(F.col("row.text"), F.lit(""))
    rank = F.struct(-F.char_length(text), text, F.to_json("row"))
    one = held.filter("_repeated").groupBy("_keep", "_sha256").agg(F.min_by("row", rank).alias("row"))
    return held.filter("not _repeated").select("row").unionByName(one.select("row")).select("row.*")
