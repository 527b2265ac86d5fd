"""One-permutation MinHash fingerprints, in SQL functions only.  [native]

Each text's shingles (five words, or all words of a shorter text) are hashed once.
The upper bits of a hash name one of ``BINS`` bins, and a bin keeps its smallest hash:
after one sort that is the first of each run.  An empty bin borrows from the first
filled bin in its own hashed order of bins (optimal densification).
The lower ``BITS`` bits of every bin are stored, packed as hexadecimal digits.
Likeness is the share of equal bins less the share that chance makes equal.

The edited text of the check needs the next document by id.  Documents are cut into id
ranges at approximate quantiles, so the next row comes from a window within a range;
for the last of each range one joined row holds the first document of the next.  No
window spans the table.

Results by case: null text is empty; a text without words has a fingerprint of its own
and likeness 1 to another such, 0 to any other text; a null id comes last; rows with
equal ids are ordered by text; a single document is its own next; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.common import checked, staged, text_of

SHINGLE = 5
BINS = 128
BITS = 8
#: Unrolled attempts at a filled bin, before all filled bins are compared.
ATTEMPTS = 10
#: Upper bound of rows in one id range, approximately.
RANGE_ROWS = 20_000


def words(text: Column) -> Column:
    """Words in lower case (A-Z only); none for blank texts."""
    bare = F.regexp_replace(F.translate(text, _UPPER, _UPPER.lower()), r"^[ \t-\r]+|[ \t-\r]+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shingle_hashes(text: Column) -> Column:
    """Sorted 64-bit hashes of the shingles of a text.

    Each word is hashed once, and a shingle is a hash of its words' hashes.
    """
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    return F.transform(
        F.array(hashes),
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .when(F.size(h) <= SHINGLE, F.array(F.xxhash64(h)))
        .otherwise(
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), F.size(h) - SHINGLE),
                    lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]),
                )
            )
        ),
    )[0]


def _bin(h: Column) -> Column:
    """Number of the bin, growing with the signed hash."""
    return (F.shiftright(h, 64 - (BINS.bit_length() - 1)) + BINS // 2).cast("int")


def _low(h: Column) -> Column:
    return (h.bitwiseAND(F.lit((1 << BITS) - 1)) - (1 << (BITS - 1))).cast("tinyint")


def _gap(n: Column) -> Column:
    return F.array_repeat(F.lit(None).cast("tinyint"), n)


def bins(text: Column) -> Column:
    """The low bits (as signed bytes) of each bin after densification; null without words."""
    # The first of each bin's run in the sorted hashes is its smallest.
    firsts = F.transform(
        F.array(shingle_hashes(text)),
        lambda s: F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1)))),
    )
    sparse = F.transform(
        firsts,
        lambda s: F.concat(
            F.flatten(
                F.transform(
                    s,
                    lambda h, i: F.concat(
                        _gap(F.when(i == 0, _bin(h)).otherwise(_bin(h) - _bin(F.get(s, i - 1)) - 1)), F.array(_low(h))
                    ),
                )
            ),
            _gap(BINS - 1 - _bin(F.element_at(s, -1))),
        ),
    )
    dense = F.transform(
        sparse,
        lambda v: F.transform(
            v,
            lambda x, b: F.coalesce(
                x,
                *[F.get(v, F.xxhash64(b, F.lit(k)).bitwiseAND(F.lit(BINS - 1)).cast("int")) for k in range(ATTEMPTS)],
                # Hardly any bin is filled: the filled one of the smallest hash.
                F.array_min(
                    F.filter(
                        F.transform(v, lambda y, o: F.struct(F.xxhash64(b, o).alias("h"), y.alias("y"))),
                        lambda e: e["y"].isNotNull(),
                    )
                )["y"],
            ),
        ),
    )
    return F.when(text.rlike(r"[^ \t-\r]"), dense[0])


def packed(values: Column) -> Column:
    """Two hexadecimal digits for each bin; one zero for a text without words."""
    digits = F.array_join(
        F.transform(values, lambda v: F.lpad(F.lower(F.hex(v.cast("int") + (1 << (BITS - 1)))), BITS // 4, "0")), ""
    )
    return F.coalesce(digits, F.lit("0"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two bin arrays, freed of chance agreement, within 0 and 1."""
    chance = 1.0 / (1 << BITS)
    same = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"] == p["b"])) / BINS
    free = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return (
        F.when(a.isNull() & b.isNull(), F.lit(1.0))
        .when(a.isNull() | b.isNull(), F.lit(0.0))
        .otherwise(free)
        .cast("double")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, bins: the operator itself."""
    rows = checked(docs, "doc_id", "text").withColumn("text", text_of())
    return rows.withColumn("bins", bins(F.col("text")))


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text, bins, and those of the row with the next id; the last row gets the first's."""
    rows = checked(docs, "doc_id", "text").withColumn("text", text_of())
    stats = rows.agg(F.count("*").alias("n")).first()
    ranges = max(1, -(-stats["n"] // range_rows))
    # At most one bound for each range: an array of ``ranges`` numbers.
    bounds = [0]
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        bounds = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * ranges)).alias("b")).first()["b"]
        bounds = sorted(set(bounds or [0]))
    size = len(bounds)
    edges = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    # Binary search: how many bounds are below the id.
    steps = [1 << k for k in reversed(range(size.bit_length()))]
    place = F.lit(0)
    spot = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        place,
        lambda at, s: F.when((at + s <= size) & (F.get(edges, at + s - 1) <= F.col("doc_id")), at + s).otherwise(at),
    )
    rows = rows.withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(size + 1)).otherwise(spot))
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"))
    heads = staged(rows.groupBy("_range").agg(F.min(key).alias("h")), "fingerprint-heads")
    # One row for each range.
    ring = heads.withColumn("_nth", F.row_number().over(Window.orderBy("_range")))
    follow = F.coalesce(
        F.lead("h").over(Window.orderBy("_range")), F.first("h").over(Window.orderBy("_range"))
    )
    ring = ring.select("_range", follow.alias("f"), F.col("_nth")).select(
        F.col("_range").alias("_of"), F.col("f.id").alias("_id")
    )
    first_rows = (
        rows.select(F.col("doc_id").alias("_id2"), F.col("text").alias("_text"))
        .join(F.broadcast(ring), F.col("_id2").eqNullSafe(F.col("_id")))
        .groupBy("_of")
        .agg(F.min("_text").alias("_text"))
        .withColumn("_bins", bins(F.col("_text")))
    )
    order = Window.partitionBy("_range").orderBy(F.col("doc_id").asc_nulls_last(), "text")
    inside = rows.withColumn("bins", bins(F.col("text")))
    inside = inside.withColumn("_lead", F.lead(F.struct(F.col("text"), F.col("bins"))).over(order))
    joined = inside.join(first_rows, inside["_range"] == first_rows["_of"], "left")
    follower = F.coalesce(F.col("_lead"), F.struct(F.col("_text").alias("text"), F.col("_bins").alias("bins")))
    return joined.withColumn("_follower", follower).select(
        "doc_id", "text", "bins", F.col("_follower.text").alias("next_text"), F.col("_follower.bins").alias("next_bins")
    )


def edited(text: Column, follower: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many of the next text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(follower, F.lit(1), half))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are."""
    rows = with_next(docs)
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_bins", bins(F.col("edited")))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
