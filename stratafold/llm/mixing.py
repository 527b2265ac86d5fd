"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets come from weights by water-filling.  A seeded hash of its id places every
document on its source's ring of 256 blocks; a pass over a source draws all of its
blocks, the last pass only those up to the point where the target is met.  That point is
found digit by digit of the hash, with one small aggregation for each digit, so no
source is ever sorted or windowed as a whole.

The number of block draws of every source is the quota vector at the root of a binary
tree over output shards.  Each node gives its left half a multivariate-hypergeometric
share of its quotas and the rest to the right, so the leaves hold exact quotas with the
random spread of a full shuffle.  A shard then takes the next run of each source's
permuted blocks: the runs are disjoint, and each is shuffled within its shard by a hash.
The mix is laid out so: every shard in partitions of its own, in the order of that hash.

Only numbers by source reach the driver, at most ``MAX_SOURCES`` of them (more raise an
error).  Everything is seeded and depends on values alone: reruns agree.

Results by case: null text has size 0; a null source is a source of its own, the last;
a source of size 0 has target 0; repeated rows are documents of their own on the same
place of the ring; at the point where the target is met the documents that share 56 bits of
hash of id and text take equal shares, rounded down, so a source misses its target by less
than a word for each of them.  With ``whole`` they are taken or left as they are, whichever
comes nearer, so a source misses by at most half their words and no text is cut.  An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.common import checked, staged, text_of

WEIGHTS = (5.0, 2.0, 1.0)
MAX_SOURCES = 100_000
LEVELS = 7  # digits of 8 bits: four of the id's hash, three that part the rows of one id
BLOCKS = 256
OUTPUT = ("doc_id", "size", "source_size", "target", "taken", "copies")


def words_in(column) -> F.Column:
    """Runs of characters that are not white space."""
    return F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: np.ndarray, weights: tuple[float, ...], share: float, cap: float) -> np.ndarray:
    """Shares by weight of ``share`` times all sizes, none above ``cap`` times its own size."""
    weight = np.array([weights[i % len(weights)] for i in range(len(sizes))])
    limit = cap * sizes.astype(float)
    total = min(share * float(sizes.sum()), float(limit.sum()))
    out, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while free.any():
        level = (total - out[~free].sum()) / weight[free].sum()
        out[free] = weight[free] * level
        above = free & (out > limit)
        if not above.any():
            break
        out[above] = limit[above]
        free &= ~above
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources: exact quotas of every leaf of the splitting tree."""
    leaves = np.zeros((shards, len(quotas)), np.int64)

    def node(first: int, last: int, left: np.ndarray) -> None:
        if last - first == 1:
            leaves[first] = left
            return
        middle = (first + last) // 2
        rng = np.random.default_rng([seed, first, last])
        draw = int(left.sum()) * (middle - first) // (last - first)
        mine = rng.multivariate_hypergeometric(left, draw, method="marginals") if len(left) else left
        node(first, middle, mine)
        node(middle, last, left - mine)

    node(0, shards, quotas.astype(np.int64))
    return leaves


def _placed(docs: DataFrame, seed: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, _source, _turn, _size, and ``row`` with the carried columns.

    _source sorts like the source by code point, null last; _turn is the place on the ring.
    """
    checked(docs, "doc_id", "text", "source", *carry)
    return docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("_source"),
        F.shiftleft(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 32), 24)
        .bitwiseOR(F.shiftrightunsigned(F.xxhash64("doc_id", text_of(), F.lit(seed)), 40))
        .alias("_turn"),
        words_in(text_of()).alias("_size"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []),
    )


def _block() -> F.Column:
    return F.shiftright("_turn", 8 * (LEVELS - 1))


def _last_pass(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds where the last pass stops: the hash prefix _stop, and the words left and there for it."""
    found = sources.select("_source", F.lit(0).cast("long").alias("_stop"), F.col("rest").alias("_left"))
    for level in range(1, LEVELS + 1):
        shift = 8 * (LEVELS - level)
        prefix = F.shiftright("_turn", shift)
        sums = (
            sized.join(found, "_source")
            .filter(F.shiftright(prefix, 8) == F.col("_stop"))
            .groupBy("_source", "_left", prefix.alias("_next"))
            .agg(F.sum("_size").alias("_here"))
        )
        # At most 256 rows for each source.
        run = F.sum("_here").over(Window.partitionBy("_source").orderBy("_next"))
        stop = F.min(F.when(F.col("_run") > F.col("_left"), F.struct("_next", "_run", "_here")))
        found = staged(
            sums.withColumn("_run", run)
            .groupBy("_source", "_left")
            .agg(stop.alias("s"))
            .select(
                "_source",
                F.col("s._next").alias("_stop"),
                (F.col("_left") - F.col("s._run") + F.col("s._here")).alias("_left"),
                F.col("s._here").alias("_here"),
            ),
            f"mix-{level}",
        )
    return sources.join(found, "_source", "left")


def _block_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For every pass and block of a source its shard: permuted blocks dealt by quota."""
    for batch in batches:
        out = []
        for name, passes, last, quota in zip(
            batch["_source"], batch["passes"], batch["last_blocks"], batch["quota"], strict=True
        ):
            rng = np.random.default_rng(list(name.encode()))
            order = [rng.permutation(BLOCKS) for _ in range(int(passes))] + [rng.permutation(int(last))]
            shard = np.repeat(np.arange(len(quota)), np.asarray(quota, np.int64))
            table, at = np.full((int(passes) + 1, BLOCKS), -1, np.int64), 0
            for k, blocks in enumerate(order):
                table[k, blocks] = shard[at : at + len(blocks)]
                at += len(blocks)
            out.append(table.tolist())
        yield pd.DataFrame({"_source": batch["_source"], "shards": out})


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    shards: int = 64,
    seed: int = 17,
    carry: tuple[str, ...] = (),
    whole: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target, taken and ``copies`` for every row.

    ``copies`` lists what the mix draws of the document: words, shard, and the key that
    orders its shard.  ``carry`` names columns to keep, none of them called like those.
    ``whole`` draws whole documents only.
    """
    carry = tuple(dict.fromkeys(c for c in carry if c != "doc_id"))
    if set(OUTPUT) & {c.lower() for c in carry}:
        raise ValueError(f"columns called like those of the mix: {OUTPUT}")
    drawn = _drawn(docs, weights, share, cap, shards, seed, carry, whole)
    return drawn.select(*OUTPUT, *[F.col("row").getField(c).alias(c) for c in carry])


def _drawn(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    shards: int = 64,
    seed: int = 17,
    carry: tuple[str, ...] = (),
    whole: bool = False,
) -> DataFrame:
    """The columns of ``mix`` and a struct ``row`` of the carried ones, whatever their names."""
    spark = docs.sparkSession
    docs = _placed(docs, seed, carry)
    sized = staged(docs.select("_source", "_turn", "_size"), "mix-sizes")
    totals = sized.groupBy("_source").agg(F.sum("_size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: r["_source"].encode())
    sizes = np.array([r["size"] for r in totals], np.int64)
    target = targets(sizes, weights, share, cap)
    want = np.rint(target).astype(np.int64)
    passes = want // np.maximum(sizes, 1)
    rest = want - passes * sizes
    columns = "_source string, source_size long, target double, passes long, rest long"
    rows = [
        (r["_source"], int(s), float(t), int(p), int(q))
        for r, s, t, p, q in zip(totals, sizes, target, passes, rest, strict=True)
    ]
    plan = staged(_last_pass(sized, spark.createDataFrame(rows, columns)), "mix-plan")
    stops = {r["_source"]: r for r in plan.select("_source", "_stop", "rest").collect()}
    last = np.array(
        [(stops[r["_source"]]["_stop"] >> 8 * (LEVELS - 1)) + 1 if rest[i] else 0 for i, r in enumerate(totals)],
        np.int64,
    )
    leaves = split_quotas(passes * BLOCKS + last, shards, seed)
    quotas = [
        (r["_source"], int(passes[i]), int(last[i]), leaves[:, i].tolist()) for i, r in enumerate(totals)
    ]
    dealt = spark.createDataFrame(
        quotas, "_source string, passes long, last_blocks long, quota array<long>"
    ).mapInPandas(_block_shards, "_source string, shards array<array<long>>")
    plan = staged(plan.join(dealt, "_source"), "mix-dealt")
    place = F.col("_turn")
    if whole:
        partial = F.when(2 * F.col("_left") > F.col("_here"), F.col("_size")).otherwise(F.lit(0))
    else:
        partial = F.floor(F.col("_left") * F.col("_size") / F.greatest(F.col("_here"), F.lit(1)))
    extra = (
        F.when(F.col("rest") == 0, F.lit(0))
        .when(place < F.col("_stop"), F.col("_size"))
        .when(place == F.col("_stop"), partial)
        .otherwise(F.lit(0))
        .cast("long")
    )
    block = (_block() + 1).cast("int")
    copy = lambda k: F.struct(
        F.when(k < F.col("passes"), F.col("_size")).otherwise(F.col("extra")).alias("words"),
        F.element_at(F.element_at("shards", (k + 1).cast("int")), block).alias("shard"),
        F.xxhash64("doc_id", k, F.lit(seed + 1)).alias("turn"),
    )
    draws = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), copy), lambda c: c["words"] > 0)
    # Not broadcast by force: Spark decides by the size of the staged plan.
    joined = docs.join(plan, "_source").withColumn("extra", extra).withColumn("copies", draws)
    return joined.select(
        "doc_id",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("passes") * F.col("_size") + F.col("extra")).alias("taken"),
        "copies",
        *(["row"] if carry else []),
    )


def _laid(docs: DataFrame, shards: int = 64, **options) -> DataFrame:
    """shard, turn and ``row``, the columns of ``docs`` in a struct: one row for each copy, shard by shard."""
    columns = docs.columns
    drawn = _drawn(docs, carry=tuple(columns), shards=shards, **options).select("size", F.explode("copies").alias("copy"), "row")
    own = F.col("row.text")
    first = F.array_join(
        F.slice(
            F.regexp_extract_all(F.coalesce(own, F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1),
            1,
            F.col("copy.words").cast("int"),
        ),
        " ",
    )
    changed = {"text": F.when(F.col("copy.words") >= F.col("size"), own).otherwise(first)}
    if "n_chars" in columns:
        changed["n_chars"] = F.char_length(changed["text"]).cast("long")
    row = F.struct(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in columns])
    drawn = drawn.select(F.col("copy.shard").alias("shard"), F.col("copy.turn").alias("turn"), row.alias("row"))
    slices = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    # The upper 31 bits, from 0: the lowest range of turn is the first slice.
    part = (F.shiftright("turn", 33) + F.lit(1 << 30)) * F.lit(slices)
    place = F.col("shard") * F.lit(slices) + F.shiftright(part, 31)
    return drawn.repartitionById(shards * slices, place.cast("int")).sortWithinPartitions("shard", "turn")


def dealt(docs: DataFrame, shards: int = 64, **options) -> DataFrame:
    """The columns of ``docs``, _shard and _order: one row for each copy, shard by shard.

    A shard fills one partition or, with more shuffle partitions than shards, several in a
    row, each a range of _order and sorted by it.  Columns of ``docs`` with these two names
    are an error; ``mixed`` takes them.
    """
    if {"_shard", "_order"} & set(docs.columns):
        raise ValueError("columns _shard and _order are given by dealt")
    return _laid(docs, shards, **options).select("row.*", F.col("shard").alias("_shard"), F.col("turn").alias("_order"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: one row for each copy, with the columns of ``docs``, as ``dealt`` lays it out.

    Without ``whole``, the one document at which a source meets its target keeps its first
    words only.
    """
    return _laid(docs, **options).select("row.*")
