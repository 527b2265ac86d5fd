"""Near-duplicate groups from bottom-k sketches of one hash function.

A document is the set of its five-word shingles.  Documents with equal sets are one
class from the start.  A class keeps the ``K`` smallest shingle hashes, and inverted
lists of the kept values say which classes meet.  Two sets of Jaccard 0.75 share
binomially many of 64 values, fewer than ``SHARED`` of them about once in 10^9, so it is
enough to list a class under its K - SHARED + 1 rarest values (a prefix in an order by
frequency): what a passage or line makes common is hardly ever listed.

Lists are not turned into all their pairs.  Every member meets its list's hub, the
class whose values are the most common, and the full sets of both are compared.  What
the hub does not settle is found by prefixes inside the hub's group.  All members put
their shingles in one order: first those that only members of one component hold, or only
members linked with the hub, then the others that the hub lacks, the rarer in the group
first, at last those of the hub.  Two sets of n and m shingles and Jaccard 0.75 share
3 / 7 (n + m); so their first common shingle in this order is among the first
n - 0.75 n + 1 of both, and at both places so much must still follow.  Members are listed
under these shingles only, and only pairs that pass that bound are made.  A member whose
own shingles fill its prefix meets nobody, however large its family is.  Sets that hold
the hub nearly whole reach the hub's shingles, where texts much shorter than the hub meet.
Members also bring the parities of their shingles over ``WORDS`` * 64 places.  Each shingle
that one set alone holds turns one place, so more than (n + m) / 7 places that differ rule
a pair out for certain, before it is made: relatives below the threshold make few pairs.

Pairs within one component or both linked with the hub are left out.  Each pair is
estimated from the sketch of the union of both sketches, and survivors are confirmed on
the full sets of both texts.  Components come from joins; nothing but counts reaches the
driver.

Results by case: null text is empty; a text without words has an empty set, links with
nothing and is kept; with one to four words the whole sequence is the one shingle; in
``near_groups`` rows that share an id are one node, linked by the links of either, and a
null id is a node after all others and stays null; in ``keep_one`` rows are one node only
if they share id and text, and stay or go together; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.anchors import mix
from stratafold.llm.common import checked, staged, text_of
from stratafold.llm.components import components
from stratafold.llm.words import shingle_set

K = 64
SHARED = 28
#: Six standard errors below the threshold of 0.75: what the estimate may let go.
ESTIMATE = 0.42
#: Of 64 parities each.
WORDS = 16
#: Bytes of text whose sets a task holds at a time.
SLICE = 1_000_000
_NULL = (1 << 63) - 1


def _prefix(n: int) -> int:
    """How many of the first shingles of a set of n must hold one in common with any near copy."""
    return n - (3 * n + 3) // 4 + 1


def _slices(batches: Iterator[pa.RecordBatch], *texts: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``SLICE`` bytes of text, or one row.

    What a task makes of a run leaves before the next: sets, hashes and rows never pile up for a whole batch,
    whose texts stay where Arrow put them.
    """
    for batch in batches:
        after = np.cumsum(sum(pc.binary_length(batch[t]).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts))
        at = 0
        while at < batch.num_rows:
            limit = SLICE + (after[at - 1] if at else 0)
            stop = max(at + 1, int(np.searchsorted(after, limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def _numbers(arrays: list[np.ndarray]) -> pa.ListArray:
    """A list of longs for each array of 64-bit numbers."""
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate([np.zeros(0, np.int64), *(x.view(np.int64) for x in arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _slices(batches, "text"):
        sizes, sums, xors, kept = [], [], [], []
        for text in rows["text"].to_pylist():
            found = shingle_set(text)
            other = mix(found ^ np.uint64(0x5851F42D4C957F2D))
            sizes.append(len(found))
            sums.append(int(other.sum(dtype=np.uint64).astype(np.int64)))
            xors.append(int(np.bitwise_xor.reduce(other).astype(np.int64)) if len(other) else 0)
            # Signed numbers in the order of the unsigned hashes.
            kept.append(found[:K] ^ np.uint64(1 << 63))
        longs = [pa.array(x, pa.int64()) for x in (sizes, sums, xors)]
        yield pa.RecordBatch.from_arrays([rows["node"], *longs, _numbers(kept)], ["node", "n", "d1", "d2", "sketch"])


def sketches(texts: DataFrame) -> DataFrame:
    """node, n, d1, d2 (digest of the set), sketch: one row for each row of node, text."""
    kind = texts.schema["node"].dataType.simpleString()
    return texts.mapInArrow(_sketches, f"node {kind}, n long, d1 long, d2 long, sketch array<long>")


def _lists(classes: DataFrame) -> DataFrame:
    """value, cls, n, common: each class under its rarest values that another class keeps too.

    ``common`` is how often its values are kept, on average.
    """
    kept = classes.select("cls", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    often = kept.groupBy("value").agg(F.count("*").alias("times")).filter("times > 1")
    common = kept.join(often, "value")
    # At most K rows for each class.
    mine = Window.partitionBy("cls")
    rarest = F.row_number().over(mine.orderBy("times", "value"))
    alone = F.col("k") - F.count("*").over(mine)
    needed = F.greatest(F.lit(1), F.floor(F.col("k") * SHARED / K))
    return (
        common.withColumns({"_nth": rarest, "_alone": alone, "common": F.sum("times").over(mine) / F.col("k")})
        .filter(F.col("_alone") + F.col("_nth") <= F.col("k") - needed + 1)
        .select("value", "cls", "n", "common")
    )


def _close(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= 75 * F.greatest(a, b)


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose union sketch leaves the threshold possible."""
    left = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").filter("na > 0").join(right, "b").filter(_close(F.col("na"), F.col("nb")))
    # The K smallest of the union, in one signed order throughout.
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, K)
    both = both.withColumn("u", union)
    same = F.size(F.array_intersect(F.array_intersect("sa", "sb"), "u"))
    return both.filter(same >= ESTIMATE * F.size("u")).select("a", "b")


def _sets_of(batches: Iterator[pa.RecordBatch], left: str, right: str) -> Iterator[tuple]:
    """Runs of rows with the full sets of both texts; the right one is made once for a run of its rows."""
    name, found = None, None
    for rows in _slices(batches, "tx", "ty"):
        both = []
        for k, (key, x) in enumerate(zip(rows[right].to_pylist(), rows["tx"].to_pylist(), strict=True)):
            if name is None or key != name:
                name, found = key, shingle_set(rows["ty"][k].as_py())
            both.append((shingle_set(x), found))
        yield rows.select([left, right]), both


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for pairs, both in _sets_of(batches, "a", "b"):
        keep = []
        for x, y in both:
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * shared >= 75 * (len(x) + len(y) - shared) and shared > 0)
        yield pairs.filter(pa.array(keep, pa.bool_()))


def _parities(shingles: np.ndarray) -> np.ndarray:
    """One bit for each place: whether an odd number of shingles falls there."""
    places = (shingles % np.uint64(64 * WORDS)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=64 * WORDS) & 1).astype(np.uint8)).view(np.int64)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for pairs, both in _sets_of(batches, "a", "h"):
        n, nh, shared, extra, held = [], [], [], [], []
        for x, y in both:
            extra.append(np.setdiff1d(x, y, assume_unique=True))
            n.append(len(x))
            nh.append(len(y))
            shared.append(len(x) - len(extra[-1]))
            room = _prefix(len(x)) - len(extra[-1])
            held.append(np.intersect1d(x, y, assume_unique=True)[:room] if room > 0 else x[:0])
        longs = [pa.array(v, pa.int64()) for v in (n, nh, shared)]
        lists = [_numbers(v) for v in (extra, held, [_parities(x) for x, _ in both])]
        yield pa.RecordBatch.from_arrays(
            [*pairs.columns, *longs, *lists], ["a", "h", "n", "nh", "shared", "extra", "held", "odd"]
        )


def _with_texts(pairs: DataFrame, texts: DataFrame, left: str, right: str) -> DataFrame:
    x = texts.select(F.col("node").alias(left), F.col("text").alias("tx"))
    y = texts.select(F.col("node").alias(right), F.col("text").alias("ty"))
    return pairs.join(x, left).join(y, right).select(left, right, "tx", "ty")


def _open_pairs(stars: DataFrame, found: DataFrame) -> DataFrame:
    """a, b: what the hubs have not settled (see above)."""
    placed = stars.join(found, stars.a == found.node, "left").withColumn("component", F.coalesce("component", "a"))
    mixed = placed.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    placed = staged(placed.drop("node").join(mixed.filter("lo <> hi").select("h"), "h"), "placed")
    member = ["h", "a", "n", "linked", "component", "odd"]
    extra, held = F.size("extra"), F.size("held")
    beyond = placed.select(*member, extra.alias("first"), F.lit(0).alias("at"), F.explode("extra").alias("v")).unionByName(
        # Behind all extra shingles, in the order of their hashes.
        placed.filter(held > 0).select(*member, extra.alias("first"), F.posexplode("held").alias("at", "v")).withColumn("at", F.col("at") + 1)
    )
    lists = beyond.groupBy("h", "v").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("linked").alias("all_linked"), F.count("*").alias("times")
    )
    open_lists = lists.filter("lo <> hi and not all_linked").select("h", "v", "times")
    beyond = beyond.join(open_lists, ["h", "v"])
    # At most a set's shingles for each member.
    own = Window.partitionBy("h", "a", F.col("at") > 0)
    place = F.when(F.col("at") > 0, F.col("first") + F.col("at") - 1).otherwise(
        F.col("first") - F.count("*").over(own) + F.row_number().over(own.orderBy("times", "v")) - 1
    )
    beyond = beyond.withColumn("place", place).filter("place < n - floor((3 * n + 3) / 4) + 1")
    x, y = beyond.alias("x"), beyond.alias("y")
    differ = " + ".join(f"bit_count(x.odd[{k}] ^ y.odd[{k}])" for k in range(WORDS))
    pairs = x.join(
        y,
        F.expr(
            f"""x.h = y.h and x.v = y.v and x.a > y.a and not (x.linked and y.linked) and x.component <> y.component
               and 7 * least(x.n - x.place, y.n - y.place) >= 3 * (x.n + y.n)
               and 7 * ({differ}) <= x.n + y.n"""
        ),
    )
    return pairs.select(F.col("x.a").alias("a"), F.col("y.a").alias("b")).distinct()


def _groups(texts: DataFrame) -> DataFrame:
    """node, n, component (the smallest node) for every row of node, text."""
    kind = texts.schema["node"].dataType.simpleString()
    rows = staged(sketches(texts), "sketches")
    key = ["n", "d1", "d2"]
    classes = staged(
        rows.filter("n > 0").groupBy(*key).agg(F.min("node").alias("cls"), F.first("sketch").alias("sketch")), "classes"
    )
    alike = rows.filter("n > 0").select("node", *key).join(classes.select(*key, "cls"), key)
    edges = staged(alike.filter("node <> cls").select(F.col("node").alias("a"), F.col("cls").alias("b")), "edges")

    lists = staged(_lists(classes), "lists")
    hubs = lists.groupBy("value").agg(F.max(F.struct("common", "cls")).alias("best"))
    hubs = hubs.select("value", F.col("best.cls").alias("h"))
    met = lists.join(hubs, "value").filter("cls <> h").select(F.col("cls").alias("a"), "h").distinct()
    stars = _with_texts(staged(met, "met"), texts, "a", "h").mapInArrow(
        _meet, f"a {kind}, h {kind}, n long, nh long, shared long, extra array<long>, held array<long>, odd array<long>"
    )
    stars = staged(stars.withColumn("linked", F.expr("100 * shared >= 75 * (n + nh - shared)")), "stars")
    edges = staged(edges.unionByName(stars.filter("linked").select("a", F.col("h").alias("b"))), "edges")

    found = staged(components(edges), "found")
    more = staged(_estimated(_open_pairs(stars, found), classes), "pairs")
    edges = edges.unionByName(_with_texts(more, texts, "a", "b").mapInArrow(_confirm, f"a {kind}, b {kind}"))
    found = staged(components(edges), "found")
    return rows.select("node", "n").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _texts(docs: DataFrame, node: Column) -> DataFrame:
    return checked(docs, "doc_id", "text").select(node.alias("node"), text_of().cast("binary").alias("text"))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    node, smallest = F.col("node"), F.col("component")
    return _groups(_texts(docs, F.coalesce(F.col("doc_id"), F.lit(_NULL)))).select(
        F.when(node != _NULL, node).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(smallest != _NULL, smallest).alias("component_id"),
        (node == smallest).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns they came with: of each group the one with the smallest id.

    Where ids are null or repeat, a row goes by its id and text, so that no row is dropped for another of its id.
    """
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("doc_id is null or rows > 1")
    if shared.isEmpty():
        node = docs["doc_id"]
    else:
        # In the order of ids, null after all.
        number = F.lpad(F.hex(docs["doc_id"].bitwiseXOR(F.lit(-1 << 63))), 16, "0")
        node = F.concat(F.coalesce(number, F.lit("null")), F.lit(" "), F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    gone = _groups(_texts(docs, node)).filter("node <> component").select(F.col("node").alias("_gone")).distinct()
    return docs.join(gone, node == gone["_gone"], "left_anti")
