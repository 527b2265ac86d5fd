"""Point-in-time join: facts with the version of their key in force at that time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.operators.skew import add_range, range_borders, salted_join
from stratafold.operators.sizing import BROADCAST_BYTES, HOT_ROWS, SMALL_BYTES, plan_bytes, row_bytes
from stratafold.session import staged

# Above this many versions of one key, comparing each fact with all of them costs
# more than cutting the key into ranges of time.
MANY_VERSIONS = 512
VERSIONS_PER_RANGE = 128
# A version over at most this many ranges is listed in each of them.
SHORT_SPAN = 4
# A block of 2^level ranges has the number level * LEVEL + (first range >> level).
LEVEL = 1 << 40


def pit_join(
    facts: DataFrame,
    versions: DataFrame,
    key: str,
    at: str,
    valid_from: str = "valid_from",
    valid_to: str = "valid_to",
    bounds: str = "closed",
    how: str = "inner",
    many_versions: int = MANY_VERSIONS,
    hot_rows: int = HOT_ROWS,
    small_bytes: int = SMALL_BYTES,
    broadcast_bytes: int = BROADCAST_BYTES,
    totals: str | None = None,
) -> DataFrame:
    """Facts joined with every version whose validity contains ``at``.

    ``bounds="closed"`` includes both ends, so a fact at the instant of a change
    meets the old and the new version; "half_open" excludes ``valid_to``.  Facts
    older than the first version match nothing: "inner" drops them, "left" keeps
    them with NULLs.  Intervals may overlap.

    The join is an equality on the key with the interval as a residual.  Keys with
    very many versions get a time range as a second equality: each version is
    listed in the ranges it covers and each fact looks up one range, so a fact is
    compared with the versions near it and not with all of the key.  A version over
    many ranges is listed under the few aligned blocks of 1, 2, 4, ... ranges that
    make up its span instead, and facts of its key look up one block of each size in
    use: the lists grow with the logarithm of the ranges, however much versions overlap.

    With ``totals``, a column of the versions, each fact comes once with ``n``, ``least``
    and ``greatest`` of that column over its versions, and the pairs are not made (see
    ``_with_totals``).
    """
    if bounds not in ("closed", "half_open"):
        raise ValueError(f"bounds: {bounds}")
    keys = [key]
    limits = {"hot_rows": hot_rows, "small_bytes": small_bytes}
    fact_columns = facts.columns
    version_columns = [c for c in versions.columns if c != key]
    until = F.col(at) <= F.col(valid_to) if bounds == "closed" else F.col(at) < F.col(valid_to)
    inside = (F.col(at) >= F.col(valid_from)) & until

    if totals is not None:
        limits["broadcast_bytes"] = broadcast_bytes
        found = _with_totals(facts, versions, key, at, valid_from, valid_to, inside, totals, many_versions, limits)
        met = salted_join(facts, found, [key, at], how, **limits)
        return met.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    if _plain(versions, key, many_versions, broadcast_bytes):
        return salted_join(facts, versions, keys, how, inside, broadcast_bytes=None, **limits).select(
            *fact_columns, *version_columns
        )
    # Borders, lists and the join all read the versions: derived once, then read as files.
    versions = staged(versions, "versions")
    borders = range_borders(versions, key, valid_from, many_versions, VERSIONS_PER_RANGE)
    numbered = None
    if borders is not None:
        keys.append("_range")
        versions = listed(versions, borders, key, valid_from, valid_to, **limits)
        facts = add_range(facts, borders, key, {"_range": at}, **limits).drop("_hot")
        sizes = block_sizes(versions, key)
        if sizes.isEmpty():
            facts = facts.withColumn("_range", F.col("_range").cast("long"))
        else:
            if how == "left":
                # A fact that looks up several blocks and matches in none must stay once.
                facts = numbered = staged(facts.withColumn("_fact", F.monotonically_increasing_id()), "facts")
            facts = salted_join(facts, sizes, [key], "left", **limits)
            facts = facts.withColumn("_range", F.explode(_blocks_of("_range"))).drop("_levels")
    inner_first = "inner" if numbered is not None else how
    joined = salted_join(facts, versions, keys, inner_first, inside, broadcast_bytes=broadcast_bytes, **limits)
    if numbered is None:
        return joined.select(*fact_columns, *version_columns)
    joined = staged(joined.select("_fact", *fact_columns, *version_columns), "matched")
    alone = numbered.join(joined.select("_fact").distinct(), "_fact", "left_anti")
    missing = [F.lit(None).cast(joined.schema[c].dataType).alias(c) for c in version_columns]
    return joined.drop("_fact").unionByName(alone.select(*fact_columns, *missing))


def _with_totals(
    facts: DataFrame,
    versions: DataFrame,
    key: str,
    at: str,
    valid_from: str,
    valid_to: str,
    inside: Column,
    value: str,
    many_versions: int,
    limits: dict[str, int],
) -> DataFrame:
    """(key, at, n, least, greatest) of the facts' instants that meet a version.

    Versions of one interval are added up to one span, facts of one instant are one probe.
    Time is cut at quantiles of the starts and ends.  A span holds every instant of the
    ranges between its first and its last one: those are added up for each block of
    ranges, and a probe reads one row for each size of block.  Only the spans that begin
    or end in the range of a probe are compared with it.
    """
    spans = versions.dropna(subset=[key, valid_from, valid_to]).groupBy(key, valid_from, valid_to)
    spans = staged(
        spans.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest")), "spans"
    )
    probes = facts.select(key, at).dropna().distinct()
    ends = spans.select(key, F.explode(F.array(valid_from, valid_to)).alias("_end"))
    borders = range_borders(ends, key, "_end", many_versions, VERSIONS_PER_RANGE)
    sums = [F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest")]
    if borders is None:
        met = salted_join(probes, spans, [key], "inner", inside, **limits)
    else:
        probes = staged(add_range(probes, borders, key, {"_range": at}, **limits).drop("_hot"), "probes")
        spans = add_range(spans, borders, key, {"_first": valid_from, "_last": valid_to}, **limits).drop("_hot")
        spans = staged(spans.filter("_first <= _last").withColumns({c: F.col(c).cast("long") for c in ("_first", "_last")}), "spans")
        edges = spans.withColumn("_range", F.explode(F.array_distinct(F.array("_first", "_last"))))
        probes = probes.withColumn("_range", F.col("_range").cast("long"))
        met = salted_join(probes, edges.drop("_first", "_last"), [key, "_range"], "inner", inside, **limits)
        blocks = cover(F.col("_first") + 1, F.col("_last") - 1)
        whole = spans.filter("_last - _first > 1").withColumn("_range", F.explode(blocks)).groupBy(key, "_range").agg(*sums)
        whole = staged(whole, "blocks")
        probes = salted_join(probes, block_sizes(whole, key), [key], "left", **limits)
        probes = probes.withColumn("_range", F.explode(_blocks_of("_range"))).drop("_levels")
        held = salted_join(probes, whole, [key, "_range"], "inner", **limits)
        met = met.select(*held.columns).unionByName(held)
    return staged(met.groupBy(key, at).agg(*sums), "totals")


def _plain(versions: DataFrame, key: str, many_versions: int, broadcast_bytes: int) -> bool:
    """Whether all versions can be broadcast and no key has many: counted in one pass."""
    if plan_bytes(versions) > broadcast_bytes:
        return False
    per_key = versions.groupBy(key).agg(F.count("*").alias("_rows"), F.sum(row_bytes(versions)).alias("_bytes"))
    # Versions without a key match nothing and cost only their size.
    rows = F.max(F.when(F.col(key).isNotNull(), F.col("_rows")))
    largest, size = per_key.agg(rows, F.sum("_bytes")).first()
    return (largest or 0) <= many_versions and (size or 0) <= broadcast_bytes


def cover(first: Column, last: Column) -> Column:
    """Numbers of the aligned blocks that make up the ranges from ``first`` to ``last``.

    At most two blocks of each size; a short span is its single ranges.
    """

    def of_level(level: Column) -> Column:
        begin = F.call_function("shiftright", first + F.pow(F.lit(2), level).cast("long") - 1, level)
        end = F.call_function("shiftright", last + 1, level)
        left = F.when((begin < end) & (begin % 2 == 1), level * LEVEL + begin)
        right = F.when((begin < end) & (end % 2 == 1), level * LEVEL + end - 1)
        return F.array_compact(F.array(left, right))

    levels = F.sequence(F.lit(0), F.ceil(F.log2(last + 2)).cast("int"))
    return F.when(last - first < SHORT_SPAN, F.sequence(first, last)).otherwise(
        F.flatten(F.transform(levels, of_level))
    )


def listed(
    versions: DataFrame, borders: DataFrame, key: str, valid_from: str, valid_to: str, **limits: int
) -> DataFrame:
    """Each version once for every block of ranges that makes up its validity, in ``_range``."""
    spans = add_range(versions, borders, key, {"_first": valid_from, "_last": valid_to}, **limits)
    spans = spans.filter(F.col("_first") <= F.col("_last"))
    blocks = cover(F.col("_first").cast("long"), F.col("_last").cast("long"))
    return spans.withColumn("_range", F.explode(blocks)).drop("_first", "_last", "_hot")


def block_sizes(versions: DataFrame, key: str) -> DataFrame:
    """(key, _levels) of keys with blocks of several ranges: at most one row per hot key."""
    level = F.floor(F.col("_range") / LEVEL).cast("int")
    used = versions.filter(F.col("_range") >= LEVEL).groupBy(key).agg(F.collect_set(level).alias("_levels"))
    return staged(used, "levels")


def _blocks_of(range_number: str) -> Column:
    """The range itself and the blocks around it of all sizes in use."""
    number = F.col(range_number).cast("long")
    larger = F.transform(
        F.coalesce("_levels", F.array().cast("array<int>")),
        lambda level: level * LEVEL + F.call_function("shiftright", number, level),
    )
    return F.concat(F.array(number), larger)
