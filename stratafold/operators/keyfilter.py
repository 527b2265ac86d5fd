"""A Bloom filter of a batch's keys, tested in the scan of a table before anything is shuffled.

The filter is a relation of at most ``MOST_WORDS`` rows: 64 bits each, four of them set for
every key of the word.  It is made by one partial aggregation, broadcast, and joined by the
number of the word, so that rows of other keys (all but a few in a hundred) end in the task
that reads them.  It never loses a key; what it lets through by chance is for an exact join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 16 bytes a row, and as much again in the hash table: well below what is broadcast.
MOST_WORDS = 1 << 20
KEYS_PER_WORD = 6


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def _mask(keys: Sequence[str]) -> Column:
    """Four bits from parts of the hash that the word's number does not use."""
    mask = F.lit(0).cast("long")
    for part in (40, 46, 52, 58):
        bit = F.shiftrightunsigned(_hash(keys), part).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def key_filter(rows: DataFrame, keys: Sequence[str], most_words: int = MOST_WORDS) -> DataFrame:
    """(_word, _bits, _words) of all keys of ``rows`` without a NULL; read twice, so stage it before."""
    whole = rows.select(*keys).dropna()
    words, needed = 1, -(-whole.count() // KEYS_PER_WORD)
    while words < min(needed, most_words):
        words *= 2
    word = F.pmod(_hash(keys), F.lit(words).cast("long"))
    bits = whole.select(word.alias("_word"), _mask(keys).alias("_mask"))
    return bits.groupBy("_word").agg(F.bit_or("_mask").alias("_bits")).withColumn("_words", F.lit(words).cast("long"))


def maybe_held(rows: DataFrame, keys: Sequence[str], filter_: DataFrame) -> DataFrame:
    """The rows whose keys may be in the filter: all that are, and few others.

    The keys must have the types they had in the filter, as equal values of different
    types have different hashes.
    """
    found = filter_.first()
    if found is None:
        return rows.limit(0)
    word = F.pmod(_hash(keys), F.lit(found["_words"]).cast("long"))
    wanted = _mask(keys)
    held = F.broadcast(filter_.select("_word", "_bits"))
    return rows.join(held, (word == F.col("_word")) & (F.col("_bits").bitwiseAND(wanted) == wanted), "left_semi")
