"""Collocations: frequent phrases of two to four words, scored by their weakest cut.

Texts are read in blocks.  Numpy prefix polynomials over the bytes give a fingerprint for
every word, and prefix polynomials over those one for every n-gram, whatever its length.

1. Level by level, tasks add up fingerprints and the shuffle adds up the tasks' sums.  An
   n-gram can only be frequent if its first and its last n - 1 words are, so a level sends
   just the n-grams for which the level below leaves that possible.  It is told by a bit
   map of fixed size (``BITS``), made from the frequent fingerprints; a bit set by chance
   costs shuffled rows and changes nothing.  Fingerprints that collide only add up, so
   here they are cut to ``SPARE`` bits more than it takes to number all bytes of the texts.
2. One more pass keeps, for every fingerprint that may be frequent, a pointer to an
   occurrence, and compares all other occurrences with it word by word; what differs
   becomes an entry of its own.  Phrases are written out where a table of pointers is
   full, once for each entry, and the shuffle adds them up by text.  All counts are of texts.
   This pass has one task for each core, whatever the number of files.
3. Cuts, contained phrases and ranks are joins and groupings of the frequent phrases.

Blocks of a long text overlap by three words, so no occurrence is lost or counted twice.
A task holds one block of about ``BLOCK`` bytes (or the longest word) and one table of at
most ``ENTRIES`` pointers.  Sums are combined in the tasks, so a word of any frequency
sends one row from each table.

Results by case: null text is empty, null language is ``und`` (and joins texts that say
so); repeated rows count each time; equal scores and counts rank by phrase in byte order;
ids and other columns are ignored; an empty table gives an empty result, as does a
language without a phrase that is frequent enough.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.anchors import mix
from stratafold.llm.common import checked, staged, text_of

BLOCK = 1 << 20
ENTRIES = 800_000
#: Phrases that are written out at a time.
SLICE = 50_000
#: Of the bit map of frequent fingerprints, a power of two.
BITS = 1 << 26
SPARE = 4
LONGEST = 4

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_KIND = np.zeros(256, np.uint8)  # 0 belongs to a word, 1 parts words, 2 parts pieces
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_PARTS = re.compile(rb"[ \t.,;:!?\n-\r]")
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** k and base ** -k modulo 2 ** 64 for k < n; grown as needed and kept."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(max(n, 2 * BLOCK), b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _POWERS[base] = both[0], both[1]
    return _POWERS[base]


class _Polynomial:
    """Prefix sums of values times powers: the fingerprint of any stretch by one subtraction."""

    def __init__(self, values: np.ndarray, base: int):
        powers, self.back = _powers(base, len(values) + 1)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[: len(values)], out=self.total[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[begin]) * self.back[begin]


class Block:
    """Words of a stretch of texts of one language; the first ``known`` belong to the block before."""

    def __init__(self, data: bytes, lang: str, known: int = 0, mask: int | None = None):
        self.data, self.known = data.translate(_LOWER), known
        letters = np.frombuffer(self.data, np.uint8)
        kind = _KIND[letters]
        inside = np.concatenate([[False], kind == 0, [False]])
        self.begin = np.flatnonzero(inside[1:] & ~inside[:-1])
        self.end = np.flatnonzero(inside[:-1] & ~inside[1:])
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[self.begin] if len(letters) else self.begin
        words = _Polynomial(letters.astype(np.uint64) + np.uint64(1), 0x100000001B3).of(self.begin, self.end)
        self.grams = _Polynomial(mix(words), 0x9E3779B97F4A7C15)
        self.salt = np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0]
        self.mask = mask

    def places(self, n: int) -> np.ndarray:
        """Where n-grams begin that lie in one piece and end behind the known words."""
        first = max(0, self.known - n + 1)
        at = np.arange(first, max(first, len(self.begin) - n + 1))
        return at[self.piece[at] == self.piece[at + n - 1]]

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        found = mix((self.grams.of(at, at + n) + np.uint64(n)) ^ self.salt)
        return found if self.mask is None else found & np.uint64(self.mask)

    def word(self, k: int) -> bytes:
        return self.data[self.begin[k] : self.end[k]]


def _blocks(batches: Iterator[pd.DataFrame], mask: int | None) -> Iterator[tuple[str, Block]]:
    """Blocks of whole short texts and of parts of long ones, each of one language."""
    waiting: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            text = bytes(text)
            if len(text) > BLOCK:
                yield from ((lang, block) for block in _parts(text, lang, mask))
                continue
            waiting.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text) + 1
            if size[lang] > BLOCK:
                yield lang, Block(b"\n".join(waiting.pop(lang)), lang, 0, mask)
                del size[lang]
            elif sum(size.values()) > 8 * BLOCK:
                for other in list(waiting):
                    yield other, Block(b"\n".join(waiting.pop(other)), other, 0, mask)
                size.clear()
    for lang in list(waiting):
        yield lang, Block(b"\n".join(waiting.pop(lang)), lang, 0, mask)


def _parts(text: bytes, lang: str, mask: int | None) -> Iterator[Block]:
    first, cut, known = 0, 0, 0
    while cut < len(text):
        found = _PARTS.search(text, cut + BLOCK)
        cut = found.end() if found else len(text)
        block = Block(text[first:cut], lang, known, mask)
        yield block
        known = min(LONGEST - 1, len(block.begin))
        if known:
            first += int(block.begin[-known])
        else:
            first = cut


def _set(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether the bit of each fingerprint is set."""
    word = (prints % np.uint64(len(bits) * 64)).astype(np.int64)
    return (bits[word >> 6] >> (word & 63).astype(np.uint64)) & np.uint64(1) != 0


def _possible(block: Block, n: int, below: np.ndarray | None) -> np.ndarray:
    at = block.places(n)
    if below is None or not len(at):
        return at
    at = at[_set(below, block.prints(at, n - 1))]
    return at[_set(below, block.prints(at + 1, n - 1))]


def _count_level(
    batches: Iterator[pd.DataFrame], n: int, below: Broadcast | None, narrow: int, mask: int | None
) -> Iterator[pd.DataFrame]:
    bits, held, total = below.value if below else None, [], 0

    def summed() -> pd.DataFrame:
        prints, times = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"print": prints.view(np.int64), "times": times})

    for _, block in _blocks(batches, mask):
        held.append(block.prints(_possible(block, n, bits), n) & np.uint64(narrow))
        total += len(held[-1])
        if total > 2 * ENTRIES:
            yield summed()
            held, total = [], 0
    if total:
        yield summed()


def _bit_map(frequent: DataFrame, bits: int) -> np.ndarray:
    """The bits of all fingerprints: at most bits / 64 rows come to the driver."""
    words = (
        frequent.select((F.col("print") % bits).alias("bit"))
        .groupBy(F.shiftright("bit", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("set"))
        .toPandas()
    )
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["set"].to_numpy(np.int64).view(np.uint64)
    return out


def _combined(prints: np.ndarray, ids: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of equal words added up: found by fingerprint, compared word by word with the first."""
    order = np.argsort(prints, kind="stable")
    prints, ids, times = prints[order], ids[order], times[order]
    new = np.concatenate([[True], prints[1:] != prints[:-1]])
    pointer = np.flatnonzero(new)[np.cumsum(new) - 1]
    if (ids != ids[pointer]).any():
        # Different words under one fingerprint: order and part by the words too.
        order = np.lexsort([*ids.T, prints])
        prints, ids, times = prints[order], ids[order], times[order]
        new = np.concatenate([[True], (prints[1:] != prints[:-1]) | (ids[1:] != ids[:-1]).any(axis=1)])
    first = np.flatnonzero(new)
    return prints[first], ids[first], np.add.reduceat(times, first)


class _Table:
    """Pointers and sums of a task for one language; pointers are numbers of words seen."""

    def __init__(self, lang: str):
        self.lang, self.number, self.words, self.n_words = lang, {}, [], 0
        self.entries, self.merged, self.pending = [], 0, 0

    def _numbers(self, block: Block, at: np.ndarray) -> np.ndarray:
        """The number of the word at each place, by text: places of one fingerprint are compared byte by byte."""
        _, first, group = np.unique(block.prints(at, 1), return_index=True, return_inverse=True)
        same = at[first][group]
        length = block.end[at] - block.begin[at]
        alike = length == block.end[same] - block.begin[same]
        if alike.all():
            letters = np.frombuffer(block.data, np.uint8)
            step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            alike = (letters[np.repeat(block.begin[at], length) + step] == letters[np.repeat(block.begin[same], length) + step]).all()
        else:
            alike = False
        if not alike:
            first, group = np.arange(len(at)), np.arange(len(at))
        numbers = np.empty(len(first), np.int32)
        for k, place in enumerate(at[first].tolist()):
            word = block.word(place)
            known = self.number.get(word)
            if known is None:
                known = self.number[word] = len(self.words)
                self.words.append(word)
            numbers[k] = known
        return numbers[group]

    def add(self, block: Block, maps: list[np.ndarray]) -> None:
        self.n_words += len(block.begin) - block.known
        number = np.full(len(block.begin), -1, np.int32)
        # Words before the new ones take part in longer phrases.
        every = np.arange(len(block.begin))
        some = every[_set(maps[0], block.prints(every, 1))]
        if len(some):
            number[some] = self._numbers(block, some)
        for n, bits in enumerate(maps, 1):
            at = block.places(n)
            prints = block.prints(at, n)
            may = _set(bits, prints)
            at, prints = at[may], prints[may]
            ids = np.full((len(at), LONGEST), -1, np.int32)
            for j in range(n):
                ids[:, j] = number[at + j]
            may = (ids[:, :n] >= 0).all(axis=1)
            if may.any():
                self._merge(_combined(prints[may], ids[may], np.ones(may.sum(), np.int64)))

    def _merge(self, more: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.entries.append(more)
        self.pending += len(more[0])
        # Merged whenever the entries have doubled, so that the work stays in proportion.
        if self.pending > self.merged + ENTRIES // 8:
            self.settle()

    def settle(self) -> None:
        if len(self.entries) > 1:
            self.entries = [_combined(*(np.concatenate(x) for x in zip(*self.entries, strict=True)))]
        self.merged, self.pending = sum(len(e[0]) for e in self.entries), 0

    def size(self) -> int:
        return max(self.merged, len(self.words))

    def rows(self) -> Iterator[pd.DataFrame]:
        """All sums, a slice at a time: phrases are spelled out for one slice only."""
        self.settle()
        yield pd.DataFrame({"lang": [self.lang], "size": 0, "phrase": b"", "times": self.n_words})
        for _, every, sums in self.entries:
            for first in range(0, len(every), SLICE):
                ids = every[first : first + SLICE]
                lengths = (ids >= 0).sum(axis=1)
                phrases = [b" ".join([self.words[w] for w in row[:n]]) for row, n in zip(ids.tolist(), lengths.tolist(), strict=True)]
                yield pd.DataFrame({"lang": self.lang, "size": lengths, "phrase": phrases, "times": sums[first : first + SLICE]})


def _count_phrases(batches: Iterator[pd.DataFrame], maps: Broadcast, mask: int | None) -> Iterator[pd.DataFrame]:
    tables: dict[str, _Table] = {}
    for lang, block in _blocks(batches, mask):
        tables.setdefault(lang, _Table(lang)).add(block, maps.value)
        if sum(t.size() for t in tables.values()) > ENTRIES:
            for table in tables.values():
                yield from table.rows()
            tables.clear()
    for table in tables.values():
        yield from table.rows()


def phrase_counts(docs: DataFrame, least: int = 30, bits: int = BITS, mask: int | None = None) -> DataFrame:
    """lang, size, phrase, times: every phrase of up to four words that occurs ``least`` times.

    Size 0 has the number of all words of the language.  ``mask`` cuts fingerprints short, for tests.
    """
    spark = docs.sparkSession
    texts = checked(docs, "lang", "text").select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().cast("binary").alias("text")
    )
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    narrow = (1 << min(62, max(bits.bit_length() - 1, math.ceil(math.log2(size + 2)) + SPARE))) - 1
    maps: list[np.ndarray] = []
    below = None
    for n in range(1, LONGEST + 1):
        sums = texts.mapInPandas(partial(_count_level, n=n, below=below, narrow=narrow, mask=mask), "print long, times long")
        frequent = sums.groupBy("print").agg(F.sum("times").alias("times")).filter(F.col("times") >= least)
        maps.append(_bit_map(frequent, bits))
        below = spark.sparkContext.broadcast(maps[-1])
    every = spark.sparkContext.broadcast(maps)
    # A task sends each phrase it meets once, so as few tasks as keep all cores busy send the fewest rows.
    rows = texts.coalesce(spark.sparkContext.defaultParallelism).mapInPandas(
        partial(_count_phrases, maps=every, mask=mask), "lang string, size int, phrase binary, times long"
    )
    counted = rows.groupBy("lang", "size", "phrase").agg(F.sum("times").alias("times"))
    return (
        counted.filter((F.col("times") >= least) | (F.col("size") == 0))
        .withColumn("phrase", F.col("phrase").cast("string"))
    )


def _weakest_cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, l, r, score of the cut with the lowest score, the first of equals."""
    cuts = candidates.select("lang", "phrase", "a", "size", F.split("phrase", " ").alias("w")).select(
        "lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "w"
    )
    cuts = cuts.select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"),
        F.array_join(F.expr("slice(w, k + 1, size(w) - k)"), " ").alias("rest"),
    )
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("times").alias(name)), ["lang", part])
    # Exact: 28 decimal digits by 20.
    score = F.expr("CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(7, 0)) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    cuts = cuts.withColumn("score", score.cast("long"))
    least = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "cut.l", "cut.r", "cut.score")


def _within_longer(candidates: DataFrame) -> DataFrame:
    """lang, phrase, longer: the highest count of a candidate that holds the phrase inside."""
    words = candidates.filter("size > 2").select("lang", "a", "size", F.split("phrase", " ").alias("w"))
    inner = F.expr(
        """flatten(transform(sequence(2, size - 1), m ->
             transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))"""
    )
    return (
        words.select("lang", "a", F.explode(inner).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    counts = staged(phrase_counts(docs, least, **options), "phrases")
    every = counts.filter("size = 0").select("lang", F.col("times").alias("n"))
    counts = counts.filter("size > 0")
    candidates = counts.filter("size > 1").select("lang", "phrase", "size", F.col("times").alias("a"))
    covered = F.expr("CAST(longer AS DECIMAL(19, 0)) * 100 >= CAST(a AS DECIMAL(19, 0)) * 80")
    own = (
        candidates.join(_within_longer(candidates), ["lang", "phrase"], "left")
        .filter(~F.coalesce(covered, F.lit(False)))
        .select("lang", "phrase", "size", "a")
    )
    scored = own.join(_weakest_cuts(own, counts), ["lang", "phrase"])
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        scored.withColumn("rank", F.row_number().over(best).cast("long"))
        .filter(F.col("rank") <= top)
        .join(every, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
