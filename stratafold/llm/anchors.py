"""Anchors of fixed-length windows, and the census that tells which anchors repeat.

A window of W symbols is represented by its anchor: of all grams inside it the one of
the smallest hash, the leftmost of equals.  That depends on the window's content only,
so equal windows anywhere have equal anchors, and about one position in W / 2 is an
anchor of some window.  Consecutive windows of one anchor form a stretch.

Documents are gathered in cells of a few megabytes by a hash of their id.  A census
sends one short mark for each anchor of a cell to a bucket; the bucket answers each cell
with the marks that occur elsewhere too.  Only stretches of those anchors have to be
compared at all.  A mark may be shared by chance, which costs a comparison and changes
nothing.  All steps of a plan read one shuffle of the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import cells_for, checked, text_of

#: Symbols that are worked on at a time; the position takes the lower bits of a key.
CHUNK = 1 << 18
_LOW = np.uint64((1 << 20) - 1)
_NONE = np.iinfo(np.int64).max  # stands for a null id: after all others


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(values: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q symbols from each position, by doubling."""
    out, reach, factor = None, 0, np.uint64(0x9E3779B97F4A7C15)
    power, width, step = values.astype(np.uint64), 1, factor
    while True:
        if q & width:
            if out is None:
                out, reach = power, width
            else:
                n = len(values) - reach - width + 1
                with np.errstate(over="ignore"):
                    out = out[:n] * step + power[reach : reach + n]
                reach += width
        if width * 2 > q:
            return mix(out)
        with np.errstate(over="ignore"):
            power = power[:-width] * step + power[width:]
            step = step * step
        width *= 2


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    if width > reach:
        keys = np.minimum(keys[: len(keys) - (width - reach)], keys[width - reach :])
    return keys


@dataclass
class Stretches:
    """Of one cell: row, first window, number of windows, anchor hash."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray


def stretches(rows: list[np.ndarray], window: int, gram: int) -> Stretches:
    """All windows of all rows (arrays of symbols), by stretches."""
    parts: list[tuple] = []
    piece: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal piece, size
        if not piece:
            return
        values = np.concatenate([p[2] for p in piece])
        lengths = np.array([len(p[2]) for p in piece])
        piece_of = np.repeat(np.arange(len(piece)), lengths)
        begin = np.cumsum(lengths) - lengths
        hashes = gram_hashes(values, gram)
        keys = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        best = (sliding_min(keys, window - gram + 1) & _LOW).astype(np.int64)
        n = len(best)
        whole = np.flatnonzero(piece_of[:n] == piece_of[window - 1 : window - 1 + n])
        if len(whole):
            at = best[whole]
            first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (np.diff(whole) > 1)]))
            owner = piece_of[whole[first]]
            parts.append(
                (
                    np.array([p[0] for p in piece])[owner],
                    whole[first] - begin[owner] + np.array([p[1] for p in piece])[owner],
                    np.diff(np.concatenate([first, [len(whole)]])),
                    mix(hashes[at[first]] + np.uint64(1)),
                )
            )
        piece, size = [], 0

    for k, values in enumerate(rows):
        for at in range(0, max(1, len(values) - window + 1), CHUNK):
            part = values[at : at + CHUNK + window - 1]
            if len(part) < window:
                continue
            if size + len(part) > CHUNK:
                flush()
            piece.append((k, at, part))
            size += len(part)
    flush()
    if not parts:
        none = np.zeros(0, np.int64)
        return Stretches(none, none, none, none.astype(np.uint64))
    return Stretches(*(np.concatenate(x) for x in zip(*parts, strict=True)))


@dataclass
class Cell:
    """The rows of a cell by id, null last, then text; a row's number is its place here."""

    ids: np.ndarray
    texts: list[bytes]
    null: np.ndarray


def cell_rows(frame: pd.DataFrame) -> Cell:
    null = frame["doc_id"].isna().to_numpy()
    ids = frame["doc_id"].fillna(0).astype("int64").to_numpy().copy()
    ids[null] = _NONE
    texts = [bytes(t) for t in frame["text"]]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return Cell(ids[order], [texts[i] for i in order], null[order])


def in_cells(docs: DataFrame) -> tuple[DataFrame, int]:
    """cell, doc_id, text as bytes, laid out by cell; and the number of cells."""
    rows = checked(docs, "doc_id", "text").select("doc_id", text_of().cast("binary").alias("text"))
    cells = cells_for(rows, "text")
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "cell"), cells


def marks_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper, mark in the lower half."""
    bucket = (anchor & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
    return (bucket << np.uint64(32)) | (anchor >> np.uint64(32))


def by_bucket(sorted_marks: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """bucket, first, end of each bucket's run."""
    bucket = sorted_marks >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    for a, b in zip(first, [*first[1:], len(bucket)], strict=True):
        yield int(bucket[a]), int(a), int(b)


def census(
    cells: DataFrame, n: int, find: Callable[[Cell], Stretches], by_row: bool, hot: int
) -> DataFrame:
    """cell, bucket, shared, hot: the marks of each cell that are not its alone.

    ``by_row`` counts the rows that hold a mark, not its occurrences.  A mark counted
    more than ``hot`` times in all is listed as hot too.
    """

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        found = find(cell_rows(frame))
        marks = marks_of(found.anchor, n)
        if by_row:
            order = np.lexsort((found.row, marks))
            m, r = marks[order], found.row[order]
            keep = np.concatenate([[True], (m[1:] != m[:-1]) | (r[1:] != r[:-1])]) if len(m) else []
            marks = m[np.asarray(keep, bool)]
        marks, times = np.unique(marks, return_counts=True)
        out = []
        for bucket, a, b in by_bucket(marks):
            low, more = (marks[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4"), times[a:b] > 1
            out.append(
                (
                    bucket,
                    int(frame["cell"].iat[0]),
                    low[~more].tobytes(),
                    low[more].tobytes(),
                    times[a:b][more].astype("<u4").tobytes(),
                )
            )
        return pd.DataFrame(out, columns=["bucket", "cell", "once", "more", "times"])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        each = []
        for once, more, times in zip(frame["once"], frame["more"], frame["times"], strict=True):
            a, b = np.frombuffer(once, "<u4"), np.frombuffer(more, "<u4")
            each.append((np.concatenate([a, b]), np.concatenate([np.ones(len(a), "<u4"), np.frombuffer(times, "<u4")])))
        marks = np.concatenate([m for m, _ in each])
        values, at = np.unique(marks, return_inverse=True)
        total = np.bincount(at, np.concatenate([t for _, t in each]).astype(float))
        many, very = total[at] > 1, total[at] > hot
        out, p = [], 0
        for cell, (m, _) in zip(frame["cell"], each, strict=True):
            part = slice(p, p + len(m))
            p += len(m)
            if many[part].any():
                out.append((cell, frame["bucket"].iat[0], m[many[part]].tobytes(), m[very[part]].tobytes()))
        return pd.DataFrame(out, columns=["cell", "bucket", "shared", "hot"])

    marks = cells.groupBy("cell").applyInPandas(
        count, "bucket int, cell int, once binary, more binary, times binary"
    )
    return marks.groupBy("bucket").applyInPandas(answer, "cell int, bucket int, shared binary, hot binary")


def answered(replies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shared and hot marks of a cell, sorted, with their buckets."""

    def gather(column: str) -> np.ndarray:
        parts = [
            (np.uint64(bucket) << np.uint64(32)) | np.frombuffer(x, "<u4").astype(np.uint64)
            for bucket, x in zip(replies["bucket"], replies[column], strict=True)
        ]
        return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)

    return gather("shared"), gather("hot")


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


class Runs:
    """Removed runs of rows, gathered by cell for the way back."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, cell, row, start, end) -> None:
        if len(row):
            self.parts.append(tuple(np.asarray(x, np.int64) for x in (cell, row, start, end)))

    def rows(self) -> Iterator[tuple[int, bytes]]:
        if not self.parts:
            return
        cell, row, start, end = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((end, start, row, cell))
        cell, table = cell[order], np.stack([row, start, end])[:, order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        for a, b in zip(first, [*first[1:], len(cell)], strict=True):
            yield int(cell[a]), merged(table[:, a:b]).tobytes()


def merged(table: np.ndarray) -> np.ndarray:
    """Rows x runs (3 x n) sorted by row and start, touching runs joined."""
    if table.shape[1] == 0:
        return table
    order = np.lexsort((table[1], table[0]))
    row, start, end = table[:, order]
    span = int(end.max()) + 2
    a, b = start + row * span, end + row * span
    reach = np.maximum.accumulate(b)
    first = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
    stop = np.concatenate([reach[first[1:] - 1], [reach[-1]]])
    return np.stack([row[first], start[first], stop - row[first] * span])


def runs_of(frame: pd.DataFrame, column: str = "runs") -> np.ndarray:
    parts = [np.frombuffer(x, np.int64).reshape(3, -1) for x in frame[column]]
    return merged(np.concatenate(parts, axis=1)) if parts else np.zeros((3, 0), np.int64)
