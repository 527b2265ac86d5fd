"""Removal of repeated 100-byte strings by suffix sorting with bucket-pointer refinement.

The census of ``anchors`` leaves only stretches of windows whose anchor occurs again.
Each cell drops stretches it holds twice and sends the first of them, packed, to its
anchor's bucket.  There equal stretches of other cells are settled first.  What differs
is concatenated and its suffixes are sorted by bucket-pointer refinement: q-gram
buckets at first, each then refined by sorting on the bucket pointers ``depth`` positions
further on; refined pointers are in place at once, so buckets refined later reuse them.
Neighbours in that order with 100 bytes in common are equal windows, and all but the
first by (document, start) are removed.

An anchor with more than ``HOT`` occurrences (a line that much of the corpus shares) would
make one bucket too large: its windows travel one by one, named by the identifiers of
their two halves, which again are bucket identifiers at a later offset.  Equal windows of
a cell travel once, so a bucket gets no more than one row for each cell and window.

Results by case: null text is empty; documents shorter than a window stay whole; rows
that share an id count in the order of their texts, so of two identical rows the second
is the repeat; a null id comes after all others; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from stratafold.llm import anchors
from stratafold.llm.anchors import Cell, Runs, Stretches

WINDOW = 100
GRAM = 24
HOT = 4000
#: Symbols that are sorted at a time, at least one anchor's stretches.
SORT = 1 << 20
_Q = 7

_SHIP = "bucket int, cell int, hot boolean, `rows` binary, docs binary, starts binary, anchors binary, sizes binary, data binary"
_RUNS = "cell int, runs binary"


def refine(symbols: np.ndarray, depth: int, slices: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order to at least ``depth`` symbols, and the q-gram codes.

    ``symbols`` are 0 (end of a string) to 256.  A bucket pointer is the last place of a
    suffix's bucket in the order.
    """
    n = len(symbols)
    wide = np.concatenate([symbols, np.zeros(_Q, symbols.dtype)]).astype(np.uint64)
    code = np.zeros(n, np.uint64)
    for k in range(_Q):
        code = code * np.uint64(257) + wide[k : k + n]
    order = np.argsort(code, kind="stable")
    new = np.concatenate([[True], code[order][1:] != code[order][:-1]])
    pointer = np.zeros(n + depth + 1, np.int64)
    known = _Q
    while True:
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [n]]) - 1
        if known == _Q:
            pointer[order] = np.repeat(last, last - first + 1) + 1
        if known >= depth:
            return order, code
        large = np.flatnonzero(last > first)
        if not len(large):
            return order, code
        # Buckets of the upper places first, so that those below see their new pointers.
        for part in np.array_split(large[::-1], min(slices, len(large))):
            sizes = (last - first + 1)[part]
            places = np.repeat(first[part], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            suffix = order[places]
            bucket = pointer[suffix]
            key = pointer[suffix + known]
            by = np.lexsort((key, bucket))
            sorted_places = np.sort(places)
            order[sorted_places] = suffix[by]
            b, k = bucket[by], key[by]
            edge = np.concatenate([[True], (b[1:] != b[:-1]) | (k[1:] != k[:-1])])
            new[sorted_places] = edge
            ends = np.concatenate([np.flatnonzero(edge)[1:], [len(edge)]]) - 1
            pointer[suffix[by]] = np.repeat(sorted_places[ends] + 1, np.diff(np.concatenate([[-1], ends])))
        known *= 2


def equal_windows(symbols: np.ndarray, code: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the windows at a and b are equal, by q-grams over the whole window."""
    same = np.ones(len(a), bool)
    for k in [*range(0, WINDOW - _Q + 1, _Q), WINDOW - _Q]:
        left = np.flatnonzero(same)
        same[left] = code[a[left] + k] == code[b[left] + k]
    return same


def repeated(texts: list[bytes], rank: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (string, offset) that are not the first of their content.

    ``rank`` orders the strings' documents, ``starts`` places them within.
    """
    joined = b"".join(t + b"\0" for t in texts)
    sizes = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(sizes) - sizes
    symbols = np.frombuffer(joined, np.uint8).astype(np.int16) + 1
    symbols[begin + sizes - 1] = 0
    order, code = refine(symbols, WINDOW)
    string = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(len(symbols)) - begin[string]
    order = order[offset[order] + WINDOW < sizes[string[order]]]
    same = equal_windows(symbols, code, order[:-1], order[1:])
    group = np.concatenate([[0], np.cumsum(~same)])
    owner, at = string[order], offset[order]
    by = np.lexsort((starts[owner] + at, rank[owner], group))
    later = np.concatenate([[False], group[by][1:] == group[by][:-1]])
    return owner[by][later], at[by][later]


def _find(cell: Cell) -> Stretches:
    return anchors.stretches([np.frombuffer(t, np.uint8) for t in cell.texts], WINDOW, GRAM)


def _half_names(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of both halves of every window of a text."""
    half = anchors.gram_hashes(np.frombuffer(text, np.uint8), WINDOW // 2)
    n = len(text) - WINDOW + 1
    return half[:n], half[WINDOW // 2 : WINDOW // 2 + n]


class _Parcels:
    """What a cell sends to one bucket."""

    def __init__(self) -> None:
        self.by: dict[tuple[int, bool], list[tuple]] = {}

    def add(self, bucket: int, hot: bool, item: tuple) -> None:
        self.by.setdefault((bucket, hot), []).append(item)

    def rows(self, cell: int) -> list[tuple]:
        out = []
        for (bucket, hot), items in self.by.items():
            row, doc, start, anchor, data = zip(*items, strict=True)
            out.append(
                (
                    bucket,
                    cell,
                    hot,
                    np.array(row, np.int64).tobytes(),
                    np.array(doc, np.int64).tobytes(),
                    np.array(start, np.int64).tobytes(),
                    np.array(anchor, np.uint64).tobytes(),
                    np.array([len(d) for d in data], np.int64).tobytes(),
                    b"".join(data),
                )
            )
        return out


def _ship(frame: pd.DataFrame, replies: pd.DataFrame, buckets: int) -> pd.DataFrame:
    columns = ["bucket", "cell", "hot", "rows", "docs", "starts", "anchors", "sizes", "data"]
    if not len(frame) or not len(replies):
        return pd.DataFrame([], columns=columns)
    cell, number = anchors.cell_rows(frame), int(frame["cell"].iat[0])
    found = _find(cell)
    shared, very = anchors.answered(replies)
    marks = anchors.marks_of(found.anchor, buckets)
    hot = anchors.among(marks, very)
    parcels, settled = _Parcels(), Runs()
    plain = np.flatnonzero(anchors.among(marks, shared) & ~hot)
    seen: set[bytes] = set()
    gone: list[tuple[int, int, int]] = []
    for k in plain[np.lexsort((found.start[plain], found.row[plain]))]:
        row, start = int(found.row[k]), int(found.start[k])
        end = start + int(found.count[k]) + WINDOW - 1
        data = cell.texts[row][start:end]
        if data in seen:
            gone.append((row, start, end))
            continue
        seen.add(data)
        parcels.add(int(marks[k] >> np.uint64(32)), False, (row, cell.ids[row], start, found.anchor[k], data))
    if gone:
        row, start, end = np.array(gone).T
        settled.add(np.full(len(row), number), row, start, end)
    # Windows of hot anchors one by one, the first of equal ones.
    at, rows_, names = [], [], []
    for row in np.unique(found.row[hot]):
        mine = np.flatnonzero(hot & (found.row == row))
        windows = np.concatenate([np.arange(found.start[k], found.start[k] + found.count[k]) for k in mine])
        a, b = _half_names(cell.texts[row])
        at.append(windows)
        rows_.append(np.full(len(windows), row))
        names.append(np.stack([a[windows], b[windows]], axis=1))
    if at:
        start, row, name = np.concatenate(at), np.concatenate(rows_), np.concatenate(names)
        by = np.lexsort((start, row, name[:, 1], name[:, 0]))
        later = np.concatenate([[False], (name[by][1:] == name[by][:-1]).all(axis=1)])
        again, one = by[later], by[~later]
        settled.add(np.full(len(again), number), row[again], start[again], start[again] + WINDOW)
        bucket = ((name[one, 0] ^ anchors.mix(name[one, 1])) % np.uint64(buckets)).astype(np.int64)
        for k in np.argsort(bucket, kind="stable"):
            i = one[k]
            parcels.add(int(bucket[k]), True, (row[i], cell.ids[row[i]], start[i], 0, name[i].tobytes()))
    out = parcels.rows(number)
    # Settled runs pass through a bucket unchanged.
    out += [(number % buckets, c, None, runs, b"", b"", b"", b"", b"") for c, runs in settled.rows()]
    return pd.DataFrame(out, columns=columns)


def _settle(frame: pd.DataFrame) -> pd.DataFrame:
    """One bucket: equal strings first, then suffix sorting of what is left."""
    done = frame[frame["hot"].isna()]
    runs, out = Runs(), [(int(c), r) for c, r in zip(done["cell"], done["rows"], strict=True)]
    number = lambda x, kind=np.int64: np.frombuffer(b"".join(x), kind)
    for hot in (False, True):
        part = frame[frame["hot"] == hot]
        if not len(part):
            continue
        sizes, anchor = number(part["sizes"]), number(part["anchors"], np.uint64)
        row, doc, start = number(part["rows"]), number(part["docs"]), number(part["starts"])
        cell = np.repeat(part["cell"].to_numpy(np.int64), [len(x) // 8 for x in part["rows"]])
        data = b"".join(part["data"])
        if hot:
            name = np.frombuffer(data, np.uint64).reshape(-1, 2)
            by = np.lexsort((start, row, doc, name[:, 1], name[:, 0]))
            later = by[np.concatenate([[False], (name[by][1:] == name[by][:-1]).all(axis=1)])]
            runs.add(cell[later], row[later], start[later], start[later] + WINDOW)
            continue
        ends = np.cumsum(sizes)
        first: dict[bytes, int] = {}
        gone = []
        # Earlier documents first: what comes back is a repeat.
        for k in np.lexsort((start, row, doc)):
            if first.setdefault(data[ends[k] - sizes[k] : ends[k]], k) != k:
                gone.append(k)
        runs.add(cell[gone], row[gone], start[gone], start[gone] + sizes[gone])
        left = np.array(list(first.values()), np.int64)
        values, count = np.unique(anchor[left], return_counts=True)
        left = left[np.isin(anchor[left], values[count > 1])]
        left = left[np.argsort(anchor[left], kind="stable")]
        rank = np.zeros(len(row), np.int64)
        # Rows of one document need one rank; starts place them within.
        by = np.lexsort((row, doc))
        same = np.concatenate([[False], (doc[by][1:] == doc[by][:-1]) & (row[by][1:] == row[by][:-1])])
        rank[by] = np.cumsum(~same)
        at = 0
        while at < len(left):
            stop, total = at, 0
            while stop < len(left) and (
                total < SORT or anchor[left[stop]] == anchor[left[stop - 1]]
            ):
                total += int(sizes[left[stop]])
                stop += 1
            block = left[at:stop]
            texts = [data[ends[k] - sizes[k] : ends[k]] for k in block]
            owner, offset = repeated(texts, rank[block], start[block])
            k = block[owner]
            runs.add(cell[k], row[k], start[k] + offset, start[k] + offset + WINDOW)
            at = stop
    out += list(runs.rows())
    return pd.DataFrame(out, columns=["cell", "runs"])


def _cut(frame: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    cell = anchors.cell_rows(frame)
    table = anchors.runs_of(runs)
    bounds = np.searchsorted(table[0], np.arange(len(cell.texts) + 1))
    out = []
    for k, text in enumerate(cell.texts):
        mine = table[1:, bounds[k] : bounds[k + 1]]
        kept, at = [], 0
        for start, end in mine.T.tolist():
            kept.append(text[at:start])
            at = end
        kept.append(text[at:])
        rest = b"".join(kept)
        spans = np.ascontiguousarray(mine.T).tolist()
        out.append(
            (
                None if cell.null[k] else int(cell.ids[k]),
                len(text),
                len(text) - len(rest),
                len(spans),
                hashlib.sha256(rest).hexdigest(),
                spans,
                rest,
            )
        )
    frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def _repeats(docs: DataFrame, cut, schema: str, hot: int) -> DataFrame:
    cells, n = anchors.in_cells(docs)
    replies = anchors.census(cells, n, _find, by_row=False, hot=hot)
    shipped = (
        cells.groupBy("cell")
        .cogroup(replies.groupBy("cell"))
        .applyInPandas(lambda left, right: _ship(left, right, n), _SHIP)
    )
    runs = shipped.groupBy("bucket").applyInPandas(_settle, _RUNS)
    return cells.groupBy("cell").cogroup(runs.groupBy("cell")).applyInPandas(cut, schema)


_REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The report with the removed spans (byte offsets) and the remaining bytes."""
    return _repeats(docs, _cut, f"{_REPORT}, spans array<array<long>>, kept binary", hot)


def repeat_report(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per document how much is removed, and a digest of what is left."""
    names = [c.split()[0] for c in _REPORT.split(", ")]
    return _repeats(docs, lambda left, right: _cut(left, right)[names], _REPORT, hot)
