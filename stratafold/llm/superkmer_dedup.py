"""Removal of repeated 13-word windows by super-k-mer partitioning.

The minimiser of a window is its anchor (see ``anchors``): the five words of the smallest
hash in it.  Consecutive windows that share a minimiser are a super-k-mer.  The census
leaves those whose minimiser occurs in another document too; they travel as one packed
string each to the bucket of their minimiser, where all windows of a minimiser are
sorted and so counted exactly, word for word: a window of a document is removed where
the sorted run starts with a smaller id.

A cell settles super-k-mers that it holds itself and sends the smallest id only.  A
minimiser of more than ``HOT`` documents (a passage that much of the corpus shares) would
overfill its bucket: its windows travel one by one to buckets of their own, one string
for each cell and window.

Results by case: null text has no words; a document of fewer than 13 words stays whole;
rows that share an id are one document for the comparison, so they do not remove one
another; a null id comes after all others; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from stratafold.llm import anchors
from stratafold.llm.anchors import Cell, Runs, Stretches
from stratafold.llm.words import Words

WINDOW = 13
MINIMISER = 5
HOT = 4000

_SHIP = "bucket int, cell int, `rows` binary, docs binary, starts binary, keys binary, sizes binary, data binary"
_RUNS = "cell int, runs binary"


def _find(cell: Cell) -> Stretches:
    return anchors.stretches([Words(t).hashes() for t in cell.texts], WINDOW, MINIMISER)


def _documents(cell: Cell) -> Stretches:
    """For the census: rows of one id count as one document."""
    found = _find(cell)
    _, number = np.unique(cell.ids, return_inverse=True)
    return Stretches(number[found.row] if len(found.row) else found.row, found.start, found.count, found.anchor)


def _settle_equal(items: list[tuple], runs: Runs, cell: int) -> list[tuple]:
    """(row, doc, start, words, key, string): what the smallest id holds; the rest is removed."""
    least: dict[bytes, int] = {}
    for item in items:
        least[item[5]] = min(item[1], least.get(item[5], item[1]))
    gone = [i for i in items if i[1] > least[i[5]]]
    if gone:
        row, _, start, words, _, _ = zip(*gone, strict=True)
        runs.add(np.full(len(row), cell), row, start, np.array(start) + words)
    return [i for i in items if i[1] == least[i[5]]]


def _ship(frame: pd.DataFrame, replies: pd.DataFrame, buckets: int) -> pd.DataFrame:
    columns = ["bucket", "cell", "rows", "docs", "starts", "keys", "sizes", "data"]
    if not len(frame) or not len(replies):
        return pd.DataFrame([], columns=columns)
    cell, number = anchors.cell_rows(frame), int(frame["cell"].iat[0])
    found = _find(cell)
    shared, very = anchors.answered(replies)
    marks = anchors.marks_of(found.anchor, buckets)
    wanted = np.flatnonzero(anchors.among(marks, shared))
    hot = anchors.among(marks, very)
    runs = Runs()
    plain, single = [], []
    last, words = -1, None
    for k in wanted[np.argsort(found.row[wanted], kind="stable")]:
        row, start, count = int(found.row[k]), int(found.start[k]), int(found.count[k])
        if row != last:
            words, last = Words(cell.texts[row]), row
        doc = int(cell.ids[row])
        if hot[k]:
            single += [(row, doc, i, WINDOW, 0, words.piece(i, WINDOW)) for i in range(start, start + count)]
        else:
            size = count + WINDOW - 1
            plain.append((row, doc, start, size, int(found.anchor[k]), words.piece(start, size)))
    parcels: dict[int, list[tuple]] = {}
    for item in _settle_equal(plain, runs, number):
        parcels.setdefault((item[4] & 0xFFFFFFFF) % buckets, []).append(item)
    for item in _settle_equal(single, runs, number):
        key = int.from_bytes(hashlib.blake2b(item[5], digest_size=8).digest(), "little")
        parcels.setdefault(key % buckets, []).append((*item[:4], key, item[5]))
    out = []
    for bucket, items in parcels.items():
        row, doc, start, _, key, data = zip(*items, strict=True)
        out.append(
            (
                bucket,
                number,
                np.array(row, np.int64).tobytes(),
                np.array(doc, np.int64).tobytes(),
                np.array(start, np.int64).tobytes(),
                np.array(key, np.uint64).tobytes(),
                np.array([len(d) for d in data], np.int64).tobytes(),
                b"".join(data),
            )
        )
    # Settled runs pass through a bucket unchanged: they have no sizes.
    out += [(number % buckets, c, r, b"", b"", b"", None, b"") for c, r in runs.rows()]
    return pd.DataFrame(out, columns=columns)


def _count(frame: pd.DataFrame) -> pd.DataFrame:
    """One bucket: the windows of each minimiser sorted; all but the smallest id's are removed."""
    passed = frame["sizes"].isna()
    out = [(int(c), r) for c, r in zip(frame["cell"][passed], frame["rows"][passed], strict=True)]
    part, runs = frame[~passed], Runs()
    if len(part):
        number = lambda name, kind=np.int64: np.frombuffer(b"".join(part[name]), kind)
        row, doc, start = number("rows"), number("docs"), number("starts")
        key, sizes = number("keys", np.uint64), number("sizes")
        cell = np.repeat(part["cell"].to_numpy(np.int64), [len(x) // 8 for x in part["rows"]])
        data, ends = b"".join(part["data"]), np.cumsum(sizes)
        gone: list[tuple[int, int]] = []
        for _, group in groupby(np.argsort(key, kind="stable").tolist(), key=lambda k: key[k]):
            members = list(group)
            if len({doc[k] for k in members}) < 2:
                continue
            windows = []
            for k in members:
                text = data[ends[k] - sizes[k] : ends[k]]
                words = text.split(b" ")
                at = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
                windows += [
                    (text[at[i] : at[i + WINDOW] - 1], int(doc[k]), k, i) for i in range(len(words) - WINDOW + 1)
                ]
            windows.sort()
            content, least = None, 0
            for window, doc_id, k, i in windows:
                if window != content:
                    content, least = window, doc_id
                elif doc_id > least:
                    gone.append((k, i))
        if gone:
            k, i = np.array(gone).T
            runs.add(cell[k], row[k], start[k] + i, start[k] + i + WINDOW)
    out += list(runs.rows())
    return pd.DataFrame(out, columns=["cell", "runs"])


def _cut(frame: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    cell = anchors.cell_rows(frame)
    table = anchors.runs_of(runs)
    bounds = np.searchsorted(table[0], np.arange(len(cell.texts) + 1))
    out = []
    for k, text in enumerate(cell.texts):
        words, kept, spans = text.split(), [], table[1:, bounds[k] : bounds[k + 1]].T.tolist()
        at = 0
        for start, end in spans:
            kept += words[at:start]
            at = end
        kept += words[at:]
        rest = b" ".join(kept)
        out.append(
            (
                None if cell.null[k] else int(cell.ids[k]),
                len(words),
                len(words) - len(kept),
                hashlib.sha256(rest).hexdigest(),
                spans,
                rest.decode(),
            )
        )
    frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def _repeats(docs: DataFrame, cut, schema: str, hot: int) -> DataFrame:
    cells, n = anchors.in_cells(docs)
    replies = anchors.census(cells, n, _documents, by_row=True, hot=hot)
    shipped = (
        cells.groupBy("cell")
        .cogroup(replies.groupBy("cell"))
        .applyInPandas(lambda left, right: _ship(left, right, n), _SHIP)
    )
    runs = shipped.groupBy("bucket").applyInPandas(_count, _RUNS)
    return cells.groupBy("cell").cogroup(runs.groupBy("cell")).applyInPandas(cut, schema)


_REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The report with the removed spans (word numbers) and the remaining words."""
    return _repeats(docs, _cut, f"{_REPORT}, spans array<array<long>>, kept string", hot)


def repeat_report(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per document how many words are removed, and a digest of those left."""
    names = [c.split()[0] for c in _REPORT.split(", ")]
    return _repeats(docs, lambda left, right: _cut(left, right)[names], _REPORT, hot)
