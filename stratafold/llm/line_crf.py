"""Document quality from a linear-chain conditional random field over lines.

Every line is described by shares of character classes, word shapes and repetition,
for itself and its two neighbours.  A two-state chain (bad, good) is trained by
gradient ascent on the conditional likelihood; a labelled document gives its label to
all of its lines.  Scoring runs forward-backward over each whole document and takes
the length-weighted mean of the good marginals, calibrated by one logistic curve.

Neither label, language, source nor id enters a score, only the text.  Training reads
at most ``TRAIN_DOCS`` labelled documents of each class, the first by a hash of their
id, of at most ``TRAIN_CHARS`` characters each; scoring reads everything.

Results by case: null text is empty; an empty text is one empty line and gets a score
like any other; documents of any length are scored over all lines, in batches of about
``BATCH`` bytes; equal texts get equal scores; without labels of both classes every
score is the share of good ones among the labels (0.5 without any); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import checked, text_of

TRAIN_DOCS = 1000
TRAIN_CHARS = 20_000
BATCH = 600_000
THRESHOLD = 0.7

_CLASSES = ("upper", "lower", "digit", "blank", "mark", "bar", "bang", "stop", "high")


def _class_table() -> np.ndarray:
    """Character class of each byte value."""
    table = np.full(256, -1, np.int8)
    groups = {
        "upper": range(65, 91),
        "lower": range(97, 123),
        "digit": range(48, 58),
        "blank": (9, 11, 12, 13, 32),
        "mark": b"#$%&*^~<>=_\\{}[]",
        "bar": b"|",
        "bang": b"!?",
        "stop": b".,;:",
        "high": range(192, 256),
    }
    for k, name in enumerate(_CLASSES):
        table[list(groups[name])] = k
    return table


_TABLE = _class_table()
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULT
    return x ^ (x >> np.uint64(29))


_BASE = 0x100000001B3
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64; grown as needed and kept."""
    if len(_POWERS.get(base, ())) < n:
        x = np.full(max(n, BATCH * 2), base, np.uint64)
        x[0] = 1
        _POWERS[base] = np.multiply.accumulate(x)
    return _POWERS[base][:n]


def _span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span, alike for equal spans."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=total[1:])
    back = _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)
    return _spread((total[ends] - total[starts]) * back[starts])


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length in bytes, and the first line of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], breaks[:-1] + 1])
    size = breaks - starts
    text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    firsts = np.concatenate([[0], np.searchsorted(breaks, text_ends)[:-1] + 1]).astype(np.int64)
    lines = len(starts)
    # Counts of each class within each line, one histogram for all.
    kinds = _TABLE[data]
    of_line = np.repeat(np.arange(lines), size + 1)
    counts = np.bincount((of_line << 4) + (kinds + 1), minlength=lines << 4).reshape(lines, 16)[:, 1:]
    n = {name: counts[:, k].astype(float) for k, name in enumerate(_CLASSES)}
    # Words: runs of bytes that are neither blank nor line feed.
    solid = (kinds != _CLASSES.index("blank")) & (data != 10)
    edge = np.diff(np.concatenate([[0], solid.astype(np.int8), [0]]))
    w0, w1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    w_line = of_line[w0] if len(w0) else np.zeros(0, np.int64)
    words = np.bincount(w_line, minlength=lines).astype(float)
    w_hash = _span_hash(data, w0, w1)
    same = (w_hash[1:] == w_hash[:-1]) & (w_line[1:] == w_line[:-1])
    repeats = np.bincount(w_line[1:][same], minlength=lines) if len(w0) > 1 else np.zeros(lines)
    # Line number above 24 bits of hash: one sort finds the distinct words of every line.
    key = np.sort((w_line.astype(np.uint64) << np.uint64(24)) | (w_hash >> np.uint64(40)))
    fresh = np.concatenate([key[:1], key[1:][key[1:] != key[:-1]]])
    distinct = np.bincount((fresh >> np.uint64(24)).astype(np.int64), minlength=lines)
    # Lines that their document holds more than once.
    l_hash = _span_hash(data, starts, breaks)
    text_of_line = np.searchsorted(firsts, np.arange(lines), side="right") - 1
    order = np.lexsort((l_hash, text_of_line))
    eq = (l_hash[order][1:] == l_hash[order][:-1]) & (text_of_line[order][1:] == text_of_line[order][:-1])
    twice = np.zeros(lines)
    twice[order[1:][eq]] = 1
    twice[order[:-1][eq]] = 1
    per_word = lambda x: np.minimum(x / np.maximum(words, 1), 3)
    letters = np.maximum(n["upper"] + n["lower"] + n["high"], 1)
    bytes_ = np.maximum(size, 1)
    own = np.column_stack(
        [
            np.log1p(size) / 5,
            np.log1p(words) / 4,
            n["upper"] / letters,
            n["high"] / letters,
            n["digit"] / bytes_,
            n["blank"] / bytes_,
            n["mark"] / bytes_,
            per_word(n["mark"]),
            per_word(n["bar"]),
            per_word(n["bang"]),
            per_word(n["stop"]),
            repeats / np.maximum(words, 1),
            distinct / np.maximum(words, 1),
            twice,
            np.minimum(bytes_ / np.maximum(words, 1), 40) / 10,
            words == 0,
            words < 3,
        ]
    )
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[firsts] = 0
    last = np.concatenate([firsts[1:] - 1, [lines - 1]])
    after[last] = 0
    ends = np.zeros((lines, 2))
    ends[firsts, 0] = 1
    ends[last, 1] = 1
    return np.hstack([own, before, after, ends]), size + 1, firsts


def _products(steps: np.ndarray, longest: int) -> np.ndarray:
    """Running products of 2 x 2 matrices (4 x n, row by row), each scaled to a largest entry of 1."""
    out, reach = steps.copy(), 1
    while reach < longest and reach < out.shape[1]:
        (a, b, c, d), (e, f, g, h) = out[:, :-reach], out[:, reach:]
        new = np.stack([a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h])
        out[:, reach:] = new / np.maximum(new.max(axis=0), 1e-300)
        reach *= 2
    return out


def _marginals(emit: np.ndarray, move: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected moves summed over all lines.

    A first line's matrix has equal rows and a last line's has equal columns, so the
    running product forgets what lies beyond the document.
    """
    n = len(emit)
    lasts = np.concatenate([firsts[1:] - 1, [n - 1]])
    longest = int((lasts - firsts).max()) + 2
    e = np.stack([np.zeros(n), emit])
    e = np.exp(e - e.max(axis=0))
    m = np.exp(move)
    steps = np.concatenate([m[0][:, None] * e, m[1][:, None] * e])
    steps[:, firsts] = np.concatenate([e, e])[:, firsts]
    steps /= steps.max(axis=0)
    alpha = _products(steps, longest)[:2]
    backs = np.ones((4, n))
    backs[:, :-1] = steps[:, 1:]
    backs[:, lasts] = 1
    # Products from the end: transposed matrices in reversed order.
    beta = _products(backs[[0, 2, 1, 3]][:, ::-1], longest)[:2, ::-1]
    p = alpha * beta
    p /= p.sum(axis=0)
    inner = np.ones(n, bool)
    inner[firsts] = False
    at = np.flatnonzero(inner)
    ahead = (e * beta)[:, at]
    pair = alpha[:, None, at - 1] * m[:, :, None] * ahead[None]
    pair /= np.maximum(pair.sum(axis=(0, 1)), 1e-300)
    return p[1], pair.sum(axis=2)


@dataclass(frozen=True)
class LineModel:
    """What scoring needs; a few hundred numbers."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    move: np.ndarray
    slope: float
    shift: float
    constant: float | None = None

    def lines(self, features: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        emit = ((features - self.mean) / self.scale) @ self.weights + self.bias
        return _marginals(np.clip(emit, -30, 30), self.move, firsts)[0]

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(share), self.constant)
        x = np.log(np.clip(share, 1e-4, 1 - 1e-4) / np.clip(1 - share, 1e-4, 1))
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -30, 30)))


def _mean_by_length(p: np.ndarray, size: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(p * size, firsts) / np.add.reduceat(size, firsts)


def fit(texts: list[bytes], good: np.ndarray, rounds: int = 100, ridge: float = 1e-3) -> LineModel:
    """Adam on the mean log-likelihood, both classes weighing the same."""
    if len(texts) == 0 or good.min() == good.max():
        share = float(good.mean()) if len(texts) else 0.5
        one = np.ones(1)
        return LineModel(one, one, one, 0.0, np.zeros((2, 2)), 1.0, 0.0, constant=share)
    features, size, firsts = line_features(texts)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    x = (features - mean) / scale
    counts = np.diff(np.concatenate([firsts, [len(x)]]))
    y = np.repeat(good.astype(float), counts)
    inner = np.ones(len(x), bool)
    inner[firsts] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    params = np.zeros(x.shape[1] + 1 + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for k in range(1, rounds + 1):
        move = params[-4:].reshape(2, 2)
        p, moves = _marginals(np.clip(x @ params[:-5] + params[-5], -30, 30), move, firsts)
        gap = y - p
        grad = np.concatenate([x.T @ gap, [gap.sum()], (seen - moves).ravel()]) / len(x)
        grad[:-5] -= ridge * params[:-5]
        grad[-4:] -= 0.05 * params[-4:]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        params += 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    model = LineModel(mean, scale, params[:-5], float(params[-5]), params[-4:].reshape(2, 2), 1.0, 0.0)
    share = _mean_by_length(model.lines(features, firsts), size, firsts)
    z = np.log(np.clip(share, 1e-4, 1 - 1e-4) / np.clip(1 - share, 1e-4, 1))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a two-parameter logistic curve
        q = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        v = q * (1 - q) + 1e-6
        g = np.array([((good - q) * z).sum() - 0.1 * (slope - 1), (good - q).sum()])
        h = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        slope, shift = max(0.05, slope + step[0]), shift + step[1]
    return LineModel(mean, scale, params[:-5], float(params[-5]), params[-4:].reshape(2, 2), slope, shift)


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, each: int = TRAIN_DOCS) -> LineModel:
    """A model from a bounded sample of labelled documents outside the held-out fold."""
    usable = (
        checked(labels, "doc_id", "quality")
        .filter("doc_id is not null and quality in (0, 1)")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .withColumn("turn", F.xxhash64("doc_id"))
    )
    # At most 2 * each rows of two numbers.
    chosen = usable.filter("quality = 1").orderBy("turn").limit(each).unionByName(
        usable.filter("quality = 0").orderBy("turn").limit(each)
    )
    sample = (
        checked(docs, "doc_id", "text")
        .filter(F.char_length(text_of()) <= TRAIN_CHARS)
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "quality", text_of().alias("text"))
        .toPandas()
        .sort_values(["doc_id", "text"])
    )
    return fit([t.encode() for t in sample["text"]], sample["quality"].to_numpy(float))


def _scores(model: LineModel, carry: list[str]):
    """A task that scores batches of rows with a ``_text`` column and keeps the carried ones."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["_text"])
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < BATCH):
                    size += len(texts[stop])
                    stop += 1
                features, length, firsts = line_features([bytes(t) for t in texts[at:stop]])
                p = model.lines(features, firsts) if model.constant is None else np.full(len(length), model.constant)
                own = {
                    "score": model.calibrated(_mean_by_length(p, length, firsts)),
                    "n_lines": np.diff(np.concatenate([firsts, [len(length)]])),
                    "good_lines": np.add.reduceat((p >= 0.5).astype(np.int64), firsts),
                }
                yield batch[carry].iloc[at:stop].reset_index(drop=True).assign(**own)
                at = stop

    return task


def score(docs: DataFrame, model: LineModel) -> DataFrame:
    """doc_id, score, n_lines, good_lines for every row."""
    rows = checked(docs, "doc_id", "text").select(
        F.col("doc_id").cast("string").alias("doc_id"), text_of().cast("binary").alias("_text")
    )
    scored = rows.mapInPandas(
        _scores(model, ["doc_id"]), "doc_id string, score double, n_lines long, good_lines long"
    )
    # The id travels as text, as pandas would turn whole numbers beside nulls into fractions.
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier accepts, with the columns they came with."""
    model = train(docs, labels)

    @F.pandas_udf("double")
    def score_of(texts: pd.Series) -> pd.Series:
        parts = _scores(model, [])(iter([pd.DataFrame({"_text": texts})]))
        return pd.concat([p["score"] for p in parts], ignore_index=True)

    return docs.filter(score_of(text_of().cast("binary")) >= threshold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, train(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_lines",
        "good_lines",
    )
