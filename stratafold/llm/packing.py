"""Vector bin packing of tokenised examples into training sequences.

Every example is tokenised once, where it lies.  A sequence has three limits at a
time: tokens, segments, loss-bearing tokens.  Each task packs its own examples, so
nothing is shuffled: it keeps a pool of bounded size and fills one open sequence at a
time with the piece of the largest dot product between its demand and the room left
(both as shares of the limits, weighted by the pool's mean demand).  When nothing fits
whole, the best piece is cut and its tail goes back to the pool, so a sequence ends
short only when segments or loss run out.  What a task has left at its end is cut into
sequences of power-of-two length, which need no padding.

The ids of an example are those of its prompt (no loss), of its text (loss) and an
end id (loss).  Sequence ids hold the task's number in their upper bits; a repeated
task reads the same rows in the same order and so gives the same ids.

Results by case: null text or prompt is empty; an example without text is its end id
alone; a text of any length is cut into as many pieces as needed; repeated rows are
examples of their own; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import checked, text_of

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
    "`offset` long, segment int, loss_tokens long"
)


@dataclass(frozen=True)
class Limits:
    """Of one sequence; ``segments`` keeps attention masks and position tables small."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


def _latin(word: str) -> bool:
    """Letters whose lower case is one letter, whatever stands around them."""
    return word.isascii() or max(word) < "\u0130"


class Tokens:
    """Ids of texts, for vocabularies of lower-case words one lookup for each word.

    Such a vocabulary's word splitting never joins what a blank or line feed parts, nor a
    letter and the comma or full stop after it.  So a text's ids are those of its words
    in a row, forms of one word share the work, and a word of Latin letters only goes to
    the merges without normalising and splitting.  Texts of any other vocabulary are
    encoded whole.  ``words`` bounds the memory.
    """

    def __init__(self, path: str, words: int = 500_000, longest: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.words, self.longest = words, longest
        self.known: dict[str, bytes] = {"": b""}
        setup = json.loads(self.model.to_str())
        #: First characters of added tokens, which are matched in a text as it is, before it is lower-cased.
        self.marks = {t["content"][0] for t in setup.get("added_tokens") or []}
        self.by_word = setup["model"].get("end_of_word_suffix") == "</w>" and "Lowercase" in str(setup["normalizer"])
        if self.by_word:
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([])
            # How the vocabulary writes the bytes of Latin letters beyond ASCII.
            spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            letters = filter(str.isalpha, map(chr, range(0x80, 0x130)))
            self.spelling = str.maketrans({c: spell(c)[0][0] for c in letters})

    def _learn(self, words: list[str]) -> None:
        simple = [w for w in words if w.isalpha() and _latin(w)]
        rest = [w for w in words if not (w.isalpha() and _latin(w))]
        spelt = [w if w.isascii() else w.translate(self.spelling) for w in simple]
        for model, names, forms in ((self.bare, simple, spelt), (self.model, rest, rest)):
            ids = model.encode_batch_fast(forms, add_special_tokens=False)
            self.known.update(zip(names, (array("I", e.ids).tobytes() for e in ids), strict=True))

    def _plain(self, word: str) -> tuple[str, str]:
        """Lower case up to the Latin letters, and a last comma or stop by itself.

        A word that may hold an added token stays as it is.
        """
        if any(mark in word for mark in self.marks):
            return word, ""
        tail = word[-1] if word[-1] in ",." and word[-2:-1].isalpha() else ""
        word = word[:-1] if tail else word
        return (word.lower() if _latin(word) else word), tail

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            whole = self.model.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(e.ids, "<u4") for e in whole]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > self.words:
            self.known = {"": b""}
        known = self.known
        new = [w for w in set().union(*split) if w not in known]
        bases, tails = zip(*map(self._plain, new), strict=True) if new else ((), ())
        self._learn([w for w in {*bases, *tails} if w not in known])
        for word, base, tail in zip(new, bases, tails, strict=True):
            known[word] = known[base] + known[tail] if tail else known[base]
        get = known.__getitem__
        out = [np.frombuffer(b"".join(map(get, words)), "<u4") for words in split]
        for word in [w for w in {*new, *bases} if len(w) > self.longest]:
            del known[word]
        return out


_TOKENS: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """One for each Python worker, whose later tasks find the words of the earlier ones."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


class Packer:
    """Open pieces of one task, in arrays: example, start, length, loss."""

    def __init__(self, limits: Limits, first: int, low: int = 512):
        self.limits, self.sequence, self.low = limits, first, low
        self.docs: list[tuple] = []  # (doc_id, ids, prompt length) of examples in the pool
        self.pool = np.zeros((0, 4), np.int64)
        self.rows: list[tuple] = []
        self.fresh()

    def fresh(self) -> None:
        self.used, self.loss, self.segments = 0, 0, 0
        self.open: list[tuple] = []

    def piece(self, example: int, start: int, tokens: int, loss: int) -> tuple[int, int]:
        """The longest piece from ``start`` within both limits, and its loss."""
        _, ids, prompt = self.docs[example]
        end = min(len(ids), start + tokens, max(start, prompt) + loss)
        return end - start, max(0, end - max(start, prompt))

    def add(self, examples: list[tuple]) -> None:
        """Whole sequences leave at once, the rest of each example joins the pool."""
        base, new = len(self.docs), []
        self.docs += examples
        for i, (_, ids, _) in enumerate(examples, base):
            start = 0
            while start < len(ids):
                length, loss = self.piece(i, start, self.limits.tokens, self.limits.loss)
                if length == self.limits.tokens:
                    self.emit([(i, start, length, loss)])
                else:
                    new.append((i, start, length, loss))
                start += length
        if new:
            self.pool = np.concatenate([self.pool, np.array(new, np.int64)])

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for segment, (i, start, length, loss) in enumerate(pieces):
            doc, ids, _ = self.docs[i]
            part = ids[start : start + length].astype("<u4").tobytes()
            self.rows.append((doc, start, length, part, len(ids), self.sequence, at, segment, loss))
            at += length
        self.sequence += 1

    def close(self) -> None:
        if self.open:
            self.emit(self.open)
        self.fresh()

    def fill(self, down_to: int) -> None:
        """Pack until so many pieces are left."""
        most = self.limits
        scale = np.array([most.tokens, most.segments, most.loss], float)
        pool = self.pool
        demand = np.column_stack([pool[:, 2], np.ones(len(pool)), pool[:, 3]]) / scale
        weight = demand.mean(axis=0) if len(pool) else scale
        left = np.ones(len(pool), bool)
        n = len(pool)
        while n > down_to:
            room = np.array([most.tokens - self.used, most.segments - self.segments, most.loss - self.loss])
            if room.min() <= 0:
                self.close()
                continue
            fits = left & (pool[:, 2] <= room[0]) & (pool[:, 3] <= room[2])
            score = demand @ (weight * room / scale)
            if fits.any():
                k = int(np.argmax(np.where(fits, score, -1.0)))
                self.put(tuple(map(int, pool[k])))
                left[k] = False
                n -= 1
                continue
            k = int(np.argmax(np.where(left, score, -1.0)))
            i, start, length, _ = map(int, pool[k])
            cut, loss = self.piece(i, start, int(room[0]), int(room[2]))
            self.put((i, start, cut, loss))
            rest, rest_loss = self.piece(i, start + cut, length - cut, most.loss)
            pool[k] = i, start + cut, rest, rest_loss
            demand[k] = np.array([rest, 1, rest_loss]) / scale
        self.pool = pool[left]
        used = sorted({int(i) for i in self.pool[:, 0]} | {p[0] for p in self.open})
        at = {old: new for new, old in enumerate(used)}
        self.docs = [self.docs[i] for i in used]
        self.pool[:, 0] = [at[int(i)] for i in self.pool[:, 0]]
        self.open = [(at[i], *p) for i, *p in self.open]

    def put(self, piece: tuple) -> None:
        self.open.append(piece)
        self.used += piece[2]
        self.segments += 1
        self.loss += piece[3]

    def finish(self) -> None:
        """Everything left; the last sequence is cut at powers of two."""
        self.fill(0)
        queue, self.open = self.open, []
        size = 1 << max(0, self.used.bit_length() - 1)
        total = self.used
        while queue:
            size = 1 << (total.bit_length() - 1)
            now, room = [], size
            while room:
                i, start, length, _ = queue.pop(0)
                take, loss = self.piece(i, start, min(length, room), self.limits.loss)
                now.append((i, start, take, loss))
                if take < length:
                    queue.insert(0, (i, start + take, length - take, 0))
                room -= take
            total -= size
            self.emit(now)
        self.fresh()


def pack(
    docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 1, prompt: str | None = None
) -> DataFrame:
    """One row for each piece: where it starts in its example, and where in its sequence."""
    rows = checked(docs, "doc_id", "text", *([prompt] if prompt else [])).select(
        "doc_id", text_of().alias("text"), (text_of(prompt) if prompt else F.lit("")).alias("prompt")
    )

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = tokens_of(tokenizer)
        packer = Packer(limits, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40)
        end = np.array([end_id], "<u4")
        # Words and ids are plain values without cycles: looking for cycles among them is in vain.
        gc.disable()

        def out() -> pd.DataFrame:
            frame = pd.DataFrame(packer.rows, columns=[c.split()[0].strip("`") for c in SCHEMA.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            packer.rows = []
            return frame

        try:
            for batch in batches:
                ids = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
                at = 0
                while at < len(ids):
                    # About 2 MB of text at a time, one text at least.
                    stop, size = at, 0
                    while stop < len(ids) and (stop == at or size < 2_000_000):
                        size += len(batch["text"].iat[stop]) + len(batch["prompt"].iat[stop])
                        stop += 1
                    body = tokens.encode(list(batch["text"].iloc[at:stop]))
                    head = tokens.encode(list(batch["prompt"].iloc[at:stop]))
                    packer.add(
                        [
                            (doc, np.concatenate([p, b, end]), len(p))
                            for doc, p, b in zip(ids[at:stop], head, body, strict=True)
                        ]
                    )
                    packer.fill(packer.low)
                    yield out()
                    at = stop
            packer.finish()
            yield out()
        finally:
            gc.enable()

    return rows.mapInPandas(task, SCHEMA)
