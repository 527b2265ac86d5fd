"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda.

A text gets the dummy prefix, blanks become the space symbol, and every character is a
symbol.  All adjacent pairs whose concatenation is a piece stand on an agenda, best score
first, leftmost of equals; the best is merged, its two new neighbourhoods are added, and
entries whose symbols have changed meanwhile are passed over.  What is no piece in the end
is spelled in byte pieces.

A pair of characters that no piece holds side by side can never be merged across.  Cutting
texts there is exact for every vocabulary, because merges of different stretches do not
meet; the table of such pairs comes from the pieces.  Words and stretches repeat, so their
ids are kept in bounded tables of each Python worker.

Every Arrow batch is also encoded and decoded by the sentencepiece library itself;
``agrees`` says for each row whether ids and decoded text are the same.  Long texts are
compared in blocks, cut before a blank that cannot be merged with what precedes it: the
library's own dummy prefix then stands for that blank.  A task holds one batch of texts
and the ids of one block.

Results by case: null text is empty; an empty text has only the begin and end ids and
decodes to an empty text; the space symbol itself decodes to a blank, as in the library;
ids of any type, null and repeated ones pass through; an empty table gives an empty
result; other columns are ignored.  A vocabulary without byte pieces is an error.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StringType, StructField, StructType

from stratafold.llm.common import checked, text_of

SPACE = "▁"
#: Characters of a block of a long text.
BLOCK = 1 << 18
#: Strings kept in a table, and the characters of the longest.
KEPT, LONGEST = 800_000, 64
_WORDS = re.compile(r" *[^ ]+| +\Z")


class _Kept(dict):
    """String -> its ids as bytes; long strings are not kept, and a full table is emptied."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, string: str) -> bytes:
        ids = self.encode(string)
        if len(string) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[string] = ids
        return ids


class Merges:
    """One vocabulary: encoding, decoding, and the library for comparison."""

    def __init__(self, model: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        size = lib.get_piece_size()
        self.costs: dict[str, float] = {}
        self.ids: dict[str, bytes] = {}
        self.spelled = [b""] * 256
        self.written = [b""] * size
        self.leads = np.zeros(size, bool)
        self.control = np.array([lib.is_control(i) for i in range(size)])
        for i in range(size):
            piece, four = lib.id_to_piece(i), int(i).to_bytes(4, "little")
            if lib.is_byte(i):
                value = int(piece[3:5], 16)
                self.spelled[value], self.written[i] = four, bytes([value])
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.costs[piece], self.ids[piece] = -lib.get_score(i), four
                self.written[i], self.leads[i] = piece.replace(SPACE, " ").encode(), piece.startswith(SPACE)
            elif lib.is_unknown(i):
                self.written[i] = lib.decode([i]).encode()
        if not all(self.spelled):
            raise ValueError(f"{model} has no byte pieces")
        self.begin = int(lib.bos_id()).to_bytes(4, "little")
        self.end = int(lib.eos_id()).to_bytes(4, "little")
        #: Characters that stand side by side in some piece.
        self.bonds = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        #: Whether a blank can be merged with another character before it.
        self.across = any(bond[1] == SPACE != bond[0] for bond in self.bonds)
        self.stretches = _Kept(self._agenda)
        self.words = _Kept(self._word)

    def _agenda(self, stretch: str) -> bytes:
        cost, symbols, n = self.costs.get, list(stretch), len(stretch)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols.append("")
        agenda = []
        for i in range(n - 1):
            pair = stretch[i : i + 2]
            c = cost(pair)
            if c is not None:
                agenda.append((c, i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            if not symbols[i] or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                wider = pair + symbols[k]
                c = cost(wider)
                if c is not None:
                    heapq.heappush(agenda, (c, i, wider))
            h = before[i]
            if h >= 0:
                wider = symbols[h] + pair
                c = cost(wider)
                if c is not None:
                    heapq.heappush(agenda, (c, h, wider))
        out = []
        for symbol in symbols:
            if symbol:
                found = self.ids.get(symbol)
                out += [found] if found else [self.spelled[b] for b in symbol.encode()]
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        """Ids of a string with its blanks, stretch by stretch."""
        marked, bonds, stretches, first, out = word.replace(" ", SPACE), self.bonds, self.stretches, 0, []
        for k in range(1, len(marked)):
            if marked[k - 1 : k + 1] not in bonds:
                out.append(stretches[marked[first:k]])
                first = k
        out.append(stretches[marked[first:]])
        return b"".join(out)

    def _body(self, block: str) -> bytes:
        """Ids of a block behind its leading blank, word by word if no piece crosses into a blank."""
        plain = " " + block.replace(SPACE, " ")
        return self._word(plain) if self.across else b"".join(map(self.words.__getitem__, _WORDS.findall(plain)))

    def blocks(self, text: str) -> Iterator[str]:
        """The text in blocks; all but the first have lost the blank that they began with."""
        first = 0
        while len(text) - first > BLOCK:
            at = text.find(" ", first + BLOCK)
            while at > 0 and (text[at - 1].replace(" ", SPACE) + SPACE) in self.bonds:
                at = text.find(" ", at + 1)
            if at < 0:
                break
            yield text[first:at]
            first = at + 1
        yield text[first:]

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit numbers."""
        if not text:
            return self.begin + self.end
        body = b"".join(self._body(block) for block in self.blocks(text))
        return self.begin + body + self.end

    def decode(self, ids: bytes) -> str:
        """The text of ids; characters are not spelled across control ids."""
        numbers = np.frombuffer(ids, "<u4")
        breaks = [-1, *np.flatnonzero(self.control[numbers]).tolist(), len(numbers)]
        out = []
        for first, last in zip(breaks, breaks[1:], strict=False):
            run = numbers[first + 1 : last].tolist()
            if run:
                written = [self.written[i] for i in run]
                if not out and self.leads[run[0]]:
                    written[0] = written[0][1:]
                out.append(self._valid(b"".join(written)))
        return "".join(out)

    @staticmethod
    def _valid(data: bytes) -> str:
        """As text; every byte that is part of no character becomes the replacement character."""
        out, first = [], 0
        while True:
            try:
                return "".join([*out, data[first:].decode()])
            except UnicodeDecodeError as wrong:
                out += [data[first : first + wrong.start].decode(), "�"]
                first += wrong.start + 1

    def agrees(self, text: str, ids: bytes, decoded: str) -> bool:
        """Whether the library gives the same ids and the same decoded text."""
        at, come = 4, []
        for k, block in enumerate(self.blocks(text)):
            # The library gives an empty block no dummy prefix.
            theirs = self.library.encode(block, num_threads=1) if block or not k else [self.library.piece_to_id(SPACE)]
            same = np.array(theirs, "<u4").tobytes()
            if ids[at : at + len(same)] != same:
                return False
            at += len(same)
            come.append((" " if k else "") + self.library.decode(theirs))
        return ids[at:] == self.end and decoded == "".join(come)


@lru_cache(maxsize=2)
def merges(model: str) -> Merges:
    """The vocabulary in this process."""
    return Merges(model)


def _encoded(batches: Iterator[pa.RecordBatch], model: str, check: bool) -> Iterator[pa.RecordBatch]:
    vocabulary = merges(model)
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            part = batch.slice(first, 512)
            ids, texts, same = [], [], []
            for text in part.column(1).to_pylist():
                ids.append(vocabulary.encode(text))
                texts.append(vocabulary.decode(ids[-1]))
                same.append(vocabulary.agrees(text, ids[-1], texts[-1]) if check else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string()), pa.array(same, pa.bool_())],
                ["doc_id", "ids", "decoded", "agrees"],
            )


def encode(docs: DataFrame, model: str, check: bool = True) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit numbers), decoded, agrees for every row.

    ``agrees`` is null without ``check``.
    """
    rows = checked(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    schema = StructType(
        [
            rows.schema["doc_id"],
            StructField("ids", BinaryType()),
            StructField("decoded", StringType()),
            StructField("agrees", BooleanType()),
        ]
    )
    return rows.mapInArrow(partial(_encoded, model=model, check=check), schema)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, agrees for every row."""
    return encode(docs, model).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "agrees",
    )
