from __future__ import annotations

import re

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^ \t-\r]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None) -> set[tuple[str, ...]]:
    found = words((text or "").translate(LOWER))
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


_A = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bend tonight"
_LONG = " ".join(f"w{i % 977}x{i // 3}" for i in range(6000))


#: Ids, texts: copies, near copies, shared passages, nulls, empties, ties, repeats, odd characters, a long text.
ROWS = [
    (1, _A),
    (2, _A),
    (3, _A + " "),
    (4, _A.replace("seven", "eight")),
    (5, "intro words go here " + _A + " and then an ending of another kind"),
    (6, None),
    (7, ""),
    (8, " \t\n "),
    (9, "one"),
    (10, "One two three"),
    (11, "one two THREE"),
    (12, _LONG),
    (13, _LONG + " tail"),
    (14, "é😀 ünïcode wörds héré " * 12),
    (15, "aaaa" * 120),
    (16, "a b " * 60),
    (17, "mail me at jo.do@mail.example.com or +1 (555) 010-9999, card 4111 1111 1111 1111, host 10.0.0.255 and 300.1.1.1"),
    (None, _A),
    (None, "a text without an id"),
    (19, _A.upper()),
    (20, "x"),
    (20, "x"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The rows with columns whose names clash with those operators use."""
    table = [(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 5 else None, len(t or ""), k, "z") for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(
        table,
        "doc_id long, text string, lang string, source string, n_chars long, cell long, value string",
    ).repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
