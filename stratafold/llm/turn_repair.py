"""Conversation structure repair as a shortest path, found by an auction.

The rows of a conversation and the states of ``(s?(ua)+)?`` span a lattice: a node is a
position and a state, its arcs are the edits (delete, insert, keep, rerole) with their
integer costs.  Every node has a price, at most the cost of any arc plus the price of its
head.  The auction extends a path from an origin along an arc of equality, or, where there
is none, raises the price at the path's end to the cheapest arc and contracts the path by
that node.  When the path meets the end, or a node settled before, the prices along it are
exact distances.  Every cycle has a positive cost, so paths stay simple.

Prices start from the least cost of the rows still to come.  A long conversation is priced
in blocks of ``BLOCK`` rows from its end, so that prices rise by what a block costs and
not by what the conversation costs: the work is linear in the rows.

The dual prices show which arcs lie on cheapest paths: the tight ones, whose cost is the
difference of the exact prices at their ends.  From the start the tight arc with the least
initial is followed; a head whose price is not exact yet is auctioned first.  In each state
an initial leads to one state only, so this gives the ASCII-least audit and decides the roles.

Rows travel twice.  First as short rows (turn, role, digest, fault) in which equal rows are
one with a number; duplicates are found by grouping, not by a memory of what was seen.  A task
holds a byte for each row of one conversation, as much as the audit that it returns.
Then with their texts, sorted behind the audit of their conversation, to be replayed one by
one: neither repaired rows nor their digest need a conversation's texts in memory.

Results by case: null ids are one conversation; null turns come first, equal turns in the
order of role and text digest; null roles and texts are one space, so such a role fits
nothing and such a text is blank; initials are case-sensitive; a conversation
without rows after the damage has zeros, an empty audit and the digest of an empty text;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import WHITE, checked

BLOCK = 16
#: Cost of an undeleted truncated row, and of the edits.
TRUNCATED, DELETE, INSERT, KEEP, REROLE = 5, 2, 5, 0, 1
#: States: nothing yet, after s, after u, after a; the first and the last may end.
_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
#: The turn that an insertion or a new role brings in each state.
_TURN = {0: "u", 1: "u", 2: "a", 3: "u"}
_ROLE = {"u": "user", "a": "assistant"}
_END, _FORCED = "$", "x"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _arcs(kind: str) -> list[tuple[tuple[str, int, int], ...]]:
    """For each state the edits of a row (or of the end), least initial first: initial, cost, step to the head.

    Nodes are numbered by position and state.  Kinds: the role's initial, upper-case if the
    row is truncated; ``o`` for another role; ``x`` for a row that has to go; ``$`` for the end.
    """
    out = []
    for s in range(4):
        found = [("I", INSERT, _NEXT[s][_TURN[s]] - s)]
        if kind == _END:
            found += [(_END, 0, 4 - s)] if s in (0, 3) else []
        else:
            found.append(("D", DELETE, 4))
            if kind != _FORCED:
                more = TRUNCATED if kind.isupper() else 0
                found.append(("R", REROLE + more, 4 + _NEXT[s][_TURN[s]] - s))
                if kind.lower() in _NEXT[s]:
                    found.append(("K", KEEP + more, 4 + _NEXT[s][kind.lower()] - s))
        out.append(tuple(sorted(found)))
    return out


_ARCS = {kind: _arcs(kind) for kind in "suaoSUAOx$"}
#: What a row costs at least.
_LEAST = {kind: min(cost for s in arcs for initial, cost, _ in s if initial != "I") for kind, arcs in _ARCS.items()}


class _Lattice:
    """The nodes of some rows and the exact prices behind them."""

    def __init__(self, kinds: str, beyond: list[int]):
        self.arcs = [arcs for kind in kinds for arcs in _ARCS[kind]]
        price, self.price = min(beyond), list(beyond)
        for kind in reversed(kinds):
            price += _LEAST[kind]
            self.price[:0] = [price] * 4
        self.settled = bytearray(len(self.arcs)) + b"\1\1\1\1"

    def auction(self, origin: int) -> int:
        """The exact price of a node; all nodes of the path found are settled with it."""
        price, arcs, settled, path = self.price, self.arcs, self.settled, [origin]
        while not settled[path[-1]]:
            i = path[-1]
            least, head = min([(cost + price[i + step], i + step) for _, cost, step in arcs[i]])
            if price[i] < least:
                price[i] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)
        for i in path:
            settled[i] = 1
        return price[origin]

    def trace(self, node: int) -> tuple[str, int]:
        """The least initials along tight arcs to the rows' end, and the state there."""
        out, last = [], len(self.arcs)
        while node < last:
            price = self.auction(node)
            for initial, cost, step in self.arcs[node]:
                if price == cost + self.price[node + step] and price == cost + self.auction(node + step):
                    out.append(initial)
                    node += step
                    break
        return "".join(out), node - last


def _repair(kinds: str) -> tuple[int, str]:
    kinds += _END
    blocks = [kinds[k : k + BLOCK] for k in range(0, len(kinds), BLOCK)]
    beyond = [[0, 0, 0, 0]]
    for block in reversed(blocks[1:]):
        lattice = _Lattice(block, beyond[-1])
        beyond.append([lattice.auction(s) for s in range(4)])
    cost, audit, state = None, [], 0
    for block in blocks:
        lattice = _Lattice(block, beyond.pop())
        cost = lattice.auction(state) if cost is None else cost
        initials, state = lattice.trace(state)
        audit.append(initials)
    return cost, "".join(audit).rstrip(_END)


_short = lru_cache(maxsize=1 << 16)(_repair)


def repair(kinds: str) -> tuple[int, str]:
    """Least cost and least audit for the kinds of a conversation's rows."""
    return _short(kinds) if len(kinds) <= 4 * BLOCK else _repair(kinds)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, times: the rows with the damage done; ``times`` is 0 for dropped ones, 2 for repeated ones."""
    rows = checked(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("string").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
    )
    key = F.concat(F.coalesce("conv", F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("_damage", F.crc32(key.cast("binary")) % 20)
    text = (
        F.when(F.col("_damage") == 1, "")
        .when(F.col("_damage") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    return rows.select(
        "conv",
        "turn",
        F.when(F.col("_damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("_damage") == 0, 0).when(F.col("_damage") == 3, 2).otherwise(1).alias("times"),
    )


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _short_rows(rows: DataFrame) -> DataFrame:
    """conv, turn, role, digest, times, ending (blank, whole, truncated), again (its text was seen at an earlier turn).

    Dropped rows are left as one row with ``times`` 0, so that no conversation is lost.
    """
    bare = F.rtrim("text", F.lit(WHITE))
    ending = F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "w").otherwise("t")
    gone = F.col("times") == 0
    rows = rows.select(
        "conv",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").otherwise(F.col("role")).alias("role"),
        F.when(gone, F.lit(b"")).otherwise(_digest()).alias("digest"),
        F.when(gone, "").otherwise(ending).alias("ending"),
        "times",
    )
    rows = rows.groupBy("conv", "turn", "role", "digest", "ending").agg(F.sum("times").alias("times"))
    several = (
        rows.groupBy("conv", "role", "digest")
        .agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("places"))
        .filter("places > 1")
        .select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first")
    )
    same = (
        F.col("conv").eqNullSafe(F.col("_conv"))
        & (F.col("role") == F.col("_role"))
        & (F.col("digest") == F.col("_digest"))
    )
    again = F.coalesce(F.struct("turn") > F.col("first"), F.lit(False))
    return rows.join(several, same, "left").select("conv", "turn", "role", "digest", "ending", "times", again.alias("again"))


class _Conversation:
    """What is known of one conversation while its short rows pass by: a byte for each row, and counts."""

    def __init__(self, conv: str | None):
        self.conv, self.kinds, self.before = conv, [], None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn: str | None, role: str, ending: str, times: int, again: bool) -> None:
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += times - 1
        self.before = initial
        if turn is not None:
            self.turns += self.high != int(turn)
            self.high = int(turn)
            self.low = self.high if self.low is None else self.low
        if ending == "b" or again:
            self.kinds.append(_FORCED * times)
            self.blank += times if ending == "b" else 0
            self.duplicate += times if ending != "b" else 0
            return
        kind = initial if initial in ("s", "u", "a") else "o"
        self.kinds.append((kind.upper() if ending == "t" else kind) + _FORCED * (times - 1))
        self.truncated += ending == "t"
        self.duplicate += times - 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        cost, audit = repair("".join(self.kinds))
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["conv", *_COUNTS, "audit"]
    now, out = None, []
    for batch in batches:
        for conv, turn, role, ending, times, again in batch.itertuples(index=False, name=None):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.row())
                now = _Conversation(conv)
            if times:
                now.add(turn, role, ending, times, again)
        if out:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if now is not None:
        yield pd.DataFrame([now.row()], columns=columns)


def audits(rows: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit for each conversation of ``damaged`` rows."""
    rows = _short_rows(rows).repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest")
    rows = rows.select("conv", F.col("turn").cast("string").alias("turn"), "role", "ending", "times", "again")
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return rows.mapInPandas(_audit, f"conv string, {counts}, audit string")


def _replayed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[dict | None, list[tuple[str, str]]]]:
    """Conversation by conversation: its audit row, and repaired rows one by one (the audit row only at first)."""
    audit, at, state = "", 0, 0

    def edits(times: int, role: str, text: str) -> Iterator[tuple[str, str]]:
        nonlocal at, state
        while times or (at < len(audit) and audit[at] == "I"):
            edit = audit[at]
            at += 1
            times -= edit != "I"
            if edit != "D":
                initial = role[:1] if edit == "K" else _TURN[state]
                state = _NEXT[state][initial]
                yield (role, text) if edit == "K" else (_ROLE[initial], "" if edit == "I" else text)

    for batch in batches:
        for row in batch.to_dict("records"):
            if row["ord"] == 0:
                audit, at, state = row["audit"], 0, 0
                yield row, list(edits(0, "", ""))
            elif row["times"]:
                yield None, list(edits(int(row["times"]), row["role"], row["text"]))


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, position, out, size = None, 0, [], 0
    for start, rows in _replayed(batches):
        if start is not None:
            conv, position = start["conv"], 0
        for role, text in rows:
            out.append((conv, position, role, text))
            position += 1
            size += len(text)
        if size > 1 << 22 or len(out) > 10_000:
            yield pd.DataFrame(out, columns=["conv", "position", "role", "text"])
            out, size = [], 0
    yield pd.DataFrame(out, columns=["conv", "position", "role", "text"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns, now, hashed, lines, out = ["conv", *_COUNTS, "audit"], None, hashlib.sha256(), 0, []
    for start, rows in _replayed(batches):
        if start is not None:
            if now is not None:
                out.append([*(now[c] for c in columns), hashed.hexdigest()])
            now, hashed, lines = start, hashlib.sha256(), 0
        for role, text in rows:
            hashed.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
            lines += 1
        if len(out) >= 10_000:
            yield pd.DataFrame(out, columns=[*columns, "repaired_sha256"])
            out = []
    if now is not None:
        out.append([*(now[c] for c in columns), hashed.hexdigest()])
    yield pd.DataFrame(out, columns=[*columns, "repaired_sha256"])


def _with_audits(rows: DataFrame) -> DataFrame:
    """Every conversation's audit row, then its rows in their order."""
    texts = rows.filter("times > 0").select(
        "conv",
        F.lit(1).alias("ord"),
        "turn",
        "role",
        _digest().alias("digest"),
        "times",
        "text",
        *[F.lit(0).cast("long").alias(c) for c in _COUNTS],
        F.lit("").alias("audit"),
    )
    heads = audits(rows).select(
        "conv",
        F.lit(0).alias("ord"),
        F.lit(None).cast("long").alias("turn"),
        F.lit("").alias("role"),
        F.lit(b"").alias("digest"),
        F.lit(0).alias("times"),
        F.lit("").alias("text"),
        *_COUNTS,
        "audit",
    )
    both = heads.unionByName(texts).repartition("conv")
    return both.sortWithinPartitions("conv", "ord", "turn", "role", "digest").drop("turn", "digest")


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, position, role, text: the repaired rows of every conversation."""
    kind = conversations.schema["conv_id"].dataType
    rows = _with_audits(damaged(conversations)).mapInPandas(_rows, "conv string, position long, role string, text string")
    return rows.select(F.col("conv").cast(kind).alias("conv_id"), "position", "role", "text")


def report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conversation."""
    kind = conversations.schema["conv_id"].dataType
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    rows = _with_audits(damaged(conversations)).mapInPandas(
        _digests, f"conv string, {counts}, audit string, repaired_sha256 string"
    )
    return rows.select(F.col("conv").cast(kind).alias("conv_id"), *_COUNTS, "audit", "repaired_sha256")
