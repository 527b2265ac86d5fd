"""Encoding, conversation repair and phrases against the library, brute force and SQL."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratafold.llm import phrases, piece_merges, registry, turn_repair
from tests.compare import connect, differences
from tests.llm.conftest import ROWS

PARTS = [" ", "  ", "▁", "▁▁", "a", "th", "the", "é", "😀", "\n", "\t", "\0", "ﬁ", "s>", "<0x0A>", "中", "ا", "12", "...", " a", "\r"]


@pytest.fixture(scope="module")
def merges():
    return piece_merges.merges(registry.PIECES)


class TestPieces:
    def same_as_library(self, merges, text):
        ids = merges.encode(text)
        theirs = merges.library.encode(text, add_bos=True, add_eos=True)
        assert ids == np.array(theirs, "<u4").tobytes(), text
        assert merges.decode(ids) == merges.library.decode(theirs)
        assert merges.agrees(text, ids, merges.decode(ids))

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=3).filter(lambda t: t.isprintable()))))
    def test_any_text(self, merges, parts):
        self.same_as_library(merges, "".join(parts))

    def test_blocks_of_long_texts(self, merges, monkeypatch):
        monkeypatch.setattr(piece_merges, "BLOCK", 20)
        rng = random.Random(5)
        for _ in range(400):
            self.same_as_library(merges, "".join(rng.choices(PARTS, k=rng.randrange(80))))

    def test_without_room_in_the_tables(self, merges, monkeypatch):
        monkeypatch.setattr(piece_merges, "KEPT", 2)
        monkeypatch.setattr(piece_merges, "LONGEST", 3)
        fresh = piece_merges.Merges(registry.PIECES)
        for _, text in ROWS:
            self.same_as_library(fresh, text or "")

    def test_any_ids_decode_as_in_the_library(self, merges):
        rng = random.Random(7)
        pool = [0, 1, 2, 3, 13, 198, 200, 227, 230, 172, 259, 260, 264, 300, 28705, 29000]
        for _ in range(3000):
            ids = rng.choices(pool, k=rng.randrange(9))
            assert merges.decode(np.array(ids, "<u4").tobytes()) == merges.library.decode(ids), ids

    def test_difference_is_told(self, merges):
        ids = merges.encode("two words")
        assert not merges.agrees("two words", ids, "two word")
        assert not merges.agrees("two words", ids[:-4], "two words")
        assert not merges.agrees("two wards", ids, "two words")

    def test_table(self, docs, nothing, merges):
        rows = piece_merges.digests(docs, registry.PIECES).collect()
        want = Counter()
        for i, text in ROWS:
            ids = merges.library.encode(text or "", add_bos=True, add_eos=True)
            digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), merges.library.decode(ids).encode())]
            want[(i, len(ids), *digests, True)] += 1
        assert Counter(tuple(r) for r in rows) == want
        assert piece_merges.digests(nothing, registry.PIECES).count() == 0


def roles_fit(initials):
    return re.fullmatch(r"(s?(ua)+)?", initials) is not None


def cheapest(kinds):
    """All sequences of edits up to a length, by cost and then by initials."""
    best = (10**9, "")
    for most in range(4):
        for places in itertools.combinations_with_replacement(range(len(kinds) + 1), most):
            inserted = Counter(places)
            for edits in itertools.product("DKR", repeat=len(kinds)):
                cost, audit, turns = 0, "", []
                for k in range(len(kinds) + 1):
                    audit += "I" * inserted[k]
                    turns += [None] * inserted[k]
                    cost += 5 * inserted[k]
                    if k == len(kinds):
                        break
                    kind, edit = kinds[k], edits[k]
                    if kind == "x" and edit != "D":
                        cost = 10**9
                        break
                    audit += edit
                    cost += {"D": 2, "K": 0, "R": 1}[edit] + (5 if kind.isupper() and edit != "D" else 0)
                    if edit != "D":
                        turns.append(kind.lower() if edit == "K" else None)
                if (cost, audit) >= best:
                    continue
                # Rows without a fixed role become user or assistant.
                for choice in itertools.product("ua", repeat=turns.count(None)):
                    free = iter(choice)
                    if roles_fit("".join(t or next(free) for t in turns)):
                        best = (cost, audit)
                        break
    return best


class TestTurns:
    def test_auction_against_all_edits(self):
        rng = random.Random(3)
        for size in range(5):
            for _ in range(12 if size else 1):
                kinds = "".join(rng.choices("suaoSUAOx", k=size))
                assert turn_repair.repair(kinds) == cheapest(kinds), kinds

    def test_long_conversations_in_blocks(self, monkeypatch):
        rng = random.Random(4)
        cases = ["".join(rng.choices("suaoSUAOx", k=rng.randrange(200))) for _ in range(60)]
        small = [turn_repair._repair(k) for k in cases]
        monkeypatch.setattr(turn_repair, "BLOCK", 10_000)
        assert small == [turn_repair._repair(k) for k in cases]

    def rows(self):
        rng = random.Random(9)
        texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "ends. ", "a:b\nc.", "Yes."]
        rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool", "User", ""]), rng.choice(texts)) for c in range(60) for t in range(rng.randrange(9))]
        rows += [(None, None, "user", "Hi."), (None, 3, "assistant", None), (7, None, "user", "Yes."), (7, 2, "user", "Yes."), (7, 2, "user", "Yes.")]
        rows += [(1000, t, "user" if t % 2 else "assistant", f"{t % 40} words.") for t in range(400)]
        rows += [(2000, 1, "user", "same.")] * 50 + [(-3, -5, "user", "x."), (-3, 9, "assistant", "y.")]
        return rows

    def test_table_against_sql(self, spark, tmp_path):
        rows = self.rows()
        df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, times long")
        df.repartition(3).write.parquet(str(tmp_path / "conversations"))
        con = connect(str(tmp_path))
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations/*.parquet')")

        def query(spark, folder):
            return turn_repair.report(spark.read.parquet(f"{folder}/conversations"))

        assert differences(spark, con, "op12_turn_repair", query, registry.ORACLES["op12_turn_repair"], str(tmp_path)) is None

    def test_repaired_rows_have_the_reported_digest(self, spark):
        df = spark.createDataFrame(self.rows(), "conv_id long, turn long, role string, text string")
        lines = defaultdict(list)
        for r in turn_repair.repaired(df).orderBy("position").collect():
            assert r.position == len(lines[r.conv_id])
            lines[r.conv_id].append((r.role, r.text))
        report = turn_repair.report(df).collect()
        assert {r.conv_id for r in report} == {r[0] for r in self.rows()}
        for r in report:
            got = lines[r.conv_id]
            assert roles_fit("".join(role[:1] for role, _ in got))
            assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in got).encode()).hexdigest() == r.repaired_sha256
            assert len(got) == sum(r.audit.count(c) for c in "IKR")

    def test_damage(self, spark):
        rows = [(c, t, "assistant", "One. Two! Three? four") for c in range(30) for t in (0, 1, None)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        for r in turn_repair.damaged(df).collect():
            h = zlib.crc32(f"{r.conv}:{' ' if r.turn is None else r.turn}".encode()) % 20
            assert r.times == {0: 0, 3: 2}.get(h, 1)
            assert r.role == ("user" if h == 4 else "assistant")
            assert r.text == {1: "", 2: "One Two Three four"}.get(h, "One. Two! Three? four")

    def test_empty(self, spark):
        df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
        assert turn_repair.report(df).count() == turn_repair.repaired(df).count() == 0


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def best_phrases(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found, scored = {p: a for p, a in f.items() if 2 <= len(p) and a >= least}, []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, _, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return Counter(out)


class TestPhrases:
    def texts(self):
        rng = random.Random(11)
        words = ["a", "B", "the", "é", "Ünd", "x" * 30, "new", "york", "city", "hall", "of", "to"]
        rows = []
        for k in range(60):
            text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in rng.choices(words, [9, 9, 9, 1, 1, 1, 4, 4, 4, 4, 3, 3], k=rng.randrange(60)))
            rows.append((rng.choice(["en", "de", None, "und"]), text + " New York City Hall of" * rng.randrange(3)))
        return [*rows, ("en", None), (None, ""), ("fr", "only three words"), ("en", "to be  or not " * 300), ("xx", "...")]

    def frame(self, spark, rows):
        df = spark.createDataFrame([(i, *r, "z", 3, 4) for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string, size long, n long")
        return df.repartition(3)

    @pytest.mark.parametrize("least,top", [(3, 2000), (8, 7)])
    def test_brute_force(self, spark, least, top):
        rows = self.texts()
        got = phrases.collocations(self.frame(spark, rows), least, top, bits=1 << 12)
        assert Counter(tuple(r) for r in got.collect()) == best_phrases(rows, least, top)

    def test_colliding_fingerprints_and_small_blocks(self, spark, monkeypatch):
        """Fingerprints of four bits: nearly every n-gram collides, and counts stay exact."""
        rows = self.texts()
        monkeypatch.setattr(phrases, "BLOCK", 40)
        monkeypatch.setattr(phrases, "ENTRIES", 30)
        want = Counter()
        batch = [(("und" if lang is None else lang), (text or "").encode()) for lang, text in rows]
        maps = [np.full(1, ~np.uint64(0))] * 4

        class Sent:
            value = maps

        for part in phrases._count_phrases(iter([pd.DataFrame(batch, columns=["lang", "text"])]), Sent, 15):
            for lang, size, phrase, times in part.itertuples(index=False, name=None):
                want[(lang, size, phrase.decode())] += times
        brute = Counter()
        for lang, text in rows:
            for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
                words = re.findall(r"[^ \t]+", piece)
                brute[("und" if lang is None else lang, 0, "")] += len(words)
                for n in range(1, 5):
                    brute.update(("und" if lang is None else lang, n, " ".join(words[i : i + n])) for i in range(len(words) - n + 1))
        assert +want == +brute

    def test_each_core_sends_a_phrase_once(self, spark, monkeypatch):
        """However many files there are, and in slices of any size."""
        rows = [("en", "one two three four five. ")] * 64
        df = spark.createDataFrame(rows, "lang string, text string").repartition(32)
        plan = phrases.phrase_counts(df, 5)._jdf.queryExecution().executedPlan().toString()
        assert f"Coalesce {spark.sparkContext.defaultParallelism}" in plan
        table, one = phrases._Table("en"), phrases.Block(b"a b a b c", "en")
        table.add(one, [np.full(1, ~np.uint64(0))] * 4)
        whole = pd.concat(table.rows())
        monkeypatch.setattr(phrases, "SLICE", 2)
        parts = list(table.rows())
        assert max(map(len, parts)) == 2 and Counter(pd.concat(parts).itertuples(index=False, name=None)) == Counter(
            whole.itertuples(index=False, name=None)
        )

    def test_no_level_loses_a_frequent_phrase(self, spark):
        rows = [("en", "one two three four five. ")] * 5 + [("en", "one two three")] * 4
        got = phrases.phrase_counts(self.frame(spark, rows), 5).filter("size > 0")
        found = {(r.size, r.phrase): r.times for r in got.collect()}
        assert found[(4, "two three four five")] == 5 and found[(3, "one two three")] == 9
        assert len(found) == 5 + 4 + 3 + 2

    def test_nothing(self, spark, nothing):
        assert phrases.collocations(nothing).count() == 0
        assert phrases.collocations(self.frame(spark, [(None, None), ("en", "")])).count() == 0


@pytest.mark.parametrize("name", ["op12_turn_repair", "op13_collocations"])
def test_registered_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert differences(spark, connect(folder), name, registry.QUERIES[name], registry.ORACLES[name], folder) is None


def test_one_language_over_all_tasks(spark, docs):
    """The counts do not depend on how rows lie in tasks."""
    one = phrases.phrase_counts(docs.withColumn("lang", F.lit("en")).repartition(1), 2).collect()
    many = phrases.phrase_counts(docs.withColumn("lang", F.lit("en")).repartition(7), 2).collect()
    assert Counter(one) == Counter(many)
