"""Every operator against brute force on small tables of awkward rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.llm import (
    anchors,
    exact_dedup,
    fingerprint,
    html_text,
    line_crf,
    mixing,
    near_dedup,
    packing,
    pii,
    registry,
    suffix_dedup,
    superkmer_dedup,
)
from stratafold.llm.components import components
from tests.llm.conftest import ROWS, shingles, words

BIG = 1 << 62


def in_order():
    return sorted(((BIG if i is None else i), t or "") for i, t in ROWS)


def counted(rows):
    out = defaultdict(int)
    for row in rows:
        out[tuple(row)] += 1
    return dict(out)


class TestExact:
    def test_brute_force(self, docs):
        groups = defaultdict(list)
        for i, t in ROWS:
            bare = re.sub(r"[ \t-\r]", "", t or "")
            groups[bare].append((-len(t or ""), i is None, i or 0, i))
        want = []
        for i, t in ROWS:
            bare = re.sub(r"[ \t-\r]", "", t or "")
            keep = min(groups[bare])[3]
            want.append((i, keep, len(groups[bare]), i == keep, hashlib.sha256(bare.encode()).hexdigest()))
        for support in (0.001, 0.2):
            assert counted(exact_dedup.exact_dedup(docs, support).collect()) == counted(want)

    def test_pipeline_form_and_empty(self, docs, nothing):
        kept = exact_dedup.keep_exact(docs)
        assert kept.columns == docs.columns
        assert exact_dedup.exact_dedup(nothing).count() == 0

    def test_columns_called_like_helpers(self, spark, nothing):
        names = "row own_sha256 _own_sha256 _keep _sha256 _repeated text_sha256 chars kept keep_id group_size heavy_sha256".split()
        rows = [(k // 2, "t" * (k // 4), *[f"{n}{k}" for n in names]) for k in range(24)]
        some = spark.createDataFrame(rows, ["doc_id", "text", *names])
        out = exact_dedup.keep_exact(some)
        assert out.columns == some.columns
        found = sorted(tuple(r) for r in out.collect())
        assert [r[1] for r in found] == ["t" * n for n in range(6)] and all(r in rows for r in found)
        assert exact_dedup.keep_exact(nothing).count() == 0

    def test_one_row_of_each_group_stays(self, spark, docs):
        more = [(30, "a b", 1), (30, "c", 2), (31, "ab", 3), (31, "c", 4), (32, "d e", 5), (32, "de", 6), (None, "f", 7), (None, "f", 8)]
        df = spark.createDataFrame(more, "doc_id long, text string, n long")
        rows = {(r.doc_id, r.text, r.n) for r in exact_dedup.keep_exact(df).collect()}
        # 31 loses with "ab" and "c"; 32 keeps its longer text.
        assert rows == {(30, "a b", 1), (30, "c", 2), (32, "d e", 5), (None, "f", 7)}
        groups = defaultdict(list)
        for i, t in ROWS:
            groups[re.sub(r"[ \t-\r]", "", t or "")].append((-len(t or ""), i is None, i or 0, i, t))
        want = [min(g, key=lambda x: x[:3])[3] for g in groups.values()]
        assert counted((r.doc_id,) for r in exact_dedup.keep_exact(docs).collect()) == counted((i,) for i in want)
        # An id that wins with one text does not save its losing text.
        lost = spark.createDataFrame([(1, "x", 0), (2, "x", 0), (2, "y", 0)], "doc_id long, text string, n long")
        assert {(r.doc_id, r.text) for r in exact_dedup.keep_exact(lost).collect()} == {(1, "x"), (2, "y")}


def removed(text, size, first_of, me):
    mark = np.zeros(len(text) + 1, int)
    for p in range(len(text) - size + 1):
        if first_of[tuple(text[p : p + size])] < me(p):
            mark[p] += 1
            mark[p + size] -= 1
    return np.cumsum(mark)[: len(text)] > 0


class TestSubstrings:
    @pytest.mark.parametrize("hot", [4000, 1])
    def test_bytes(self, docs, hot):
        first, rows = {}, in_order()
        for k, (i, t) in enumerate(rows):
            data = t.encode()
            for p in range(len(data) - 99):
                first.setdefault(tuple(data[p : p + 100]), (i, k, p))
        want = []
        for k, (i, t) in enumerate(rows):
            data = t.encode()
            gone = removed(data, 100, first, lambda p, i=i, k=k: (i, k, p))
            spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            rest = bytes(b for b, g in zip(data, gone, strict=True) if not g)
            want.append((None if i == BIG else i, len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
        assert counted(suffix_dedup.repeat_report(docs, hot).collect()) == counted(want)

    @pytest.mark.parametrize("hot", [4000, 1])
    def test_words(self, docs, hot):
        first, rows = {}, in_order()
        for i, t in rows:
            w = words(t)
            for p in range(len(w) - 12):
                first.setdefault(tuple(w[p : p + 13]), i)
        want = []
        for i, t in rows:
            w = words(t)
            gone = removed(w, 13, first, lambda p, i=i: i)
            rest = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
            want.append((None if i == BIG else i, len(w), int(gone.sum()), hashlib.sha256(rest.encode()).hexdigest()))
        assert counted(superkmer_dedup.repeat_report(docs, hot).collect()) == counted(want)

    def test_spans_rebuild_the_rest(self, docs):
        for row in suffix_dedup.remove_repeats(docs).collect():
            assert sum(b - a for a, b in row.spans) == row.n_removed
            assert hashlib.sha256(bytes(row.kept)).hexdigest() == row.kept_sha256

    def test_empty(self, nothing):
        assert suffix_dedup.repeat_report(nothing).count() == 0
        assert superkmer_dedup.repeat_report(nothing).count() == 0

    def test_refinement_sorts_suffixes(self):
        rng = np.random.default_rng(3)
        symbols = np.concatenate([rng.integers(1, 3, 400), [0], rng.integers(1, 3, 300), [0]]).astype(np.int16)
        order, _ = suffix_dedup.refine(symbols, 100)
        wide = np.concatenate([symbols, np.zeros(120, np.int16)])
        heads = [tuple(wide[k : k + 100]) for k in order]
        assert heads == sorted(heads)

    def test_anchor_depends_on_the_window_only(self):
        rng = np.random.default_rng(4)
        text = rng.integers(97, 100, 700).astype(np.uint8)
        whole = anchors.stretches([text], 100, 24)
        part = anchors.stretches([text[150:450]], 100, 24)
        of = lambda s: {int(a) + k: h for a, n, h in zip(s.start, s.count, s.anchor, strict=True) for k in range(n)}
        assert all(of(whole)[k + 150] == h for k, h in of(part).items())


class TestNear:
    def test_brute_force(self, docs):
        nodes = defaultdict(list)
        for i, t in ROWS:
            nodes[BIG if i is None else i].append(shingles(t))
        up = {i: i for i in nodes}

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for i in nodes:
            for j in nodes:
                for a in nodes[i]:
                    for b in nodes[j]:
                        if a and b and 100 * len(a & b) >= 75 * len(a | b):
                            x, y = root(i), root(j)
                            up[max(x, y)] = min(x, y)
        want = []
        for i, t in ROWS:
            node = BIG if i is None else i
            top = root(node)
            want.append((i, len(shingles(t)), None if top == BIG else top, node == top))
        assert counted(near_dedup.near_groups(docs).collect()) == counted(want)

    def test_graded_copies(self, spark):
        """Copies of two texts with few or many words changed, added or left out, and a shared passage."""
        rng = np.random.default_rng(8)
        bases = [[f"b{k}w{i}" for i in range(90)] for k in range(2)]
        passage, texts = [f"p{i}" for i in range(30)], []
        for k in range(140):
            text = list(bases[k % 2][: int(rng.integers(60, 91))])
            for _ in range(int(rng.integers(0, 6))):
                at = int(rng.integers(len(text)))
                text[at : at + int(rng.integers(0, 2))] = [f"e{int(rng.integers(12))}"] * int(rng.integers(0, 2))
            texts.append(" ".join(text + passage * (k % 5 == 0)))
        sets, up = [shingles(t) for t in texts], list(range(len(texts)))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 100 * len(a & b) >= 75 * len(a | b):
                    x, y = root(i), root(j)
                    up[max(x, y)] = min(x, y)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found = {r.doc_id: r.component_id for r in near_dedup.near_groups(df).collect()}
        assert found == {i: root(i) for i in range(len(texts))}
        assert 2 < len(set(found.values())) < len(texts)

    def test_empty_and_pipeline_form(self, docs, nothing):
        assert near_dedup.near_groups(nothing).count() == 0
        assert near_dedup.keep_one(docs).columns == docs.columns

    def test_rows_that_share_an_id_or_have_none(self, spark):
        text = " ".join(f"t{i}" for i in range(60))
        other, third = " ".join(f"o{i}" for i in range(60)), " ".join(f"p{i}" for i in range(60))
        rows = [(1, text, "a"), (None, text + " x", "b"), (None, other, "c"), (2, text + " y", "d"), (2, third, "e")]
        df = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(2)
        kept = near_dedup.keep_one(df)
        assert kept.columns == df.columns
        assert sorted(r.node for r in kept.collect()) == ["a", "c", "e"]
        some = [(5, text, "a"), (-7, text + " x", "b"), (-7, None, "c"), (None, None, "d"), (None, "", "e"), (3, other, "f")]
        df = spark.createDataFrame(some, "doc_id long, text string, _gone string")
        assert sorted(r["_gone"] for r in near_dedup.keep_one(df).collect()) == ["b", "c", "d", "e", "f"]

    def test_open_pairs_grow_with_the_family(self, spark, monkeypatch):
        """Relatives of one text, none a near copy of another: pairs in proportion, not to the square."""
        made, inner = [], near_dedup._open_pairs
        monkeypatch.setattr(near_dedup, "_open_pairs", lambda *a: made.append(inner(*a)) or made[-1])
        for share in (0.2, 0.35):
            counts = []
            for size in (200, 400, 800):
                rng = np.random.default_rng(size)
                base, texts = [f"b{i}" for i in range(200)], []
                for k in range(size):
                    text = list(base)
                    for block in rng.choice(20, int(20 * share), replace=False):
                        text[block * 10 : block * 10 + 10] = [f"k{k}x{block}y{i}" for i in range(10)]
                    texts.append(" ".join(text))
                df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
                assert {r.component_id for r in near_dedup.near_groups(df).collect()} == set(range(size))
                counts.append(made.pop().count())
            assert counts[2] <= max(5 * counts[0], 800), counts

    def test_relatives_that_share_their_edits_make_few_pairs(self, spark, monkeypatch):
        """Members of one family below the threshold that have edits in common: few pairs, the same groups."""
        made, inner = [], near_dedup._open_pairs
        monkeypatch.setattr(near_dedup, "_open_pairs", lambda *a: made.append(inner(*a)) or made[-1])
        rng, texts = np.random.default_rng(5), []
        for k in range(300):
            text = [f"b{i}" for i in range(200)]
            for block in rng.choice(20, 4, replace=False):
                text[block * 10 : block * 10 + 10] = [f"v{rng.integers(3)}x{block}y{i}" for i in range(10)]
            texts.append(" ".join(text))
        sets = [shingles(t) for t in texts]
        linked = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
        near = [(i, j) for i in range(300) for j in range(i) if linked(sets[i], sets[j])]
        smallest = list(range(300))
        for _ in range(300):
            before = list(smallest)
            for i, j in near:
                smallest[i] = smallest[j] = min(smallest[i], smallest[j])
            if smallest == before:
                break
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in near_dedup.near_groups(df).collect()} == dict(enumerate(smallest))
        assert made.pop().count() <= len(near) + 300

    def test_tasks_hold_the_sets_of_a_slice(self):
        """A batch of many texts, or of texts beyond a slice, leaves bit by bit, with the sets of each row."""
        import pyarrow as pa

        many = [" ".join(f"m{k}x{i}" for i in range(300)) for k in range(2000)]
        few = [" ".join(f"f{k}x{i}" for i in range(200_000)) for k in range(3)]
        for texts, runs in ((many, 3), (few, 3), (["", "one", many[0]], 1), ([], 0)):
            n = len(texts)
            ids, tx = pa.array(range(n), pa.int64()), pa.array([t.encode() for t in texts], pa.binary())
            ty = pa.array([texts[k // 2 * 2].encode() for k in range(n)], pa.binary())
            hubs = pa.array([k // 2 * 2 for k in range(n)], pa.int64())
            found = list(near_dedup._sketches(iter([pa.record_batch([ids, tx], ["node", "text"])])))
            assert len(found) >= runs and [x for r in found for x in r["node"].to_pylist()] == list(range(n))
            assert [x for r in found for x in r["n"].to_pylist()] == [len(shingles(t)) for t in texts]
            pairs = pa.record_batch([ids, hubs, tx, ty], ["a", "h", "tx", "ty"])
            rows = [x for r in near_dedup._meet(iter([pairs])) for x in r.to_pylist()]
            both = [(shingles(t), shingles(texts[k // 2 * 2])) for k, t in enumerate(texts)]
            assert [(r["a"], r["n"], r["nh"], r["shared"], len(r["extra"])) for r in rows] == [
                (k, len(x), len(y), len(x & y), len(x - y)) for k, (x, y) in enumerate(both)
            ]
            assert len(list(near_dedup._meet(iter([pairs])))) >= runs
            kept = [x for r in near_dedup._confirm(iter([pairs.rename_columns(["a", "b", "tx", "ty"])])) for x in r["a"].to_pylist()]
            assert kept == [k for k, (x, y) in enumerate(both) if x and 100 * len(x & y) >= 75 * len(x | y)]

    def test_components(self, spark):
        edges = [(i + 1, i) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
        found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
        assert {found[i] for i in range(41)} == {0} and {found[i] for i in (100, 101, 102)} == {100}


class TestPacking:
    def test_added_tokens_in_any_spelling(self):
        """An added token is one id only as the vocabulary writes it; other spellings are ordinary text."""
        from tokenizers import Tokenizer

        model, tokens = Tokenizer.from_file(registry.TOKENIZER), packing.Tokens(registry.TOKENIZER)
        texts = []
        for token in ("<|endoftext|>", "<|startoftext|>"):
            for form in (token, token.upper(), token.title()):
                texts += [form, f"A {form} b", f"x{form}Y", f"{form}{form},", f"<{form}.", f"end{form}."]
        texts += ["a<b", "IF x<Y THEN", "<P>Hello, World.</P>", "|<|", "1<2,"]
        got = [ids.tolist() for ids in tokens.encode(texts)]
        assert got == [model.encode(t, add_special_tokens=False).ids for t in texts]

    def test_round_trip(self, docs):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(registry.TOKENIZER)
        want = defaultdict(int)
        for i, t in ROWS:
            want[i, tuple([*model.encode(t or "", add_special_tokens=False).ids, 1])] += 1
        for limits in (packing.Limits(), packing.Limits(tokens=64, segments=3, loss=40)):
            rows = packing.pack(docs, registry.TOKENIZER, limits).collect()
            ids = lambda r: np.frombuffer(r.ids, "<u4").tolist()
            by_doc, by_sequence = defaultdict(list), defaultdict(list)
            for r in rows:
                by_doc[r.doc_id].append(r)
                by_sequence[r.sequence_id].append(r)
            tokens = defaultdict(int)
            for (i, full), n in want.items():
                tokens[i] += n * len(full)
            assert {i: sum(r.length for r in p) for i, p in by_doc.items()} == dict(tokens)
            for (i, full), n in want.items():
                if len(by_doc[i]) and n == 1 and sum(k == i for k, _ in want) == 1:
                    pieces = sorted(by_doc[i], key=lambda r: r.start)
                    assert [x for r in pieces for x in ids(r)] == list(full)
            for pieces in by_sequence.values():
                pieces.sort(key=lambda r: r.offset)
                assert [r.offset for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
                assert sum(r.length for r in pieces) <= limits.tokens
                assert len(pieces) <= limits.segments and sum(r.loss_tokens for r in pieces) <= limits.loss

    def test_prompt_bears_no_loss(self, spark):
        df = spark.createDataFrame([(1, "an answer", "a question of five words"), (2, None, None)], "doc_id long, text string, q string")
        rows = packing.pack(df, registry.TOKENIZER, prompt="q").collect()
        assert sum(r.loss_tokens for r in rows if r.doc_id == 1) == 3
        assert sum(r.length for r in rows if r.doc_id == 2) == 1

    def test_empty(self, nothing):
        assert packing.pack(nothing, registry.TOKENIZER).count() == 0

    def test_words_give_the_ids_of_texts(self):
        odd = ["İstanbul ΑΣ ας. ß ẞ don't I'm it's, end.. a,b é café ﬁ １２", " x\xa0y\x85z\t\tw\r\n", "é, É. ŉ ſ", "", ".", "a.", "中文. ーabc,"]
        tokens = packing.Tokens(registry.TOKENIZER)
        want = [e.ids for e in tokens.model.encode_batch(odd, add_special_tokens=False)]
        assert [x.tolist() for x in tokens.encode(odd)] == want


class TestMixing:
    def test_targets_are_met(self, docs):
        rows = mixing.mix(docs, carry=("source",)).collect()
        assert len(rows) == len(ROWS)
        by = defaultdict(list)
        for r in rows:
            by[r.source].append(r)
        for part in by.values():
            assert {r.source_size for r in part} == {sum(r["size"] for r in part)}
            assert abs(sum(r.taken for r in part) - part[0].target) <= 2
            assert all(r.taken <= 2 * r["size"] for r in part)
        again = {(r.doc_id, r["size"], r.taken) for r in mixing.mix(docs.repartition(5), carry=("source",)).collect()}
        assert again == {(r.doc_id, r["size"], r.taken) for r in rows}

    def test_water_filling(self):
        sizes = np.array([100, 1000, 5000, 10, 0])
        target = mixing.targets(sizes, (5.0, 2.0, 1.0), 1.5, 2.0)
        assert (target <= 2 * sizes + 1e-9).all() and abs(target.sum() - 1.5 * sizes.sum()) < 1e-6

    def test_quotas_are_exact(self):
        quotas = np.array([100, 7, 0, 1300])
        leaves = mixing.split_quotas(quotas, 10, 1)
        assert (leaves.sum(axis=0) == quotas).all() and (leaves >= 0).all()
        assert (leaves == mixing.split_quotas(quotas, 10, 1)).all()
        assert abs(leaves.sum(axis=1) - quotas.sum() / 10).max() <= 2

    def test_mixed_rows(self, docs, nothing):
        out = mixing.mixed(docs)
        assert out.columns == docs.columns
        assert sum(len(words(r.text)) for r in out.collect()) == sum(r.taken for r in mixing.mix(docs).collect())
        assert mixing.mix(nothing).count() == 0

    def test_whole_documents(self, spark, docs):
        rows = mixing.mix(docs, carry=("source",), whole=True).collect()
        assert all(c.words == r["size"] for r in rows for c in r.copies)
        by = defaultdict(list)
        for r in rows:
            by[r.source].append(r)
        for part in by.values():
            assert abs(sum(r.taken for r in part) - part[0].target) <= max(r["size"] for r in part) / 2 + 1
        texts = counted((r.text,) for r in docs.collect())
        assert all((r.text,) in texts for r in mixing.mixed(docs, whole=True).collect())
        # Rows without an id share 32 bits of hash; only their texts part them.
        same = spark.createDataFrame([(None, f"a b w{k}", f"s{k % 2}") for k in range(400)], "doc_id long, text string, source string")
        for part in ("s0", "s1"):
            rows = mixing.mix(same, carry=("source",), whole=True).filter(F.col("source") == part).collect()
            assert abs(sum(r.taken for r in rows) - rows[0].target) <= 2

    def test_columns_called_like_helpers(self, spark, nothing):
        names = "size taken target source_size copies copy row shard turn words extra passes rest _source _size _turn _stop _left _here _shard _order".split()
        rows = [(k, f"a b w{k}", f"s{k % 3}", *[f"{n}{k}" for n in names]) for k in range(60)]
        some = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
        plain = mixing.mixed(some.select("doc_id", "text", "source"), whole=True)
        out = mixing.mixed(some, whole=True)
        assert out.columns == some.columns
        found = out.collect()
        assert all(tuple(r) == rows[r.doc_id] for r in found)
        assert counted((r.doc_id,) for r in found) == counted((r.doc_id,) for r in plain.collect())
        assert mixing.mix(some).count() == 60 and mixing.mixed(nothing).count() == 0
        for refused in (lambda: mixing.dealt(some), lambda: mixing.mix(some, carry=("taken",))):
            with pytest.raises(ValueError):
                refused()

    def test_registered_mix_cuts_no_text(self, spark, sf_dir):
        import corpus_pipeline

        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        assert registry.op6_mixing(spark, sf_dir).filter("size > 0 and taken % size <> 0").count() == 0
        assert corpus_pipeline.weighted_mix(spark, docs, sf_dir).join(docs, ["doc_id", "text"], "left_anti").count() == 0

    def test_shards_are_dealt_by_quota(self, spark, monkeypatch):
        made, split = [], mixing.split_quotas
        monkeypatch.setattr(mixing, "split_quotas", lambda *a: made.append(split(*a)) or made[-1])
        some = spark.createDataFrame([(k, "a b c", f"s{k % 2}") for k in range(8000)], "doc_id long, text string, source string")
        block = {r.doc_id: r._block for r in mixing._placed(some, 17).withColumn("_block", mixing._block()).collect()}
        shard_of = defaultdict(set)
        for r in mixing.mix(some, shards=10, carry=("source",)).collect():
            for k, c in enumerate(r.copies):
                shard_of[r.source, k, block[r.doc_id]].add(c.shard)
        assert all(len(x) == 1 for x in shard_of.values())
        drawn = np.zeros_like(made[0])
        for (source, _, _), (shard,) in shard_of.items():
            drawn[shard, int(source[1])] += 1
        assert (drawn == made[0]).all()

    @pytest.mark.parametrize("partitions", ["4", "12"])
    def test_mix_lies_in_shards(self, spark, partitions):
        some = spark.createDataFrame([(k, f"a b {k}", f"s{k % 2}") for k in range(2000)], "doc_id long, text string, source string")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            rows = mixing.dealt(some, shards=5).withColumn("_part", F.spark_partition_id()).collect()
            lies = mixing.mixed(some, shards=5).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert [(r._part, r._shard, r._order) for r in rows] == sorted((r._part, r._shard, r._order) for r in rows)
        assert [(r._shard, r._order) for r in rows] == sorted((r._shard, r._order) for r in rows)
        assert len({r._part for r in rows}) == (5 if partitions == "4" else 10)
        assert [r.doc_id for r in lies] == [r.doc_id for r in rows] != sorted(r.doc_id for r in rows)
        want = sorted((r.doc_id, c.shard, c.turn) for r in mixing.mix(some, shards=5).collect() for c in r.copies)
        assert sorted((r.doc_id, r._shard, r._order) for r in rows) == want


class TestPii:
    def test_brute_force(self, docs, nothing):
        rows = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.report(docs).collect()}
        assert rows == {(i, *base(t or "")) for i, t in ROWS}
        assert pii.report(nothing).count() == 0

    def test_odd_texts(self, spark):
        odd = [
            "a@b.com_x@y.org.", "foo@bar@baz.com a.b@c.d.e. x@y", "1.2.3.4.5.6.7.8 999.1.1.1 00001.2.3.255",
            "4111 1111-1111 1111x 4111111111111111111 1", "+1 (234) 555-6789 +12 +1(((((5 ++1234567890 +4412345678",
            "é😀 a@b.co 😀+1 234 567 890 😀1.1.1.1", "aaaa" * 500 + "@x.y " + "1" * 900, "x@1.2.3.4 5@6.7",
        ]
        df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
        for r in pii.report(df).collect():
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == base(odd[r.doc_id])

    def test_patterns_find_what_no_form_matches(self, spark):
        texts = [f"please call my number +1 234 567 89{k:02d} thanks {k}" for k in range(6)]
        texts += ["please call my number 234 567 8907 thanks", "the house at 234 567 8907 stands", "please call my number the house"]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
        assert spans[6] == "phone:22:34" and spans[7] == "" and spans[8] == ""
        # Copies of one document are no support.
        copies = spark.createDataFrame([(k, texts[0]) for k in range(6)] + [(6, texts[6])], "doc_id long, text string")
        assert {r.doc_id: r.spans for r in pii.report(copies).collect()}[6] == ""


def base(text):
    def luhn(d):
        return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda v: re.sub("[^0-9]", "", v)
    forms = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    ]
    counts, spans = [], []
    for kind, form, good in forms:
        found = [m for m in re.finditer(form, text) if good(m[0])]
        counts.append(len(found))
        spans += [f"{kind}:{m.start()}:{m.end()}" for m in found]
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest())


class TestFingerprints:
    def test_edits_and_likeness(self, spark, docs, nothing):
        texts = [t or "" for _, t in in_order()]
        unique = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = sorted(fingerprint.compare_with_edits(unique).collect(), key=lambda r: r.doc_id)
        prints = {}
        for k, (t, r) in enumerate(zip(texts, rows, strict=True)):
            follower = texts[(k + 1) % len(texts)]
            edited = t[: len(t) - len(t) // 2] + follower[: len(t) // 2]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
            assert prints.setdefault(t, r.fingerprint) == r.fingerprint
            a, b = shingles(t), shingles(edited)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(r.near_edited - true) < 0.2
        assert fingerprint.compare_with_edits(docs).count() == len(ROWS)
        assert fingerprint.compare_with_edits(nothing).count() == 0

    def test_ranges_change_nothing(self, docs):
        ids = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
        whole = fingerprint.with_next(ids).select("doc_id", "next_text").collect()
        parts = fingerprint.with_next(ids, range_rows=4).select("doc_id", "next_text").collect()
        assert counted(whole) == counted(parts)


class TestQuality:
    def test_held_out_accuracy(self, spark, sf_dir):
        docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
        rows = line_crf.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
        assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)

    def test_every_row_has_a_score(self, spark, docs, nothing):
        labels = spark.createDataFrame([(1, 1, 0), (12, 1, 0), (15, 0, 0), (16, 0, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
        rows = line_crf.classify(docs, labels).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
        by_text = defaultdict(set)
        for i, t in ROWS:
            by_text[t or ""].update(r.score for r in rows if r.doc_id == i and i not in (None, 20))
        assert all(len(v) <= 1 for v in by_text.values())
        assert {r.score for r in line_crf.classify(docs, labels.limit(0)).collect()} == {0.5}
        assert line_crf.classify(nothing, labels).count() == 0
        assert line_crf.keep_good(docs, labels).columns == docs.columns

    def test_marginals_match_enumeration(self):
        rng = np.random.default_rng(0)
        emit, move, firsts = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 4, 5])
        p, _ = line_crf._marginals(emit, move, firsts)
        for a, b in ((0, 4), (4, 5), (5, 7)):
            total, good = 0.0, np.zeros(b - a)
            for code in range(1 << (b - a)):
                y = [code >> k & 1 for k in range(b - a)]
                weight = np.exp(sum(emit[a + k] * y[k] for k in range(b - a)) + sum(move[y[k], y[k + 1]] for k in range(b - a - 1)))
                total += weight
                good += weight * np.array(y)
            assert np.allclose(p[a:b], good / total)


class TestPages:
    @pytest.fixture(scope="class")
    @classmethod
    def labeller(cls):
        import duckdb

        pages = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet' order by page_id limit 80").fetchall()
        return html_text.fit(*html_text.training_set([p[0] for p in pages]), rounds=200)

    def test_articles(self, spark, labeller):
        pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
        wrong = 0
        html = {r.page_id: r.html for r in pages.collect()}
        for r in html_text.extract(pages, labeller).collect():
            body = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
            parts = [" ".join(html_text.html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
            wrong += r.text != "\n\n".join(p for p in parts if p)
            assert r.n_chars == len(r.text)
        assert wrong <= 2

    def test_other_layouts(self, labeller):
        page = (
            '<body><header><p>Site name</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><main><h2>A title</h2>'
            "<p>The first paragraph of the text is here.</p><p>And a second one follows it.</p></main>"
            '<div class="comments"><p>Nice, thanks a lot!</p></div><footer><p>&copy; 2020</p></footer></body>'
        )
        found = html_text.blocks(page)
        p = labeller.probabilities([html_text.features(found)])[0]
        good = [b.text for b, q in zip(found, p, strict=True) if q >= 0.5]
        assert "The first paragraph of the text is here." in good and "Nice, thanks a lot!" not in good and "Home" not in good

    def test_awkward_pages(self, spark, labeller):
        pages = [None, "", "plain text &amp; no tags", "<p>a<p>b<br>c", "<script>if (a<b) {}</script>", "<div <p>x", "<!-- never closed", "<p>" * 3000 + "deep", '<a href="x>y', "<p>tie</p>" * 3]
        df = spark.createDataFrame([(k, f"u{k}", p, "x") for k, p in enumerate(pages)], "page_id long, url string, html string, text string")
        rows = html_text.extract(df, labeller).collect()
        assert len(rows) == len(pages)
        assert [r.text for r in rows if r.page_id in (0, 1, 4)] == ["", "", ""]
        assert [b.text for b in html_text.blocks(pages[3])] == ["a", "b c"]
        assert html_text.extract(df.limit(0), labeller).count() == 0

    @pytest.mark.parametrize(
        "page, want",
        [
            ("<html><head><title>x</title><body><article><p>a", ["a"]),
            ("<html><head><title>x</title><article><p>a</article>", ["a"]),
            ("<head><meta charset=x><link rel=y>text", ["text"]),
            ("<head><title>x</title></head><body>a</body>", ["a"]),
            ("<div><p hidden>a<p>b</div>c", ["b", "c"]),
            ("<div><p hidden>a</div><p>b", ["b"]),
            ('<ul><li>a<li style="color:red; display : none">b<li>c</ul>d', ["a", "c", "d"]),
            ("<ul><li hidden>a<ul><li>b</ul></ul>d", ["d"]),
            ("<table><tr><td hidden>a<th>b<tr hidden><td>c<tr><td>d</table>", ["b", "d"]),
            ("<dl><dt hidden>a<dd>b</dl>", ["b"]),
            ("<div hidden>a<div>b</div>c</div>d", ["d"]),
            ("<select><option>a<option>b</select>c", ["c"]),
            ("<p>a<svg><g/><path d=x><text>b</text></svg>c", ["a", "c"]),
            ("<div><svg><path d=x><p>b</div>", ["b"]),
            ("<svg><title/><style/></svg><p>b", ["b"]),
            ("<div hidden/>a</div>b", ["b"]),
            ('<article data-headline="The hidden cost"><p>a</article>', ["a"]),
            ('<div class="md:flex hidden lg:block">a</div>', ["a"]),
            ('<div title="display: none">a</div>', ["a"]),
            ('<div data-hidden=1 aria-hidden="true">a</div>', ["a"]),
            ('<div HIDDEN="until-found">a</div><div style=display:none>b</div>c', ["c"]),
            ('<div style="--x-display:none">a</div>', ["a"]),
            ("<script>a</script>b<template><p>c</template>d", ["b", "d"]),
        ],
    )
    def test_unseen_elements_end_as_in_browsers(self, page, want):
        assert [b.text for b in html_text.blocks(page)] == want

    @pytest.mark.parametrize(
        "page, want",
        [
            ("<!--><p>Article</p>", ["Article"]),
            ("<!---><p>Article</p>", ["Article"]),
            ("<!----><p>Article</p>", ["Article"]),
            ("<!-- a --!><p>Article</p>", ["Article"]),
            ("<!---!><p>a</p>--><p>b</p>", ["b"]),
            ("<p>a</p><!-- open <p>b</p>", ["a"]),
            ("<p data-x=it's>Hello</p><p>don't</p><p>c</p>", ["Hello", "don't", "c"]),
            ("<p data-x=it's>Hello</p><p>b</p>", ["Hello", "b"]),
            ("<p a='1''>one</p><p>two</p>", ["one", "two"]),
            ("<p a=\"x>y\" b='<p>'>one</p>", ["one"]),
            ("<p a = '1' b= hidden =c>one</p>", ["one"]),
            ("<p title=' hidden '>one</p><p class=x hidden>two</p><p>three</p>", ["one", "three"]),
            ("<p>one</p><p title='open>two</p>", ["one"]),
            ("<p>one</p><a href=x", ["one"]),
            ("<p>1 < 2 and 3 <4</p></><p>b</p></3 x><p>c</p>", ["1 < 2 and 3 <4", "b", "c"]),
            ("<script a='</script>'>x</scripts> y</script ><p>a</p>", ["a"]),
            ("<p>one</p>" + "<p a='" * 20_000, ["one"]),
        ],
    )
    def test_attributes_and_comments_end_as_in_browsers(self, page, want):
        assert [b.text for b in html_text.blocks(page)] == want

    def test_only_names_of_attributes_count(self):
        path = html_text.blocks("<div data-class='nav' CLASS='story' class='menu' title='id=footer'>text</div>")[0].path
        assert path == ("<div>", "story")


def test_registry_covers_all():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES) == list(range(1, 14))


def test_exact_dedup_equals_its_statement(spark, sf_dir):
    from tests.compare import connect, differences

    name = "op3_exact_dedup"
    assert differences(spark, connect(sf_dir), name, registry.QUERIES[name], registry.ORACLES[name], sf_dir) is None


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = registry.exact_dedup.staged(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        if name == "near_dedup":
            assert docs.count() < before
            groups = near_dedup.near_groups(docs)
            assert groups.filter("not kept").count() == 0
    assert docs.agg(F.sum(F.octet_length("text"))).first()[0] > 0
    assert corpus_pipeline.run(spark, sf_dir).filter("length > 2048").count() == 0
