"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.llm import (
    exact_dedup,
    fingerprint,
    html_text,
    line_crf,
    mixing,
    near_dedup,
    packing,
    phrases,
    piece_merges,
    pii,
    suffix_dedup,
    superkmer_dedup,
    turn_repair,
)
from stratafold.llm.common import documents, pages

#: The vocabulary file of the packing query.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The vocabulary file of the encoding query.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), TOKENIZER)
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "segment",
        "loss_tokens",
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(documents(spark, sf_dir), whole=True)
    return mix.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        F.size("copies").alias("n_copies"),
        F.transform("copies", lambda c: c["shard"]).alias("shards"),
    )


def op7_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer_dedup.repeat_report(documents(spark, sf_dir))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(pages(spark, sf_dir))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(documents(spark, sf_dir))


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return line_crf.classify(documents(spark, sf_dir), labels)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_merges.digests(documents(spark, sf_dir), PIECES)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_pii": op2_pii,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_superkmer_dedup": op7_superkmer_dedup,
    "op8_html_text": op8_html_text,
    "op9_fingerprint": op9_fingerprint,
    "op10_line_crf": op10_line_crf,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_turn_repair": op12_turn_repair,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]', '', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT text_sha256, count(*) AS group_size,
                   first(doc_id ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id
            FROM d GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)
    """,
    # Crc32 by its table, then a cheapest path for each state, row by row.
    "op12_turn_repair": r"""
        WITH RECURSIVE crc AS (
            SELECT list(v ORDER BY i) AS t FROM (
                SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, b:
                    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
                FROM range(256) r(i)
            )
        ), hit AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(
                       list_concat([4294967295], list_transform(
                           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                           lambda x: ascii(x)::BIGINT)),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h
            FROM conversations, crc
        ), hurt AS (
            SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM hit WHERE h <> 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
                   rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
            FROM (
                SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i
                FROM hurt
            )
        ), faults AS (
            SELECT conv_id, turn, role, text, i, left(role, 1) AS ini,
                   CASE WHEN bare = '' THEN 'b' WHEN seen > 1 THEN 'd'
                        WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
            FROM placed
        ), counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                   count(*) FILTER (fault = 't') AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal,
                   count(*) AS n
            FROM (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM faults)
            GROUP BY conv_id
        ), move(s, s2, ini, role) AS (
            VALUES (0, 1, 's', 'system'), (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (2, 3, 'a', 'assistant'), (3, 2, 'u', 'user')
        ), ins(s, s2, cost, audit, lines) AS (
            VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []::VARCHAR[]), (2, 2, 0, '', []::VARCHAR[]),
                   (3, 3, 0, '', []::VARCHAR[]), (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']),
                   (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']),
                   (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:'])
        ), edit AS (
            SELECT conv_id, i, s, s AS s2, 2 AS cost, 'D' AS audit, []::VARCHAR[] AS lines FROM faults, range(4) r(s)
            UNION ALL
            SELECT conv_id, i, s, s2, CASE WHEN fault = 't' THEN 5 ELSE 0 END, 'K', [role || ':' || text]
            FROM (SELECT f.*, m.s, m.s2 FROM faults f JOIN move m USING (ini)) WHERE fault IN ('', 't')
            UNION ALL
            SELECT f.conv_id, f.i, m.s, m.s2, CASE WHEN f.fault = 't' THEN 6 ELSE 1 END, 'R', [m.role || ':' || f.text]
            FROM faults f, move m WHERE m.ini <> 's' AND f.fault IN ('', 't')
        ), walk AS (
            SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM counted
            UNION ALL
            SELECT conv_id, i, s, min(cost), first(audit ORDER BY cost, audit), first(lines ORDER BY cost, audit)
            FROM (
                SELECT w.conv_id, w.i + 1 AS i, e.s2 AS s, w.cost + g.cost + e.cost AS cost,
                       w.audit || g.audit || e.audit AS audit, list_concat(list_concat(w.lines, g.lines), e.lines) AS lines
                FROM walk w JOIN ins g ON g.s = w.s
                JOIN edit e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.s = g.s2
            ) GROUP BY conv_id, i, s
        ), ended AS (
            SELECT w.conv_id, min(w.cost + g.cost) AS cost, first(w.audit || g.audit ORDER BY w.cost + g.cost, w.audit || g.audit) AS audit,
                   first(list_concat(w.lines, g.lines) ORDER BY w.cost + g.cost, w.audit || g.audit) AS lines
            FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
            JOIN ins g ON g.s = w.s AND g.s2 IN (0, 3)
            GROUP BY w.conv_id
        )
        SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.cost, 0)::BIGINT AS cost,
               coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a
        LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
        LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
    """,
    "op13_collocations": r"""
        WITH texts AS (
            SELECT coalesce(lang, 'und') AS lang, string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?
-
]') AS pieces
            FROM documents
        ), pieces AS (
            SELECT lang, row_number() OVER () AS piece, regexp_extract_all(p, '[^ \t]+') AS w
            FROM (SELECT lang, unnest(pieces) AS p FROM texts)
        ), total AS (
            SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
        ), words AS (
            SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4
            FROM (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM pieces)
            WINDOW p AS (PARTITION BY piece ORDER BY i)
        ), f AS (
            SELECT lang, size, phrase, count(*) AS a FROM (
                SELECT lang, 1 AS size, w1 AS phrase FROM words
                UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM words WHERE w2 IS NOT NULL
                UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM words WHERE w3 IS NOT NULL
                UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM words WHERE w4 IS NOT NULL
            ) GROUP BY lang, size, phrase HAVING count(*) >= 30
        ), held AS (
            SELECT lang, phrase, max(a) AS longer FROM (
                SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
                FROM (SELECT lang, a, size, string_split(phrase, ' ') AS w FROM f WHERE size > 2), range(2, 4) r(m), range(1, 4) q(i)
                WHERE m < size AND i + m - 1 <= size
            ) GROUP BY lang, phrase
        ), own AS (
            SELECT lang, phrase, size, a, string_split(phrase, ' ') AS w FROM f LEFT JOIN held USING (lang, phrase)
            WHERE size > 1 AND NOT coalesce(100::HUGEINT * longer >= 80::HUGEINT * a, false)
        ), parts AS MATERIALIZED (
            SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:size], ' ') AS rest
            FROM own, range(1, 4) q(k) WHERE k < size
        ), cuts AS (
            SELECT p.lang, p.phrase, p.a, k, x.a AS l, y.a AS r,
                   (2000000::HUGEINT * p.a // (x.a::HUGEINT + y.a))::BIGINT AS score
            FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.head JOIN f y ON y.lang = p.lang AND y.phrase = p.rest
        ), weakest AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a, l, r, n, score
        FROM weakest JOIN total USING (lang)
        QUALIFY rank <= 2000
    """,
}
