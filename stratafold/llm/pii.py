"""Personal data by bootstrapped contextual extraction, in SQL functions only.  [native]

Seeds are the matches of four fixed forms (mail address, IP address, card number, phone
number).  The words around a seed make lexical patterns: the two words before it, and
the word on either side.  Tokens that look like identifiers but match no form are
candidates.  Values and patterns make a bipartite graph; Spark scores it in turns: a
pattern is as reliable for a kind as the values seen in it, a value as the best pattern
it is seen in.  Only distinct values count, so copies of a document add no support.
Candidates of the right shape in patterns of high reliability become further spans.

Every pattern of the four forms is written so that its matches are those of the plain
form while a run of letters or digits is tried from its start only: time grows with the
length of a text, not with its square.

Results by case: null text is empty and has no span; texts are read whole; rows that
share id and text have the same spans; a null id stays null; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import checked, staged, text_of

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: Distinct seed values that a pattern needs, and the reliability that makes a span.
SUPPORT = 4
RELIABLE = 0.8
#: Characters on either side that the context words are taken from.
CONTEXT = 80

_LOCAL = "A-Za-z0-9._%+-"
_FORMS = {
    # After a match the next may begin inside a run: \G is the end of the last match.
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a form to be tried at all.
_SIGNS = {"email": "@", "ip": ".", "card": "0-9", "phone": "+"}
_SOLID = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_CANDIDATE = rf"(?<![^\x20\x09-\x0D]){_SOLID}(?:\x20{_SOLID})*+"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, block: int = 256) -> Column:
    """Sums of all values before each, in blocks, so that long arrays stay cheap."""

    def simple(a: Column) -> Column:
        start = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(
            (acc["s"] + x).cast("int").alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")
        )
        return F.aggregate(a, start, step, lambda acc: acc["out"])

    count = F.ceil(F.size(values) / block).cast("int")
    blocks = F.when(count == 0, F.array().cast("array<array<int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda j: F.slice(values, j * block + 1, block))
    )
    return _let(
        blocks,
        lambda b: F.flatten(
            F.zip_with(
                b,
                simple(F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda s, v: (s + v).cast("int")))),
                lambda x, base: F.transform(simple(x), lambda p: p + base),
            )
        ),
    )


def matches(text: Column, pattern: str) -> Column:
    """All leftmost matches: value, start, end in code points, end exclusive, and what is around.

    What lies between matches (split) gives their places: n matches part n + 1 gaps, and a
    match's surroundings are the ends of its two gaps.  So no part of the text is read
    more than a few times, however many matches there are.
    """
    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")
    )

    def placed(p: Column) -> Column:
        steps = F.transform(
            p["hits"],
            lambda h, i: F.struct(
                F.char_length(F.get(p["gaps"], i)).alias("gap"),
                F.char_length(h).alias("hit"),
                h.alias("value"),
                F.substring(F.get(p["gaps"], i), F.lit(-CONTEXT), F.lit(CONTEXT)).alias("before"),
                F.substring(F.get(p["gaps"], i + 1), F.lit(1), F.lit(CONTEXT)).alias("after"),
            ),
        )
        return _let(
            steps,
            lambda s: F.zip_with(
                s,
                _running(F.transform(s, lambda x: x["gap"] + x["hit"])),
                lambda x, at: F.struct(
                    x["value"].alias("value"),
                    (at + x["gap"]).cast("int").alias("start"),
                    (at + x["gap"] + x["hit"]).cast("int").alias("end"),
                    x["before"].alias("before"),
                    x["after"].alias("after"),
                ),
            ),
        )

    return _let(parts, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(value, r"\."),
            lambda p: _let(
                F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda d: (F.char_length(d) <= 3) & (F.lpad(d, 3, "0") <= "255")
            ),
        )
    if kind == "card":
        return _let(_digits(value), lambda d: F.char_length(d).between(13, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


_SPANS = "array<struct<kind:int,start:int,end:int,value:string,before:string,after:string>>"


def base_spans(text: Column) -> Column:
    """The matches of the four forms by kind, then start."""

    def of(number: int, kind: str) -> Column:
        sign = _SIGNS[kind]
        there = text.rlike("[0-9]") if kind == "card" else F.contains(text, F.lit(sign))
        if kind in ("ip", "phone"):
            there = there & text.rlike("[0-9]")
        found = F.filter(matches(text, _FORMS[kind]), lambda m: _valid(kind, m["value"]))
        tagged = F.transform(
            found,
            lambda m: F.struct(
                F.lit(number).alias("kind"),
                *[m[x].alias(x) for x in ("start", "end", "value", "before", "after")],
            ),
        )
        return F.when(there, tagged).otherwise(F.array().cast(_SPANS))

    return F.concat(*[of(n, k) for n, k in enumerate(KINDS)])


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns around a span: two words before, and one on each side."""

    def words(x: Column) -> Column:
        return F.filter(F.split(F.lower(x), r"[ \t-\r]+"), lambda w: w != "")

    return _let(
        F.struct(words(before).alias("b"), words(after).alias("a")),
        lambda c: F.filter(
            F.array(
                F.concat(
                    F.lit("2 "), F.try_element_at(c["b"], F.lit(-2)), F.lit(" "), F.try_element_at(c["b"], F.lit(-1))
                ),
                F.concat(
                    F.lit("1 "), F.try_element_at(c["b"], F.lit(-1)), F.lit(" _ "), F.try_element_at(c["a"], F.lit(1))
                ),
            ),
            lambda p: p.isNotNull(),
        ),
    )


def _candidates(text: Column) -> Column:
    """Identifier-like runs of tokens, trimmed of punctuation, with their patterns."""
    found = F.transform(
        matches(text, _CANDIDATE),
        lambda m: _let(
            F.struct(
                F.char_length(F.regexp_extract(m["value"], r"^[^0-9A-Za-z+@(\[]*+", 0)).alias("lead"),
                F.char_length(F.regexp_extract(F.reverse(m["value"]), r"^[^0-9A-Za-z)\]]*+", 0)).alias("tail"),
                m.alias("m"),
            ),
            lambda t: F.struct(
                (t["m"]["start"] + t["lead"]).alias("start"),
                F.greatest(t["m"]["end"] - t["tail"], t["m"]["start"] + t["lead"]).alias("end"),
                F.substring(
                    t["m"]["value"], t["lead"] + 1, F.char_length(t["m"]["value"]) - t["lead"] - t["tail"]
                ).alias("value"),
                _patterns(t["m"]["before"], t["m"]["after"]).alias("patterns"),
            ),
        ),
    )
    kind = "array<struct<start:int,end:int,value:string,patterns:array<string>>>"
    return F.when(text.rlike("[0-9@]"), F.filter(found, lambda c: c["end"] - c["start"] >= 5)).otherwise(
        F.array().cast(kind)
    )


def _shaped(kind: Column, value: Column) -> Column:
    """Whether a value could be of a kind at all."""
    n = F.char_length(_digits(value))
    return (
        F.when(kind == 0, value.rlike(r"(?i)[@]|[\[(]\s*at\s*[\])]"))
        .when(kind == 1, value.rlike(r"^[0-9A-Fa-f]+([.:]+[0-9A-Fa-f]+){3,}"))
        .when(kind == 2, n.between(12, 19))
        .otherwise(n.between(7, 15))
    )


def _tables(docs: DataFrame) -> DataFrame:
    """One row per document: its key, base spans, and what the graph needs."""
    rows = checked(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    rows = rows.withColumn("found", base_spans(F.col("text")))
    return rows.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        F.transform("found", lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("spans"),
        F.transform(
            "found",
            lambda s: F.struct(
                s["kind"].alias("kind"),
                F.xxhash64(s["value"]).alias("value"),
                _patterns(s["before"], s["after"]).alias("patterns"),
            ),
        ).alias("seeds"),
        _candidates(F.col("text")).alias("candidates"),
    )


def _blocks(table: DataFrame, width: int = 256) -> DataFrame:
    """A row for each block of characters that a span lies in."""
    first, last = (F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    return table.withColumn("block", F.explode(F.sequence(first, last)))


def _untouched(rows: DataFrame) -> DataFrame:
    """The candidates that overlap no base span, one row each."""
    key = ["doc_id", "text_key"]
    free = rows.select(*key, F.explode("candidates").alias("c")).select(*key, "c.start", "c.end", "c.value", "c.patterns")
    base = rows.select(*key, F.explode("spans").alias("s")).select(*key, "s.start", "s.end")
    x, y = _blocks(free.select(*key, "start", "end")).alias("x"), _blocks(base).alias("y")
    touched = x.join(
        y,
        F.expr(
            "x.doc_id <=> y.doc_id and x.text_key = y.text_key and x.block = y.block "
            "and x.start < y.end and y.start < x.end"
        ),
        "left_semi",
    ).drop("block")
    a, b = free.alias("a"), touched.distinct().alias("b")
    return a.join(
        b,
        F.expr("a.doc_id <=> b.doc_id and a.text_key = b.text_key and a.start = b.start and a.end = b.end"),
        "left_anti",
    )


def _discovered(rows: DataFrame, rounds: int, support: int, reliable: float) -> DataFrame:
    """doc_id, text_key, kind, start, end of spans that patterns vouch for."""
    seeds = (
        rows.select(F.explode("seeds").alias("s"))
        .select(F.col("s.kind").alias("kind"), F.col("s.value").alias("value"), F.explode("s.patterns").alias("pattern"))
        .distinct()
    )
    places = staged(
        _untouched(rows).select(
            "doc_id",
            "text_key",
            "start",
            "end",
            F.col("value").alias("text"),
            F.xxhash64("value").alias("value"),
            F.explode("patterns").alias("pattern"),
        ),
        "places",
    )
    # Patterns with enough distinct seeds of one kind; all else is cut off before the rounds.
    backed = staged(
        seeds.groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= support), "patterns"
    )
    all_seeds = seeds.groupBy("pattern").agg(F.count("*").alias("all_seeds"))
    seen = staged(
        places.join(backed, "pattern")
        .filter(_shaped(F.col("kind"), F.col("text")))
        .select("doc_id", "text_key", "start", "end", "value", "pattern", "kind"),
        "seen",
    )
    links = staged(seen.select("value", "pattern", "kind").distinct(), "links")
    others = places.select("pattern", "value").distinct().join(backed.select("pattern").distinct(), "pattern")
    crowd = others.groupBy("pattern").agg(F.count("*").alias("others"))
    weight = staged(
        backed.join(all_seeds, "pattern").join(crowd, "pattern", "left").fillna(0, ["others"]), "weights"
    )
    # Reliability of a pattern: its seeds of the kind and its candidates as far as believed,
    # over all distinct values seen in it.
    score = weight.select("pattern", "kind", (F.col("seeds") / (F.col("all_seeds") + 1)).alias("score"))
    for _ in range(rounds):
        belief = links.join(score, ["pattern", "kind"]).groupBy("value", "kind").agg(F.max("score").alias("belief"))
        gained = (
            links.join(belief, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("belief").alias("gained"))
        )
        score = staged(
            weight.join(gained, ["pattern", "kind"], "left").select(
                "pattern",
                "kind",
                (
                    (F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / (F.col("all_seeds") + F.col("others") + 1)
                ).alias("score"),
            ),
            "scores",
        )
    good = score.filter(F.col("score") >= reliable).select("pattern", "kind")
    best = seen.join(good, ["pattern", "kind"]).groupBy("doc_id", "text_key", "start", "end").agg(F.min("kind").alias("kind"))
    return best


def find(
    docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, reliable: float = RELIABLE
) -> DataFrame:
    """doc_id, base and found spans (kind number, start, end) for every row."""
    rows = staged(_tables(docs), "pii")
    found = (
        _discovered(rows, rounds, support, reliable)
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("found"))
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "found")
    )
    same = rows.doc_id.eqNullSafe(found["_id"]) & (rows.text_key == found["_key"])
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.join(found, same, "left").select(
        "doc_id", F.col("spans").alias("base"), F.coalesce("found", none).alias("found")
    )


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
    )
    return F.array_join(F.transform(spans, one), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts and a digest of the base spans, and all spans as text."""
    rows = find(docs)

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    return rows.select(
        "doc_id",
        *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)],
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "found"))).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )
