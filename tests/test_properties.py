"""Random small tables against plain Python."""

from collections import Counter
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratafold.operators.merge import newest_wins
from stratafold.operators.pit import pit_join
from stratafold.operators.scd2 import apply_one_pass, rebuild, stamp_versions
from stratafold.plans import marts
from tests.conftest import rows

SETTINGS = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
START = datetime(2026, 1, 1)
keys = st.sampled_from(["a", "b", "c"])
hours = st.integers(0, 12)


def unique(data, key):
    return list({key(row): row for row in data}.values())


def table(spark, data):
    df = spark.createDataFrame(data, "k string, h int, v int")
    return df.select("k", (F.lit(START) + F.make_dt_interval(hours="h")).cast("timestamp").alias("at"), "v")


row = st.tuples(keys, hours, st.integers(0, 9))


@SETTINGS
@given(target=st.lists(row, max_size=6), source=st.lists(row, max_size=6), limit=st.sampled_from([0, 1 << 40]))
def test_upsert(spark, target, source, limit):
    target, source = unique(target, lambda r: r[0]), unique(source, lambda r: r[0])
    t, s = table(spark, target), table(spark, source)
    once = newest_wins(t, s, ["k"], "at", limit)
    best = {r[0]: r for r in target}
    for r in source:
        if r[0] not in best or r[1] > best[r[0]][1]:
            best[r[0]] = r
    expected = rows(table(spark, list(best.values())))
    assert rows(once) == expected
    assert rows(newest_wins(once, s, ["k"], "at", limit)) == expected


@SETTINGS
@given(versions=st.lists(row, min_size=1, max_size=12), cut=st.lists(st.integers(0, 12), max_size=2))
def test_history_does_not_depend_on_the_batches(spark, versions, cut):
    versions = unique(versions, lambda r: r[:2])
    whole = rebuild(table(spark, versions), "k", "at")
    history = stamp_versions(table(spark, versions), "at").limit(0)
    borders = [0, *sorted(cut), len(versions)]
    for first, last in zip(borders, borders[1:]):
        if versions[first:last]:
            history = apply_one_pass(history, table(spark, versions[first:last]), "k", "at")
    found = rows(history, *whole.columns)
    assert found == rows(whole)
    by_key = {}
    for k, _, _, start, end, current in sorted(found):
        by_key.setdefault(k, []).append((start, end, current))
    for spans in by_key.values():
        assert [c for *_, c in spans] == [False] * (len(spans) - 1) + [True]
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


@SETTINGS
@given(
    versions=st.lists(row, min_size=1, max_size=10),
    facts=st.lists(st.tuples(keys, hours), min_size=1, max_size=15),
    limits=st.sampled_from([{}, {"many_versions": 1}, {"broadcast_bytes": 0, "small_bytes": 0, "hot_rows": 2}]),
)
def test_point_in_time(spark, versions, facts, limits):
    versions = unique(versions, lambda r: r[:2])
    history = rebuild(table(spark, versions), "k", "at").select("k", "v", "valid_from", "valid_to")
    df = table(spark, [(k, h, i) for i, (k, h) in enumerate(facts)]).withColumnRenamed("v", "n")
    starts = {}
    for k, h, v in sorted(versions):
        starts.setdefault(k, []).append((h, v))
    for bounds in ("closed", "half_open"):
        expected = Counter()
        for i, (k, h) in enumerate(facts):
            spans = starts.get(k, [])
            for (a, v), (b, _) in zip(spans, [*spans[1:], (99, None)]):
                if a <= h and (h <= b if bounds == "closed" else h < b):
                    expected[i, v] += 1
        found = pit_join(df, history, "k", "at", bounds=bounds, **limits).select("n", "v").collect()
        assert Counter(tuple(r) for r in found) == expected
        if bounds == "half_open":
            assert max(Counter(r["n"] for r in found).values(), default=0) <= 1


@SETTINGS
@given(
    data=st.lists(
        st.tuples(keys, hours, st.sampled_from(["ticket_opened", "ticket_replied"]), st.sampled_from(["t1", "t2", None])),
        min_size=1,
        max_size=15,
    )
)
def test_response_and_retention_counts(spark, data):
    events = spark.createDataFrame(
        [(k, START + timedelta(hours=h), e, t) for k, h, e, t in data], "customer_id string, occurred_at timestamp, event_type string, t string"
    ).select(
        "customer_id",
        "occurred_at",
        "event_type",
        F.to_json(F.struct(F.col("t").alias("ticket_id"))).alias("properties"),
        F.lit(True).alias("_customer_exists"),
    )
    customers = stamp_versions(
        spark.createDataFrame([(k, "pro", START) for k in ("a", "b", "c")], "customer_id string, plan string, updated_at timestamp")
    ).withColumn("signup_date", F.col("valid_from").cast("date"))
    opened = sum(e == "ticket_opened" for _, _, e, _ in data)
    response = marts.response_time(events, customers).agg(F.sum("answered_tickets") + F.sum("unanswered_tickets"))
    assert (response.first()[0] or 0) == opened
    for r in marts.cohort_retention(events, customers).collect():
        assert 0 < r["active_customers"] <= r["cohort_customers"] == 3
        assert r["active_customers"] == len({k for k, *_ in data})
        assert r["retention_pct"] == round(100 * r["active_customers"] / 3, 2)
