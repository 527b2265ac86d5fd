"""The same results as plain SQL, written independently of the Spark plans."""

from __future__ import annotations

# -- shared relations ---------------------------------------------------------------

VERSIONS = """
versions AS (
  SELECT o_custkey AS customer_id, o_orderpriority AS plan, o_orderkey, o_orderdate AS updated_at
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS r
        FROM orders)
  WHERE r = 1
)"""

END = "TIMESTAMP '9999-12-31 23:59:59'"


def history(name: str, source: str) -> str:
    return f"""
{name} AS (
  SELECT customer_id, plan, o_orderkey, updated_at, updated_at AS valid_from,
         coalesce(lead(updated_at) OVER w, {END}) AS valid_to,
         lead(updated_at) OVER w IS NULL AS is_current
  FROM {source} WINDOW w AS (PARTITION BY customer_id ORDER BY updated_at)
)"""


HISTORY = f"{VERSIONS},{history('history', 'versions')}"
HISTORY_ROWS = (
    "SELECT customer_id, plan, o_orderkey, updated_at, valid_from, "
    "strftime(valid_to, '%Y-%m-%d %H:%M:%S') AS valid_to, is_current FROM"
)

SHIPMENTS = """
shipments AS (
  SELECT o_custkey AS customer_id, l_orderkey, l_linenumber, l_partkey, l_shipdate AS occurred_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

SPLIT = "TIMESTAMP '1998-01-01'"
LAST_LATE = f"""
last_late AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY updated_at DESC) AS r
                 FROM versions WHERE updated_at >= {SPLIT}) WHERE r = 1
)"""
EARLY = f"""
early AS (SELECT * FROM versions WHERE updated_at < {SPLIT}),
{history('early_history', 'early')},{LAST_LATE},
closed AS (
  SELECT h.customer_id, h.plan, h.o_orderkey, h.updated_at, h.valid_from,
         CASE WHEN h.is_current AND n.updated_at > h.updated_at THEN n.updated_at ELSE h.valid_to END AS valid_to,
         h.is_current AND NOT coalesce(n.updated_at > h.updated_at, FALSE) AS is_current
  FROM early_history h LEFT JOIN last_late n ON h.customer_id = n.customer_id
)"""

LINE_COLUMNS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linestatus, l_shipdate"


def latest_lines(where: str) -> str:
    return f"""
  SELECT {LINE_COLUMNS} FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r
    FROM lineitem WHERE {where}) WHERE r = 1"""


TOTALS = f"""
{HISTORY},{SHIPMENTS},
recent AS (
  SELECT * FROM shipments
  WHERE occurred_at >= (SELECT max(occurred_at) - INTERVAL 365 DAY FROM shipments)
),
totals AS (
  SELECT s.customer_id, c_name AS company_name, h.plan, c_mktsegment AS segment, count(*) AS total_events
  FROM recent s
  JOIN history h ON s.customer_id = h.customer_id AND s.occurred_at BETWEEN h.valid_from AND h.valid_to
  JOIN customer ON c_custkey = h.customer_id
  GROUP BY ALL
),
top10 AS (SELECT * FROM totals ORDER BY total_events DESC, customer_id, plan LIMIT 10)"""

EVENTS = """
ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id,
         CASE WHEN value <= 100.0 THEN CAST(user_id AS VARCHAR) END AS customer_id,
         CASE event_type WHEN 'error' THEN 'ticket_opened' WHEN 'click' THEN 'ticket_replied'
              WHEN 'view' THEN 'page_view' WHEN 'purchase' THEN 'purchase' WHEN 'signup' THEN 'login' END AS event_type,
         ts AS occurred_at, ts AS updated_at, 'web' AS channel,
         CAST(user_id AS VARCHAR) || '-' || json_extract_string(props, '$.k') AS ticket_id,
         strftime(ts, '%Y-%m-%d') AS batch_id
  FROM events
)"""

PLANS = """
plans AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'enterprise' WHEN 'BUILDING' THEN 'pro'
              WHEN 'FURNITURE' THEN 'free' WHEN 'HOUSEHOLD' THEN 'free' WHEN 'MACHINERY' THEN 'pro' END AS plan,
         c_acctbal
  FROM customer
)"""

# Feed records: all events, and the corrected purchases of 2024-01-15.
FEED = f"""{EVENTS},
feed AS (
  SELECT event_id, customer_id, event_type, occurred_at, updated_at, channel, ticket_id FROM ev
  UNION ALL
  SELECT event_id, customer_id, event_type, occurred_at + INTERVAL 1 DAY, updated_at + INTERVAL 5 DAY,
         'corrected', ticket_id
  FROM ev WHERE event_type = 'purchase' AND CAST(occurred_at AS DATE) = DATE '2024-01-15'
)"""

MATCHED = """
matched AS (
  SELECT o.event_id, o.customer_id, o.ticket_id, o.occurred_at, r.first_reply_at,
         CAST((floor(epoch(r.first_reply_at)) - floor(epoch(o.occurred_at))) / 60.0 AS DECIMAL(27, 6)) AS minutes
  FROM {events} o
  LEFT JOIN (SELECT ticket_id, min(occurred_at) AS first_reply_at FROM {events}
             WHERE event_type = 'ticket_replied' GROUP BY ticket_id) r
    ON o.ticket_id = r.ticket_id
  WHERE o.event_type = 'ticket_opened'
)"""

RESPONSE = """
response AS (
  SELECT c.plan, strftime(m.occurred_at, '%Y-%m') AS month,
         CAST(round(CAST(sum(m.minutes) AS DECIMAL(38, 6)) / count(m.minutes), 2) AS DOUBLE) AS avg_response_minutes,
         count(m.minutes) AS answered_tickets,
         count(*) - count(m.minutes) AS unanswered_tickets
  FROM matched m JOIN {customers} c ON {on}
  GROUP BY ALL
)"""
WITH_PCT = """
SELECT *, CAST(round(100.0 * unanswered_tickets / nullif(answered_tickets + unanswered_tickets, 0), 1) AS DOUBLE)
          AS unanswered_pct
FROM response"""

FIRST_RESPONSE = (
    f"WITH {EVENTS},{PLANS},{MATCHED.format(events='ev')},"
    + RESPONSE.format(customers="plans", on="m.customer_id = c.customer_id")
)

RETENTION = """
WITH cohorts AS (
  SELECT o_custkey AS customer_id, strftime(min(o_orderdate), '%Y-%m') AS cohort_month FROM orders GROUP BY 1
),
activity AS (SELECT DISTINCT o_custkey AS customer_id, strftime(o_orderdate, '%Y-%m') AS activity_month FROM orders),
sizes AS (SELECT cohort_month, count(*) AS cohort_customers FROM cohorts GROUP BY 1)
SELECT c.cohort_month, a.activity_month, s.cohort_customers, count(DISTINCT c.customer_id) AS active_customers,
       CAST(round(100.0 * count(DISTINCT c.customer_id) / s.cohort_customers, 2) AS DOUBLE) AS retention_pct
FROM cohorts c JOIN activity a USING (customer_id) JOIN sizes s ON c.cohort_month = s.cohort_month
GROUP BY c.cohort_month, a.activity_month, s.cohort_customers"""

PROFILE = """
profile AS (
  SELECT strftime(ts, '%Y-%m-%d') AS batch, count(*) AS rows,
         count(*) FILTER (WHERE event_type NOT IN ('click', 'view', 'purchase')) AS illegal, max(ts) AS newest
  FROM events GROUP BY 1
)"""

LEGAL = (
    "'login','logout','page_view','purchase','ticket_opened','ticket_replied','ticket_closed',"
    "'export_generated','report_viewed','api_call','feature_used'"
)


def report(day: str) -> str:
    """The five checks over Silver-shaped events for one day, as a relation."""
    return f"""
  SELECT *, CASE WHEN metric_value > threshold_value THEN 'FAILED' ELSE 'PASSED' END AS status, '{day}' AS batch_id
  FROM (
    SELECT 'event_id_uniqueness' AS check_name, 'uniqueness' AS check_type, 'BLOCKING' AS severity,
           'silver.events' AS table_name,
           CAST(count(*) - count(DISTINCT event_id) AS DOUBLE) AS metric_value, CAST(0 AS DOUBLE) AS threshold_value,
           (count(*) - count(DISTINCT event_id)) || ' duplicate event ids' AS details
    FROM ev
    UNION ALL
    SELECT 'customer_reference', 'referential_integrity', 'WARNING', 'silver.events',
           CAST(count(*) AS DOUBLE), 0, count(*) || ' events without a current customer'
    FROM ev e LEFT JOIN plans c ON e.customer_id = c.customer_id
    WHERE e.customer_id IS NOT NULL AND c.customer_id IS NULL
    UNION ALL
    SELECT 'event_volume', 'volume', 'WARNING', 'silver.events',
           round(deviation, 2), 50,
           'volume ' || volume || ' | average ' || format('{{:.0f}}', average)
             || ' | deviation ' || format('{{:.1f}}', deviation) || '%'
    FROM (SELECT volume, average, abs(volume - average) / average * 100 AS deviation
          FROM (SELECT (SELECT count(*) FROM ev WHERE batch_id = '{day}') AS volume,
                       (SELECT avg(n) FROM (SELECT count(*) AS n FROM ev WHERE batch_id <> '{day}'
                                            GROUP BY batch_id ORDER BY batch_id DESC LIMIT 7)) AS average))
    UNION ALL
    SELECT 'domain_values', 'domain', 'WARNING', 'silver.events,silver.customers',
           CAST(bad_types + bad_plans AS DOUBLE), 0,
           bad_types || ' illegal event types | ' || bad_plans || ' illegal plans'
    FROM (SELECT (SELECT count(*) FROM ev WHERE event_type NOT IN ({LEGAL})) AS bad_types,
                 (SELECT count(*) FROM plans WHERE plan NOT IN ('free', 'pro', 'enterprise')) AS bad_plans)
    UNION ALL
    SELECT 'event_freshness', 'freshness', 'BLOCKING', 'silver.events',
           CAST(lag AS DOUBLE), 2,
           'batch {day} | newest event ' || strftime(newest, '%Y-%m-%d %H:%M:%S') || ' | lag ' || lag || ' days'
    FROM (SELECT max(occurred_at) AS newest, date_diff('day', CAST(max(occurred_at) AS DATE), DATE '{day}') AS lag
          FROM ev WHERE batch_id = '{day}')
  )"""


AUDIT = "check_name, severity, status, metric_value, threshold_value, batch_id"
DETAILS = ("check_name, check_type, severity, status, table_name, metric_value, threshold_value, "
           "details, batch_id")

# Events and customers with faults, under the names that the report reads.
FAULTY = f"""{EVENTS.replace("ev AS", "sound AS")},{PLANS.replace("plans AS", "every AS")},
late AS (
  SELECT event_id, customer_id, CASE WHEN event_type = 'login' THEN 'sign_up' ELSE event_type END AS event_type,
         occurred_at, strftime(occurred_at + INTERVAL 4 DAY, '%Y-%m-%d') AS batch_id
  FROM sound
),
ev AS (SELECT * FROM late UNION ALL SELECT * FROM late WHERE batch_id = '2024-01-20'),
plans AS (
  SELECT customer_id, CASE WHEN right(customer_id, 1) = '7' THEN 'gold' ELSE plan END AS plan FROM every
  WHERE right(customer_id, 1) <> '3' AND right(customer_id, 2) <> '17'
)"""


def marts(until: str, history: str) -> str:
    """Rows of the three marts over the feed before a day, with versions of customers."""
    return f"""
seen AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY updated_at DESC) AS r
                 FROM feed WHERE updated_at < TIMESTAMP '{until}') WHERE r = 1
),
known AS (
  SELECT s.*, h.plan FROM seen s JOIN {history} h
  ON s.customer_id = h.customer_id AND s.occurred_at BETWEEN h.valid_from AND h.valid_to
),
top AS (
  SELECT k.customer_id || '|' || c_name || '|' || k.plan || '|' || c_mktsegment AS key, k.customer_id, k.plan, count(*) AS n
  FROM known k JOIN customer ON CAST(c_custkey AS VARCHAR) = k.customer_id
  WHERE occurred_at >= (SELECT max(occurred_at) - INTERVAL 30 DAY FROM seen)
  GROUP BY ALL ORDER BY n DESC, k.customer_id, k.plan LIMIT 10
),
{MATCHED.format(events="seen")},
{RESPONSE.format(customers=history, on="m.customer_id = c.customer_id AND m.occurred_at BETWEEN c.valid_from AND c.valid_to")},
cohorts AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, strftime(min(o_orderdate), '%Y-%m') AS cohort FROM orders
  WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1
),
active AS (
  SELECT cohort, strftime(occurred_at, '%Y-%m') AS month, count(DISTINCT s.customer_id) AS n
  FROM cohorts c JOIN seen s ON c.customer_id = s.customer_id GROUP BY 1, 2
),
sizes AS (SELECT cohort, count(*) AS n FROM cohorts GROUP BY 1),
marts AS (
  SELECT 'top' AS mart, key, n, CAST(NULL AS BIGINT) AS of, CAST(NULL AS DOUBLE) AS value FROM top
  UNION ALL
  SELECT 'response', plan || '|' || month, answered_tickets, unanswered_tickets, avg_response_minutes FROM response
  UNION ALL
  SELECT 'retention', a.cohort || '|' || month, a.n, s.n, CAST(round(100.0 * a.n / s.n, 2) AS DOUBLE)
  FROM active a JOIN sizes s ON a.cohort = s.cohort
)"""


UTC = "'%Y-%m-%dT%H:%M:%S.%fZ'"
HIGH_WATER = f"""
SELECT 'events' AS source, strftime(max(ts), {UTC}) AS last_updated_at FROM events
UNION ALL SELECT 'orders', strftime(max(o_orderdate), {UTC}) FROM orders"""

STREAMED = f"""
WITH {FEED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY updated_at DESC) AS r FROM feed)
"""
BATCH_OF = "CASE WHEN updated_at < TIMESTAMP '2024-01-16' THEN '2024-01-16' ELSE '2024-02-01' END"

# Customer versions after the two batches of the gated run, valid from the batch's first instant.
CUSTOMER_HISTORY = f"""
{PLANS},
customer_history AS (
  SELECT customer_id, plan, TIMESTAMP '2024-01-01' AS valid_from,
         CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-01-16' ELSE {END} END AS valid_to FROM plans
  UNION ALL
  SELECT customer_id, 'enterprise', TIMESTAMP '2024-01-16', {END} FROM plans WHERE c_acctbal < 0
)"""
SEEN = """
seen AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY updated_at DESC) AS r
                 FROM feed WHERE updated_at < TIMESTAMP '2024-01-31') WHERE r = 1
)"""

CATALOG = (
    ("control.watermarks", "source string, last_updated_at string, updated_at string"),
    ("bronze.events", "event_id string, customer_id string, event_type string, occurred_at string, "
     "updated_at string, channel string, properties string, _ingested_at timestamp, _source_file string, "
     "_batch_id string"),
    ("bronze.customers", "customer_id string, company_name string, plan string, segment string, "
     "signup_date string, country string, is_active string, updated_at string, _ingested_at timestamp, "
     "_source_file string, _batch_id string"),
    ("silver.events", "event_id string, customer_id string, event_type string, occurred_at timestamp, "
     "updated_at timestamp, channel string, properties string, _customer_exists boolean, "
     "_ingested_at timestamp, _source_file string, _batch_id string, event_date date"),
    ("silver.customers", "customer_id string, company_name string, plan string, segment string, "
     "signup_date date, country string, is_active boolean, updated_at timestamp, valid_from timestamp, "
     "valid_to timestamp, is_current boolean, _ingested_at timestamp, _source_file string, _batch_id string, "
     "key_bucket int"),
    ("gold.top_customers_30d", "customer_id string, company_name string, plan string, segment string, "
     "total_events bigint, _generated_at timestamp"),
    ("gold.response_time", "plan string, month string, avg_response_minutes double, answered_tickets bigint, "
     "unanswered_tickets bigint, _generated_at timestamp"),
    ("gold.cohort_retention", "cohort_month string, activity_month string, cohort_customers bigint, "
     "active_customers bigint, retention_pct double, _generated_at timestamp"),
    ("quality.check_results", "check_name string, check_type string, severity string, status string, "
     "table_name string, metric_value double, threshold_value double, details string, batch_id string, "
     "executed_at timestamp"),
)


def catalog_sql() -> str:
    rows = [
        f"('{table}', '{name}', '{kind}', {position})"
        for table, columns in CATALOG
        for position, (name, kind) in enumerate(c.split() for c in columns.split(", "))
    ]
    return f"""
SELECT table_name, column_name, data_type, position,
       CASE WHEN table_name = 'silver.events' THEN (SELECT count(*) FROM events) ELSE 0 END AS rows
FROM (VALUES {', '.join(rows)}) AS t(table_name, column_name, data_type, position)"""


PIT = f"""WITH {HISTORY},{SHIPMENTS}
SELECT s.customer_id, l_orderkey, l_linenumber, l_partkey, occurred_at, h.plan, h.valid_from
FROM shipments s {{how}} JOIN history h ON s.customer_id = h.customer_id AND {{inside}}"""
HALF_OPEN = "occurred_at >= h.valid_from AND occurred_at < h.valid_to"

ORACLES = {
    "scd2_history": f"WITH {HISTORY} {HISTORY_ROWS} history",
    "scd2_tracked": f"""WITH {VERSIONS},
      before AS (SELECT *, lag(plan) OVER (PARTITION BY customer_id ORDER BY updated_at) AS old,
                        row_number() OVER (PARTITION BY customer_id ORDER BY updated_at) AS nth FROM versions),
      changes AS (SELECT * FROM before WHERE nth = 1 OR old IS DISTINCT FROM plan),
      {history('history', 'changes')} {HISTORY_ROWS} history""",
    "scd2_two_batches": f"WITH {HISTORY} {HISTORY_ROWS} history",
    "scd2_one_pass_repair": f"WITH {HISTORY} {HISTORY_ROWS} history",
    "scd2_two_step": f"""WITH {VERSIONS},{EARLY}
      {HISTORY_ROWS} closed UNION ALL {HISTORY_ROWS}
      (SELECT *, updated_at AS valid_from, {END} AS valid_to, TRUE AS is_current FROM last_late)""",
    "scd2_stamped": f"""WITH {VERSIONS} {HISTORY_ROWS}
      (SELECT *, updated_at AS valid_from, {END} AS valid_to, TRUE AS is_current FROM versions)""",
    "close_versions": f"WITH {VERSIONS},{EARLY} {HISTORY_ROWS} closed",
    "insert_if_absent": f"WITH {VERSIONS} SELECT customer_id, plan, o_orderkey, updated_at FROM versions",
    "dedup_keep_latest": latest_lines("TRUE"),
    "upsert_newest_wins": f"""
      WITH target AS ({latest_lines("l_linestatus = 'F'")}), source AS ({latest_lines("l_linestatus = 'O'")})
      SELECT {LINE_COLUMNS} FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, is_target DESC) AS r
        FROM (SELECT *, 1 AS is_target FROM target UNION ALL SELECT *, 0 FROM source)) WHERE r = 1""",
    "pit_join_closed": PIT.format(how="", inside="occurred_at BETWEEN h.valid_from AND h.valid_to"),
    "pit_join_half_open": PIT.format(how="", inside=HALF_OPEN),
    "pit_join_left": PIT.format(how="LEFT", inside=HALF_OPEN),
    "pit_join_overlapping": f"""
      WITH visits AS (
        SELECT s_suppkey, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', 'no such'][s_suppkey % 6 + 1] AS priority,
               TIMESTAMP '1992-01-01' + to_days(CAST(s_suppkey * 7 % 2500 AS INTEGER)) AS visited
        FROM supplier
      )
      SELECT s_suppkey, count(o_orderkey) AS orders, min(o_orderkey) AS least, max(o_orderkey) AS greatest
      FROM visits LEFT JOIN orders ON o_orderpriority = priority AND visited >= o_orderdate
        AND visited <= CASE WHEN o_orderkey % 20 = 0 THEN {END} ELSE o_orderdate + INTERVAL 30 DAY END
      GROUP BY s_suppkey""",
    "top_customers_window": f"WITH {TOTALS} SELECT * FROM top10",
    "delivery_top": f"WITH {TOTALS} SELECT * FROM top10",
    "top_share": f"""WITH {TOTALS},
      sums AS (SELECT CAST((SELECT sum(total_events) FROM top10) AS BIGINT) AS top_events,
                      (SELECT count(*) FROM recent) AS window_events)
      SELECT *, CAST(round(100.0 * top_events / window_events, 1) AS DOUBLE) AS share_pct FROM sums""",
    "ticket_matching": f"""WITH {EVENTS},{MATCHED.format(events='ev')}
      SELECT event_id, ticket_id, occurred_at, first_reply_at, CAST(minutes AS DOUBLE) AS response_minutes
      FROM matched""",
    "first_response_time": f"{FIRST_RESPONSE} SELECT * FROM response",
    "delivery_response_pct": f"{FIRST_RESPONSE} {WITH_PCT}",
    "cohort_retention": RETENTION,
    "delivery_retention": RETENTION,
    "profiles_kept": f"""WITH {EVENTS},
      moved AS (SELECT event_type, occurred_at + to_months(CAST(CAST(event_id AS BIGINT) % 3 AS INTEGER)) AS moment,
                       CASE WHEN event_type IN ('purchase', 'page_view') THEN updated_at + INTERVAL 5 DAY ELSE updated_at END AS version
                FROM ev)
      SELECT strftime(version, '%Y-%m-%d') AS batch, count(*) AS rows, count(*) FILTER (WHERE event_type = 'login') AS illegal,
             max(CASE WHEN event_type = 'purchase' THEN moment + INTERVAL 2 MONTH ELSE moment END) AS newest
      FROM moved GROUP BY 1""",
    "retention_kept": f"""WITH {EVENTS},
      spread AS (SELECT event_type, customer_id, occurred_at + to_months(CAST(CAST(event_id AS BIGINT) % 3 AS INTEGER)) AS moment FROM ev),
      activity AS (SELECT DISTINCT customer_id, strftime(CASE WHEN event_type = 'purchase' THEN moment + INTERVAL 2 MONTH ELSE moment END, '%Y-%m') AS activity_month
                   FROM spread WHERE event_type <> 'page_view'),
      cohorts AS (SELECT CAST(o_custkey AS VARCHAR) AS customer_id, strftime(min(o_orderdate), '%Y-%m') AS cohort_month
                  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
      sizes AS (SELECT cohort_month, count(*) AS cohort_customers FROM cohorts GROUP BY 1)
      SELECT cohort_month, activity_month, cohort_customers, count(*) AS active_customers,
             CAST(round(100.0 * count(*) / cohort_customers, 2) AS DOUBLE) AS retention_pct
      FROM cohorts JOIN activity USING (customer_id) JOIN sizes USING (cohort_month) GROUP BY 1, 2, 3""",
    "events_by_month_type": """
      SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS events,
             count(DISTINCT user_id) AS users, round(avg(value), 6) AS avg_value
      FROM events GROUP BY 1, 2""",
    "check_uniqueness": """
      SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicates
      FROM lineitem""",
    "check_referential": """
      SELECT count(*) AS orphans FROM events LEFT JOIN supplier ON user_id = s_suppkey WHERE s_suppkey IS NULL""",
    "batch_profile": f"WITH {PROFILE} SELECT * FROM profile",
    "check_volume": f"""WITH {PROFILE},
      pair AS (SELECT (SELECT rows FROM profile WHERE batch = '2024-01-20') AS volume,
                      (SELECT avg(rows) FROM (SELECT rows FROM profile WHERE batch <> '2024-01-20'
                                              ORDER BY batch DESC LIMIT 7)) AS average)
      SELECT volume, round(average, 6) AS average,
             round(abs(volume - average) / average * 100, 2) AS deviation_pct FROM pair""",
    "check_domains": """
      SELECT 'event_type' AS domain, count(*) AS illegal FROM events
      WHERE event_type NOT IN ('click', 'view', 'purchase')
      UNION ALL SELECT 'o_orderstatus', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')""",
    "check_freshness": """
      SELECT max(ts) AS newest, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-21') AS lag_days
      FROM events WHERE strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') = '2024-01-21'""",
    "quality_report": f"WITH {EVENTS},{PLANS} SELECT {DETAILS} FROM ({report('2024-01-20')})",
    "latest_audit_rows": f"WITH {EVENTS},{PLANS} SELECT {AUDIT} FROM ({report('2024-01-20')})",
    "failed_checks": f"""WITH {EVENTS},{PLANS}
      SELECT {AUDIT} FROM ({report('2024-01-19')} UNION ALL {report('2024-01-20')}) WHERE status = 'FAILED'""",
    "incremental_extract": """
      SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS updated_at
      FROM orders WHERE o_orderdate > TIMESTAMP '2001-01-01'""",
    "extract_mixed_precision": """
      SELECT o_orderkey, updated_at FROM (
        SELECT *, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE '.500000Z' END AS updated_at
        FROM orders)
      WHERE o_orderdate > TIMESTAMP '2001-01-01' OR (o_orderdate = TIMESTAMP '2001-01-01' AND o_orderkey % 2 = 1)""",
    "high_water_mark": HIGH_WATER,
    "watermark_upsert": HIGH_WATER,
    "ingest_step": f"""WITH {FEED}
      SELECT count(*) AS raw_rows, TRUE AS first_pass, FALSE AS second_pass,
             strftime(max(updated_at), {UTC}) AS mark FROM feed""",
    "raw_roundtrip": "SELECT * FROM events",
    "batch_replace": f"""WITH {FEED}
      SELECT CASE WHEN updated_at < TIMESTAMP '2024-01-11' THEN '2024-01-11'
                  WHEN updated_at < TIMESTAMP '2024-01-21' THEN '2024-01-21' ELSE '2024-02-01' END AS _batch_id,
             count(*) AS rows FROM feed GROUP BY 1""",
    "drift_append": f"""WITH {FEED}
      SELECT {BATCH_OF} AS _batch_id,
             CASE WHEN updated_at >= TIMESTAMP '2024-01-16' THEN 'app-' || channel END AS source_app,
             count(*) AS rows FROM feed GROUP BY 1, 2""",
    "lineage_columns": f"""WITH {FEED}
      SELECT event_id, strftime(updated_at, {UTC}) AS updated_at, '2024-02-01' AS _batch_id,
             'raw/events/' AS _source_file, '2024-02-01 00:00:00' AS _ingested_at FROM feed""",
    "typed_parse": """
      SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS at,
             CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) END AS day,
             CASE WHEN o_orderstatus <> 'O' THEN o_totalprice > 200000 END AS flag
      FROM orders""",
    "orphan_flag": f"""WITH {EVENTS}
      SELECT customer_id IS NOT NULL AS _customer_exists, count(*) AS events, count(DISTINCT customer_id) AS customers
      FROM ev GROUP BY 1""",
    "layer_catalog": catalog_sql(),
    "partitioned_slice": """
      SELECT *, CAST(ts AS DATE) AS event_date FROM events
      WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-19'""",
    "overwrite_mart": RETENTION,
    "export_delimited": f"{FIRST_RESPONSE} {WITH_PCT}",
    "gated_run": f"""WITH {FEED},{CUSTOMER_HISTORY},{SEEN},
      answers AS (SELECT * FROM seen WHERE customer_id IS NOT NULL),
      months AS (SELECT DISTINCT c.cohort, strftime(occurred_at, '%Y-%m') AS activity
                 FROM (SELECT CAST(o_custkey AS VARCHAR) AS customer_id,
                              strftime(min(o_orderdate), '%Y-%m') AS cohort FROM orders GROUP BY 1) c
                 JOIN answers USING (customer_id)),
      groups AS (SELECT DISTINCT h.plan, strftime(occurred_at, '%Y-%m') FROM answers a JOIN customer_history h
                 ON a.customer_id = h.customer_id AND a.occurred_at BETWEEN h.valid_from AND h.valid_to
                 WHERE event_type = 'ticket_opened')
      SELECT 'control.watermarks' AS table_name, CAST(2 AS BIGINT) AS rows, CAST(NULL AS BIGINT) AS current_rows
      UNION ALL SELECT 'bronze.events', count(*), NULL FROM feed WHERE updated_at < TIMESTAMP '2024-01-31'
      UNION ALL SELECT 'bronze.customers', count(*), NULL FROM customer_history
      UNION ALL SELECT 'silver.events', count(*), NULL FROM seen
      UNION ALL SELECT 'silver.customers', count(*), count(*) FILTER (WHERE valid_to = {END}) FROM customer_history
      UNION ALL SELECT 'gold.top_customers_30d', 10, NULL
      UNION ALL SELECT 'gold.response_time', count(*), NULL FROM groups
      UNION ALL SELECT 'gold.cohort_retention', count(*), NULL FROM months
      UNION ALL SELECT 'quality.check_results', 20, NULL""",
    "backfill_range": f"""WITH {FEED},{CUSTOMER_HISTORY},{SEEN},{MATCHED.format(events='seen')},
      {RESPONSE.format(customers='customer_history',
                       on='m.customer_id = c.customer_id AND m.occurred_at BETWEEN c.valid_from AND c.valid_to')}
      {WITH_PCT}""",
    "stream_to_silver": f"""{STREAMED}
      SELECT event_id, customer_id, event_type, occurred_at, updated_at, channel, {BATCH_OF} AS _batch_id
      FROM ranked WHERE r = 1""",
    "silver_upsert_by_day": f"""{STREAMED}
      SELECT CAST(occurred_at AS DATE) AS event_date, channel, {BATCH_OF} AS _batch_id, count(*) AS rows
      FROM ranked WHERE r = 1 GROUP BY 1, 2, 3""",
    "upsert_touched_days": """
      SELECT CAST(ts AS DATE) AS event_date, count(*) AS rows FROM events
      WHERE event_id IN (SELECT event_id FROM events WHERE day(ts) = 7) GROUP BY 1""",
    "history_by_bucket": f"""WITH {CUSTOMER_HISTORY}
      SELECT customer_id, plan, valid_from, strftime(valid_to, '%Y-%m-%d %H:%M:%S') AS valid_to, valid_to = {END} AS is_current
      FROM customer_history""",
    "faulty_report": f"WITH {FAULTY} SELECT {DETAILS} FROM ({report('2024-01-20')})",
    "faulty_log": f"""WITH {FAULTY}
      SELECT {AUDIT} FROM ({report('2024-01-20')} UNION ALL {report('2024-01-24')}) WHERE status = 'FAILED'""",
    "faulty_blocking": f"""WITH {FAULTY} SELECT check_name FROM ({report('2024-01-20')})
      WHERE status = 'FAILED' AND severity = 'BLOCKING'""",
    "gated_marts": f"""WITH {FEED},{CUSTOMER_HISTORY},{marts('2024-01-31', 'customer_history')}
      SELECT * FROM marts""",
    "blocked_run": f"""WITH {FEED},{PLANS},
      first_versions AS (SELECT customer_id, plan, TIMESTAMP '2024-01-01' AS valid_from, {END} AS valid_to FROM plans),
      {marts('2024-01-16', 'first_versions')}
      SELECT *, 'event_freshness' AS stopped_by FROM marts""",
    "faulty_lines": f"""WITH {EVENTS}, lines AS (
        SELECT *, CAST(event_id AS BIGINT) % 4 AS turn, CAST(event_id AS BIGINT) % 4 = 1 AS broken FROM ev)
      SELECT zone, CASE WHEN NOT broken THEN event_id END AS event_id, CASE WHEN NOT broken THEN channel END AS channel,
             CASE turn WHEN 0 THEN 'one' WHEN 2 THEN 'two' END AS source_app,
             CASE WHEN NOT broken THEN ticket_id END AS ticket_id,
             CASE WHEN broken THEN '{{"event_id": "' || event_id END AS line
      FROM lines, (VALUES ('bronze'), ('quarantine')) z(zone) WHERE zone = 'bronze' OR broken""",
    "flag_as_text": """
      SELECT CAST(c_custkey AS VARCHAR) AS customer_id, updated_at,
             CASE WHEN c_acctbal >= 0 THEN 'true' ELSE 'false' END AS is_active, '2024-01-20' AS _batch_id,
             'raw/customers/' AS _source_file
      FROM customer, (VALUES ('2024-01-01T00:00:00.000000Z'), ('2024-01-16T00:00:00.000000Z')) v(updated_at)
      WHERE updated_at < '2024-01-10' OR c_acctbal < 0""",
}
