"""SQL text of the logical tables, for the DuckDB oracle statements.

Each constant is a SELECT over the physical test tables that produces the same
rows and types as the Spark reader of the same name in
``binsight.sources.tables``.
"""

AREA_DIM = """SELECT c.c_custkey, n.n_name AS area
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"""

OBSERVATIONS = f"""SELECT o.o_orderkey AS id, a.area, o.o_orderpriority AS waste_type,
       CAST(o.o_orderdate AS DATE) AS ticket_date, o.o_totalprice AS net_weight_kg
  FROM orders o JOIN ({AREA_DIM}) a ON o.o_custkey = a.c_custkey"""

PREDICTION_LOGS = f"""SELECT o.o_orderkey AS id, o.o_orderdate AS "timestamp", a.area,
       o.o_orderpriority AS waste_type, CAST(o.o_orderdate AS DATE) AS prediction_date,
       o.o_totalprice AS predicted_weight_kg, o.o_custkey AS user_id
  FROM orders o JOIN ({AREA_DIM}) a ON o.o_custkey = a.c_custkey"""

RECENT_LOGS = f"""SELECT e.event_id AS id, e.ts AS "timestamp", a.area, e.event_type AS waste_type,
       CAST(e.ts AS DATE) AS prediction_date, e.value AS predicted_weight_kg, e.user_id
  FROM events e JOIN ({AREA_DIM}) a ON e.user_id = a.c_custkey"""

USERS = """SELECT c.c_custkey AS id, c.c_name AS username, c.c_name || '@example.com' AS email,
       c.c_mktsegment = 'BUILDING' AS is_admin, f.created_at
  FROM customer c LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey) f
    ON c.c_custkey = f.o_custkey"""

# every second log row comes from a visitor's session, which the order key names
SESSION_LOGS = f"""SELECT id, "timestamp", area, waste_type, prediction_date, predicted_weight_kg,
       CASE WHEN id % 2 = 0 THEN id ELSE user_id END AS user_id FROM ({PREDICTION_LOGS})"""

REQUESTS = f"""{PREDICTION_LOGS}
 UNION ALL {RECENT_LOGS}"""

UPLOADS = """SELECT o_orderkey AS id, o_custkey AS user_id, 'file_' || CAST(o_orderkey AS VARCHAR) || '.csv' AS filename,
       o_orderpriority AS file_type, o_orderstatus AS status, o_orderdate AS created_at
  FROM orders"""

UPLOAD_ROWS = """SELECT l.l_orderkey AS upload_id, l.l_linenumber AS line, o.o_custkey AS user_id,
       'S' || CAST(l.l_suppkey AS VARCHAR) AS area, l.l_returnflag AS waste_type,
       CAST(l.l_shipdate AS DATE) AS "date", l.l_quantity AS weight
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""

SCORED_REQUESTS = f"""SELECT l.l_orderkey, l.l_linenumber, a.area, o.o_orderpriority AS waste_type,
       l.l_extendedprice AS prediction
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN ({AREA_DIM}) a ON o.o_custkey = a.c_custkey
 UNION ALL SELECT id, CAST(0 AS BIGINT), area, waste_type, predicted_weight_kg FROM ({RECENT_LOGS})"""

OBSERVED = f"""SELECT area, waste_type, net_weight_kg FROM ({OBSERVATIONS})
 UNION ALL SELECT area, waste_type, predicted_weight_kg FROM ({RECENT_LOGS})"""

KEYED_SNAPSHOTS = """SELECT user_id AS "key", event_type AS value, ts AS updated_at, event_id AS change_id FROM events"""


def exact_avg(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(28,6))) AS DOUBLE) / COUNT({c})"


def exact_sum(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(28,6))) AS DOUBLE)"


def cents(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) * 100 AS HUGEINT)"


def half_up_div(num: str, den: str) -> str:
    return (f"(CASE WHEN ({den}) = 0 THEN NULL ELSE sign({num}) * sign({den}) * "
            f"((2 * abs({num}) + abs({den})) // (2 * abs({den}))) END)")


def pct_change(old: str, new: str) -> str:
    return (f"(CASE WHEN ({old}) = 0 THEN (CASE WHEN ({new}) > 0 THEN 100.0 ELSE 0.0 END) "
            f"ELSE CAST({half_up_div(f'(({new}) - ({old})) * 1000', old)} AS DOUBLE) / 10.0 END)")


def week_label(d: str) -> str:
    return f"strftime({d}, '%Y-W%W')"
