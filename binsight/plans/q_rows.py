"""Row-returning queries: joins, ordered operators, exports, table changes,
profiles (SURVEY A8, A10, B2, B7, B10, B11, B15, C1, C2, C4, D21-D23, E1-E5,
F1, F5, K1, M1-M4)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from binsight.functions import exprs as X
from binsight.operators import changes, joins, ordered, profile
from binsight.plans import oracle_views as V
from binsight.plans.catalog import DELETE_TYPE, SAMPLE_USER, SNAPSHOT_CUTOFF, register
from binsight.sources import tables as T
from binsight.sources.sinks import export_frame, report_frame

_LOGS = f"WITH logs AS ({V.PREDICTION_LOGS})\n"
_OBS = f"WITH h AS ({V.OBSERVATIONS})\n"


# ------------------------------------------------------------------ ordered

def _calendar(df, d):
    return df.select("*", F.year(d).cast("int").alias("year"), F.month(d).cast("int").alias("month"),
                     F.dayofmonth(d).cast("int").alias("day"), X.weekday_mon0(d).alias("dayofweek"))


_CAL_SQL = """CAST(year(ticket_date) AS INTEGER) AS year, CAST(month(ticket_date) AS INTEGER) AS month,
       CAST(day(ticket_date) AS INTEGER) AS day, CAST(isodow(ticket_date) - 1 AS INTEGER) AS dayofweek"""


@register("features", _OBS + f"SELECT id, area, waste_type, ticket_date, net_weight_kg, {_CAL_SQL} FROM h")
def features(spark, d):
    return _calendar(T.observations(spark, d), "ticket_date")


@register("lag_features", _OBS + f"""
SELECT * FROM (SELECT id, ticket_date, net_weight_kg, {_CAL_SQL},
                      lag(net_weight_kg) OVER (ORDER BY ticket_date, id) AS lag_1 FROM h)
 WHERE lag_1 IS NOT NULL""")
def lag_features(spark, d):
    obs = T.observations(spark, d).select("id", "ticket_date", "net_weight_kg")
    lagged = ordered.lag_global(obs, "net_weight_kg", ["ticket_date", "id"])
    return _calendar(lagged, "ticket_date").na.drop("any")


@register("lag_series", _OBS + """
SELECT id, area, waste_type, ticket_date, net_weight_kg,
       lag(net_weight_kg) OVER (PARTITION BY area, waste_type ORDER BY ticket_date, id) AS lag_1 FROM h""")
def lag_series(spark, d):
    obs = T.observations(spark, d)
    return ordered.lag_global(obs, "net_weight_kg", ["ticket_date", "id"], series_cols=["area", "waste_type"])


@register("temporal_split", _OBS + """
SELECT id, ticket_date, net_weight_kg, rn,
       CASE WHEN rn > n - CAST(ceil(n * 0.2) AS BIGINT) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT id, ticket_date, net_weight_kg, row_number() OVER (ORDER BY ticket_date, id) AS rn,
               count(*) OVER () AS n FROM h)""")
def temporal_split(spark, d):
    obs = T.observations(spark, d).select("id", "ticket_date", "net_weight_kg")
    return ordered.temporal_split(obs, ["ticket_date", "id"])


@register("user_history_topk", _LOGS + """
SELECT * FROM (SELECT user_id, id, prediction_date, predicted_weight_kg,
                      CAST(row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS INTEGER) AS rn FROM logs)
 WHERE rn <= 50""")
def user_history_topk(spark, d):
    logs = T.prediction_logs(spark, d).select("user_id", "id", "prediction_date", "predicted_weight_kg")
    return ordered.top_k_per_key(logs, "user_id", [F.desc("id")], 50)


@register("latest_upload", f"""
SELECT user_id, id, filename, file_type, status, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r FROM ({V.UPLOADS})) WHERE r = 1""")
def latest_upload(spark, d):
    return ordered.latest_per_key(T.uploads(spark, d), "user_id", "id")


@register("recent_rows", _LOGS + "SELECT * FROM logs ORDER BY id DESC LIMIT 50")
def recent_rows(spark, d):
    return ordered.top_k(T.prediction_logs(spark, d), [F.desc("id")], 50)


@register("head_tail", _OBS + """
SELECT * FROM (SELECT *, 'head' AS part FROM h ORDER BY id LIMIT 5)
UNION ALL SELECT * FROM (SELECT *, 'tail' AS part FROM h ORDER BY id DESC LIMIT 5)""")
def head_tail(spark, d):
    return ordered.head_tail(T.observations(spark, d), "id", 5)


# ------------------------------------------------------------------ filters and exports

@register("filter_user_history", _LOGS + f"SELECT * FROM logs WHERE user_id = {SAMPLE_USER}")
def filter_user_history(spark, d):
    return T.prediction_logs(spark, d).filter(F.col("user_id") == SAMPLE_USER)


@register("export_rows", _LOGS + f"""
SELECT prediction_date AS "Prediction Date", area AS "Area", waste_type AS "Waste Type",
       predicted_weight_kg AS "Predicted Weight (kg)", "timestamp" AS "Timestamp"
  FROM logs WHERE user_id = {SAMPLE_USER} ORDER BY id DESC""")
def export_rows(spark, d):
    return export_frame(T.prediction_logs(spark, d), user_id=SAMPLE_USER)


@register("export_recent", _LOGS + """
SELECT prediction_date AS "Prediction Date", area AS "Area", waste_type AS "Waste Type",
       predicted_weight_kg AS "Predicted Weight (kg)", "timestamp" AS "Timestamp"
  FROM logs ORDER BY id DESC LIMIT 100""")
def export_recent(spark, d):
    return export_frame(T.prediction_logs(spark, d), user_id=None)


@register("report_rows", _LOGS + """
SELECT prediction_date, area, waste_type, printf('%.2f kg', predicted_weight_kg) AS weight, "timestamp"
  FROM logs ORDER BY id DESC LIMIT 50""")
def report_rows(spark, d):
    return report_frame(T.prediction_logs(spark, d))


# ------------------------------------------------------------------ joins

@register("upload_detail", f"""
SELECT r.upload_id, r.line, r.area, r.waste_type, r."date", r.weight, u.filename
  FROM ({V.UPLOAD_ROWS}) r JOIN ({V.UPLOADS}) u ON r.upload_id = u.id
 WHERE r.user_id = {SAMPLE_USER}
 ORDER BY 1 DESC, 2 DESC, 3 DESC, 4 DESC, 5 DESC, 6 DESC, 7 DESC LIMIT 100""")
def upload_detail(spark, d):
    return joins.upload_detail(T.upload_rows(spark, d), T.uploads(spark, d), SAMPLE_USER)


@register("activity_log", f"""
WITH top AS (SELECT * FROM ({V.SESSION_LOGS}) ORDER BY id DESC LIMIT 100)
SELECT top.id, top."timestamp", top.area, top.waste_type, top.prediction_date, top.predicted_weight_kg,
       top.user_id, COALESCE(NULLIF(u.username, ''), 'Anonymous') AS username
  FROM top LEFT JOIN ({V.USERS}) u ON top.user_id = u.id ORDER BY top.id DESC""")
def activity_log(spark, d):
    return joins.activity_log(T.session_logs(spark, d), T.users(spark, d))


@register("invalid_domain_rows", f"""
WITH r AS ({V.REQUESTS}), h AS ({V.OBSERVATIONS}),
a AS (SELECT DISTINCT area FROM h), t AS (SELECT DISTINCT waste_type FROM h)
SELECT r.id, r.area, r.waste_type, a.area IS NOT NULL AS area_ok, t.waste_type IS NOT NULL AS type_ok
  FROM r LEFT JOIN a ON r.area = a.area LEFT JOIN t ON r.waste_type = t.waste_type
 WHERE a.area IS NULL OR t.waste_type IS NULL""")
def invalid_domain_rows(spark, d):
    return joins.invalid_domain_rows(T.requests(spark, d), T.observations(spark, d))


@register("valid_domain_rows", f"""
WITH r AS ({V.REQUESTS}), h AS ({V.OBSERVATIONS})
SELECT * FROM r WHERE area IN (SELECT area FROM h) AND waste_type IN (SELECT waste_type FROM h)""")
def valid_domain_rows(spark, d):
    return joins.valid_domain_rows(T.requests(spark, d), T.observations(spark, d))


# login attempts: each event names its user by user name, or by e-mail for signups; every fifth one tries a
# number that may be no customer's
_ATTEMPT_ID = "CASE WHEN event_id % 5 = 0 THEN 'Customer#' || lpad(CAST(event_id AS VARCHAR), 9, '0') WHEN event_type = 'signup' THEN 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '@example.com' ELSE 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') END"


@register("resolve_login", f"""
WITH a AS (SELECT event_id, {_ATTEMPT_ID} AS identifier FROM events),
u AS ({V.USERS})
SELECT a.event_id, a.identifier, u.id AS resolved_user_id
  FROM a LEFT JOIN u ON a.identifier = u.username OR a.identifier = u.email""")
def resolve_login(spark, d):
    e = T.read(spark, d, "events")
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    guess = F.concat(F.lit("Customer#"), F.lpad(F.col("event_id").cast("string"), 9, "0"))
    ident = F.when(F.col("event_id") % 5 == 0, guess).when(F.col("event_type") == "signup", F.concat(name, F.lit("@example.com"))).otherwise(name)
    attempts = e.select("event_id", ident.alias("identifier"))
    return joins.resolve_login(attempts, T.users(spark, d))


# ------------------------------------------------------------------ text

@register("sanitize_text", """
SELECT page_id, regexp_replace(regexp_replace(html, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g'),
                               '[;<>]', '', 'g') AS clean_html
  FROM pages""")
def sanitize_text(spark, d):
    p = T.read(spark, d, "pages")
    return p.select("page_id", X.sanitize("html", max_length=None).alias("clean_html"))


# ------------------------------------------------------------------ profiles

@register("profile_numeric", _OBS + f"""
, m AS (SELECT COUNT(net_weight_kg) AS n, {V.exact_avg('net_weight_kg')} AS mean FROM h),
s AS (SELECT SUM(CAST((h.net_weight_kg - m.mean) * (h.net_weight_kg - m.mean) AS DECIMAL(38,6))) AS ss
        FROM h CROSS JOIN m WHERE h.net_weight_kg IS NOT NULL)
SELECT m.n AS count, m.mean, sqrt(CAST(s.ss AS DOUBLE) / NULLIF(m.n - 1, 0)) AS std,
       (SELECT MIN(net_weight_kg) FROM h) AS min,
       (SELECT quantile_cont(net_weight_kg, 0.25) FROM h) AS q25,
       (SELECT quantile_cont(net_weight_kg, 0.5) FROM h) AS q50,
       (SELECT quantile_cont(net_weight_kg, 0.75) FROM h) AS q75,
       (SELECT MAX(net_weight_kg) FROM h) AS max
  FROM m CROSS JOIN s""")
def profile_numeric(spark, d):
    return profile.describe(T.observations(spark, d), "net_weight_kg")


@register("profile_columns", _OBS + """
SELECT * FROM (VALUES ('id', 'bigint'), ('area', 'string'), ('waste_type', 'string'),
                      ('ticket_date', 'date'), ('net_weight_kg', 'double')) c(column_name, dtype)
 CROSS JOIN LATERAL (SELECT CASE c.column_name WHEN 'id' THEN COUNT(id) WHEN 'area' THEN COUNT(area)
                     WHEN 'waste_type' THEN COUNT(waste_type) WHEN 'ticket_date' THEN COUNT(ticket_date)
                     ELSE COUNT(net_weight_kg) END AS non_null, COUNT(*) AS total_rows FROM h)""")
def profile_columns(spark, d):
    return profile.profile_columns(T.observations(spark, d))


def _pvalue_sql(d, n):
    t = f"(sqrt(CAST({n} AS DOUBLE)) * {d})"
    small = " + ".join(f"exp({-((2 * k - 1) * math.pi) ** 2 / 8!r} / ({t} * {t}))" for k in range(1, 9))
    large = " + ".join(f"exp({-2.0 * k * k!r} * {t} * {t}) * {(-1.0) ** (k - 1)!r}" for k in range(1, 9))
    p = (f"CASE WHEN {t} <= 0 THEN 1.0 WHEN {t} < 1.18 THEN 1.0 - {math.sqrt(2 * math.pi)!r} / {t} * ({small}) "
         f"ELSE 2.0 * ({large}) END")
    return f"CASE WHEN {d} IS NOT NULL THEN round(greatest(0.0, least(1.0, {p})), 9) END"


@register("ks_uniform", f"""
WITH x AS (SELECT predicted_weight_kg AS x FROM ({V.RECENT_LOGS}) WHERE predicted_weight_kg IS NOT NULL),
m AS (SELECT COUNT(x) AS n, MIN(x) AS lo, MAX(x) AS hi FROM x),
r AS (SELECT x, row_number() OVER (ORDER BY x) AS rn FROM x),
k AS (SELECT m.n, m.lo AS min, m.hi AS max,
       MAX(greatest(r.rn / CAST(m.n AS DOUBLE) - (r.x - m.lo) / NULLIF(m.hi - m.lo, 0),
                    (r.x - m.lo) / NULLIF(m.hi - m.lo, 0) - (r.rn - 1) / CAST(m.n AS DOUBLE))) AS d_stat
  FROM r CROSS JOIN m GROUP BY m.n, m.lo, m.hi)
SELECT *, {_pvalue_sql('d_stat', 'n')} AS p_value FROM k""")
def ks_uniform(spark, d):
    return profile.ks_uniform(T.recent_logs(spark, d), "predicted_weight_kg")


# ------------------------------------------------------------------ table changes (M1-M4)

_SNAP = f"WITH s AS ({V.KEYED_SNAPSHOTS})\n"


def _settings(spark, d):
    s = T.keyed_snapshots(spark, d)
    cut = F.lit(SNAPSHOT_CUTOFF).cast("timestamp_ntz")
    base = s.filter(F.col("updated_at") < cut)
    ch = s.filter(F.col("updated_at") >= cut)
    return changes.upsert_latest(base, ch, "key", ["updated_at", "change_id"])


@register("upsert_latest", _SNAP + """
SELECT "key", value, updated_at, change_id FROM (
  SELECT *, row_number() OVER (PARTITION BY "key" ORDER BY updated_at DESC, change_id DESC) AS r FROM s) WHERE r = 1""")
def upsert_latest(spark, d):
    return _settings(spark, d)


@register("settings_with_defaults", _SNAP + """
, l AS (SELECT "key", value, updated_at, change_id FROM (
  SELECT *, row_number() OVER (PARTITION BY "key" ORDER BY updated_at DESC, change_id DESC) AS r FROM s) WHERE r = 1)
SELECT c.c_custkey AS "key", COALESCE(l.value, 'dark') AS value, l.updated_at, l.change_id,
       l."key" IS NULL AS is_default
  FROM customer c LEFT JOIN l ON c.c_custkey = l."key" """)
def settings_with_defaults(spark, d):
    keys = T.read(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return changes.with_defaults(keys, _settings(spark, d), "key", {"value": "dark"})


@register("delete_where", _LOGS + f"SELECT * FROM logs WHERE NOT COALESCE(waste_type = '{DELETE_TYPE}', FALSE)")
def delete_where(spark, d):
    logs = T.prediction_logs(spark, d)
    return changes.delete_where(logs, F.col("waste_type") == DELETE_TYPE)


@register("cascade_delete", f"""
WITH del AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal <= 0)
SELECT 'users' AS table_name, COUNT(*) AS n, SUM(c_custkey)::BIGINT AS keys FROM customer WHERE c_custkey NOT IN (SELECT id FROM del)
UNION ALL SELECT 'prediction_logs', COUNT(*), SUM(id)::BIGINT FROM ({V.PREDICTION_LOGS}) WHERE user_id NOT IN (SELECT id FROM del)
UNION ALL SELECT 'user_settings', COUNT(*), SUM(change_id)::BIGINT FROM ({V.KEYED_SNAPSHOTS}) WHERE "key" NOT IN (SELECT id FROM del)""")
def cascade_delete(spark, d):
    users = T.users(spark, d)
    deleted = T.read(spark, d, "customer").filter(F.col("c_acctbal") <= 0).select(F.col("c_custkey").alias("id"))
    kept = changes.cascade_delete({"users": (users, "id"),
                                   "prediction_logs": (T.prediction_logs(spark, d), "user_id"),
                                   "user_settings": (T.keyed_snapshots(spark, d), "key")}, deleted)
    ids = {"users": "id", "prediction_logs": "id", "user_settings": "change_id"}
    out = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), F.sum(ids[name]).cast("long").alias("keys"))
           for name, df in kept.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("orphans", _LOGS + f"""
SELECT * FROM ({V.SESSION_LOGS}) s WHERE NOT EXISTS (SELECT 1 FROM ({V.USERS}) u WHERE u.id = s.user_id)""")
def orphans_q(spark, d):
    return changes.orphans(T.session_logs(spark, d), "user_id", T.users(spark, d))


@register("update_by_key", f"""
WITH c AS (SELECT upload_id, COUNT(*) AS record_count FROM ({V.UPLOAD_ROWS}) GROUP BY upload_id)
SELECT u.id, u.user_id, u.filename, COALESCE(CASE WHEN c.upload_id IS NOT NULL THEN 'completed' END, u.status) AS status,
       COALESCE(c.record_count, 0) AS record_count
  FROM ({V.UPLOADS}) u LEFT JOIN c ON u.id = c.upload_id""")
def update_by_key(spark, d):
    up = T.uploads(spark, d).select("id", "user_id", "filename", "status",
                                    F.lit(0).cast("bigint").alias("record_count"))
    counts = (T.upload_rows(spark, d).groupBy("upload_id").agg(F.count(F.lit(1)).alias("record_count"))
              .select(F.col("upload_id").alias("id"), F.lit("completed").alias("status"), "record_count"))
    return changes.update_by_key(up, counts, "id", ["status", "record_count"])
