"""Joins.

Fact rows meet small aggregated sides (means per area / type, domain lists).
Those sides are computed once, checkpointed and measured; they are broadcast
only when their bytes are within ``MAX_BROADCAST_BYTES``, otherwise
the join is left to the planner (sort-merge, AQE skew-join splits hot keys).
Unconditional ``broadcast`` hints are used only for sides whose size is fixed
by construction (one-row global aggregates, the 7-row model table, period
tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight.functions import exprs as X
from binsight.session import ensure_checkpoint_dir

# Largest aggregated side (bytes) that is broadcast to every task.  Aggregates
# are checkpointed and measured first; beyond this size the join shuffles
# (sort-merge, with AQE's skew-join splitting hot keys).
MAX_BROADCAST_BYTES = 64 << 20

# Gauge headroom and the band thresholds relative to the area mean.
GAUGE_HEADROOM = 1.2
BAND_AMBER_ABOVE = 1.1
BAND_RED_ABOVE = 1.3


def measured_bytes(df: DataFrame) -> int:
    """About the bytes a table takes in memory: of strings their length, 16 for each value besides."""
    texts = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c, t in df.dtypes if t == "string"]
    row = sum(texts, F.lit(16 * len(df.columns)))
    return int(df.agg(F.sum(row.cast("long"))).first()[0] or 0)


def materialize_small(df: DataFrame) -> tuple[DataFrame, int]:
    """Checkpoint an aggregated table (computed once, re-read by every branch
    that uses it) and return it with its measured bytes."""
    ensure_checkpoint_dir(df.sparkSession)
    cp = df.checkpoint(eager=True)
    return cp, measured_bytes(cp)


def bounded_broadcast(df: DataFrame, size: int, most: int | None = None) -> DataFrame:
    """Broadcast hint only for a side whose measured bytes are within the bound
    (``MAX_BROADCAST_BYTES`` unless given); beyond it the planner's shuffle join
    (sort-merge, AQE skew handling) is used.  The result is the same."""
    bound = MAX_BROADCAST_BYTES if most is None else most
    return F.broadcast(df) if size <= bound else df


def domain_tables(domain_source: DataFrame) -> tuple[DataFrame, int, DataFrame, int]:
    """Known areas and waste types from one pass over ``domain_source``:
    distinct (area, waste_type) pairs are checkpointed and measured; both lists
    derive from that table and are at most as large, so its bytes bound them.  Returns (areas, bound, types, bound)."""
    pairs, n = materialize_small(domain_source.select("area", "waste_type").distinct())
    return pairs.select("area").distinct(), n, pairs.select("waste_type").distinct(), n


def history_cells(history: DataFrame, value: str = "net_weight_kg") -> tuple[DataFrame, int]:
    """One pass over the history: exact decimal sum and count per
    (area, waste_type) cell, checkpointed.  Area, type and overall means are
    re-aggregations of this small table, so the history is read once."""
    cells = history.groupBy("area", "waste_type").agg(
        F.sum(F.col(value).cast(X.EXACT)).alias("_s"), F.count(F.col(value)).alias("_n"))
    return materialize_small(cells)


def _means(cells: DataFrame, key: str | None, out: str) -> DataFrame:
    g = cells.groupBy(key) if key else cells.groupBy()
    agg = g.agg((F.sum("_s").cast("double") / F.sum("_n")).alias(out))
    return agg.withColumnRenamed(key, f"_{key}") if key else agg


def benchmark_against_history(requests: DataFrame, history: DataFrame, prediction: str = "prediction",
                              value: str = "net_weight_kg") -> DataFrame:
    """C3 + D20 + B16: attach the historical area, type and overall mean to each
    prediction; a missing or zero mean falls back to the prediction itself.

    The history is aggregated once into (area, type) cells; the per-area and
    per-type means (at most as many rows as cells) are broadcast when the
    measured bytes are within ``MAX_BROADCAST_BYTES``, so the fact side is
    never shuffled for them; the overall mean is a single row.
    """
    cells, n_cells = history_cells(history, value)
    area_avg = bounded_broadcast(_means(cells, "area", "_area_avg"), n_cells)
    type_avg = bounded_broadcast(_means(cells, "waste_type", "_type_avg"), n_cells)
    overall = F.broadcast(_means(cells, None, "_all_avg"))  # global aggregate: exactly one row
    p = F.col(prediction)
    fb = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), p)
    return (requests
            .join(area_avg, requests["area"] == area_avg["_area"], "left")
            .join(type_avg, requests["waste_type"] == type_avg["_waste_type"], "left")
            .crossJoin(overall)
            .select(*requests.columns, fb("_area_avg").alias("area_avg"),
                    fb("_type_avg").alias("type_avg"), fb("_all_avg").alias("overall_avg")))


def prediction_band(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Gauge scale and colour band of each benchmarked prediction.

    gauge_max = max(prediction, area_avg, overall_avg) * 1.2; band is 'red' above
    1.3 x area_avg, 'amber' above 1.1 x area_avg, else 'green'.
    """
    p = F.col(prediction)
    gmax = F.greatest(p, F.col("area_avg"), F.col("overall_avg")) * F.lit(GAUGE_HEADROOM)
    band = (F.when(p > F.col("area_avg") * F.lit(BAND_RED_ABOVE), F.lit("red"))
            .when(p > F.col("area_avg") * F.lit(BAND_AMBER_ABOVE), F.lit("amber")).otherwise(F.lit("green")))
    return scored.select(*scored.columns, gmax.alias("gauge_max"),
                         (p / gmax * F.lit(100.0)).alias("gauge_pct"), band.alias("band"))


def upload_detail(rows: DataFrame, uploads: DataFrame, user_id: int, k: int = 100) -> DataFrame:
    """A user's uploaded rows with the upload's file name, newest k.
    The user filter is applied to both sides before the join."""
    r = rows.filter(F.col("user_id") == user_id)
    u = uploads.filter(F.col("user_id") == user_id).select(F.col("id").alias("upload_id"), "filename")
    out = r.join(u, "upload_id").select("upload_id", "line", "area", "waste_type", "date", "weight", "filename")
    return out.orderBy(*[F.desc(c) for c in out.columns]).limit(k)


def activity_log(logs: DataFrame, users: DataFrame, k: int = 100) -> DataFrame:
    """Newest k log rows with the user name, 'Anonymous' for missing users.

    The top-k is taken before the join, so only k rows meet the user table.
    """
    top = logs.orderBy(F.desc("id")).limit(k)
    u = users.select(F.col("id").alias("_uid"), "username")
    return (top.join(u, top["user_id"] == u["_uid"], "left")
            .select("id", "timestamp", "area", "waste_type", "prediction_date", "predicted_weight_kg",
                    "user_id", X.display_name("username").alias("username"))
            .orderBy(F.desc("id")))


def invalid_domain_rows(requests: DataFrame, domain_source: DataFrame) -> DataFrame:
    """Requests whose area or waste type is not in the known domains.

    The domains are distinct values (small), joined with left outer joins; the
    flags tell which field failed.
    """
    areas, na, types, nt = domain_tables(domain_source)
    areas = bounded_broadcast(areas.select(F.col("area").alias("_a"), F.lit(True).alias("_area_ok")), na)
    types = bounded_broadcast(types.select(F.col("waste_type").alias("_t"), F.lit(True).alias("_type_ok")), nt)
    j = (requests.join(areas, requests["area"] == areas["_a"], "left")
         .join(types, requests["waste_type"] == types["_t"], "left"))
    area_ok = F.coalesce(F.col("_area_ok"), F.lit(False))
    type_ok = F.coalesce(F.col("_type_ok"), F.lit(False))
    return (j.filter(~(area_ok & type_ok))
            .select("id", "area", "waste_type", area_ok.alias("area_ok"), type_ok.alias("type_ok")))


def valid_domain_rows(requests: DataFrame, domain_source: DataFrame) -> DataFrame:
    """C4: requests whose area and waste type are both known (semi joins)."""
    areas, na, types, nt = domain_tables(domain_source)
    return (requests.join(bounded_broadcast(areas, na), "area", "left_semi")
            .join(bounded_broadcast(types, nt), "waste_type", "left_semi"))


def resolve_login(attempts: DataFrame, users: DataFrame, identifier: str = "identifier") -> DataFrame:
    """``username = x OR email = x`` for a whole table of identifiers.

    The disjunction is turned into an equi-join: each user contributes one row
    per identity (username, email), so no nested-loop join is needed.
    """
    ids = users.select(F.col("id").alias("resolved_user_id"),
                       F.explode(F.array(F.col("username"), F.col("email"))).alias("_ident")).distinct()
    return (attempts.join(ids, attempts[identifier] == ids["_ident"], "left")
            .drop("_ident"))
