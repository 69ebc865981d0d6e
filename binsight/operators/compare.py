"""Period comparison.

Periods are inclusive at both ends and may share a day; a row on a shared day
belongs to both periods.  Summaries are conditional aggregates over a single
scan (no join, one partial aggregation per task); row listings use a join with
the tiny period table, which is broadcast because its size is fixed (one row
per period).

Rounded outputs follow the reference: counts, and averages / totals rounded to
cents, feed the percent changes.  Rounding is done on exact integer cents
(HALF_UP), so the result does not depend on float summation order.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.functions import exprs as X

V = "predicted_weight_kg"
D = "prediction_date"

QUICK_PERIOD_DAYS = {"week": 7, "month": 30, "year": 365}  # any other value means year


def _in(date_col: str, lo, hi):
    return F.col(date_col).between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))


def _period_aggs(prefix: str, cond, value: str):
    cents = X.to_cents(value)
    return [F.count_if(cond).alias(f"{prefix}_n"), F.count_if(cond & F.col(value).isNotNull()).alias(f"{prefix}_v"),
            F.sum(F.when(cond, cents)).alias(f"{prefix}_sc"),
            F.min(F.when(cond, cents)).alias(f"{prefix}_minc"),
            F.max(F.when(cond, cents)).alias(f"{prefix}_maxc")]


def compare_periods(logs: DataFrame, period1, period2, area: str | None = None,
                    waste_type: str | None = None, value: str = V, date_col: str = D) -> DataFrame:
    """One row with count / avg / total / min / max of each period (rounded
    to cents) and the changes.  A period that is empty or not given has NULL
    statistics and there are no changes, as in the reference."""
    cond = X.all_of(F.col("area") == area if area else None,
                    F.col("waste_type") == waste_type if waste_type else None)
    df = logs.filter(cond)
    if period1 is None:
        df = df.withColumn("_p1", F.lit(False))
    else:
        df = df.withColumn("_p1", _in(date_col, *period1))
    if period2 is None:
        df = df.withColumn("_p2", F.lit(False))
    else:
        df = df.withColumn("_p2", _in(date_col, *period2))
    # only rows in some period are needed; the predicate reaches the scan
    ranges = [p for p in (period1, period2) if p is not None]
    if ranges:
        df = df.filter(F.col("_p1") | F.col("_p2"))
    g = df.agg(*_period_aggs("p1", F.col("_p1"), value), *_period_aggs("p2", F.col("_p2"), value))
    out = []
    for p in ("p1", "p2"):
        n = F.col(f"{p}_n")
        has = n > 0
        avg_c = X.half_up_div(F.col(f"{p}_sc"), F.col(f"{p}_v"))  # NULL values don't count, as in AVG
        out += [F.when(has, n).alias(f"{p}_count"),
                F.when(has, avg_c.cast("double") / F.lit(100.0)).alias(f"{p}_avg"),
                F.when(has, F.col(f"{p}_sc").cast("double") / F.lit(100.0)).alias(f"{p}_total"),
                F.when(has, F.col(f"{p}_minc").cast("double") / F.lit(100.0)).alias(f"{p}_min"),
                F.when(has, F.col(f"{p}_maxc").cast("double") / F.lit(100.0)).alias(f"{p}_max"),
                F.when(has, avg_c).alias(f"_{p}_avgc")]
    g = g.select(*out)
    both = (F.col("p1_count") > 0) & (F.col("p2_count") > 0)
    t1 = (F.col("p1_total") * 100).cast("decimal(38,0)")
    t2 = (F.col("p2_total") * 100).cast("decimal(38,0)")
    return g.select(
        *[c for c in g.columns if not c.startswith("_")],
        F.when(both, X.pct_change("p1_count", "p2_count")).alias("count_change"),
        F.when(both, X.pct_change("_p1_avgc", "_p2_avgc")).alias("avg_change"),
        F.when(both, X.pct_change(t1, t2)).alias("total_change"),
        F.when(both, (F.col("_p2_avgc") - F.col("_p1_avgc")).cast("double") / F.lit(100.0)).alias("avg_diff"),
        F.when(both, (t2 - t1).cast("double") / F.lit(100.0)).alias("total_diff"))


def period_table(spark: SparkSession, periods: list[tuple]) -> DataFrame:
    """Small table (label, lo, hi); its size is the number of periods."""
    return spark.createDataFrame(
        [(lab, date.fromisoformat(str(lo)), date.fromisoformat(str(hi))) for lab, lo, hi in periods],
        "period string, lo date, hi date")


def compare_rows(logs: DataFrame, spark: SparkSession, period1, period2, area: str | None = None,
                 waste_type: str | None = None, date_col: str = D) -> DataFrame:
    """The rows of each period (a shared boundary day appears in both),
    ordered by period and date.  Range join against the broadcast period table."""
    periods = [(lab, *p) for lab, p in (("period1", period1), ("period2", period2)) if p is not None]
    pt = F.broadcast(period_table(spark, periods))
    cond = X.all_of(F.col("area") == area if area else None,
                    F.col("waste_type") == waste_type if waste_type else None)
    lo = min(p[1] for p in periods)
    hi = max(p[2] for p in periods)
    df = logs.filter(cond & _in(date_col, lo, hi))  # pushed to the scan
    j = df.join(pt, F.col(date_col).between(pt["lo"], pt["hi"]))
    return (j.select("period", "id", date_col, V, "area", "waste_type")
            .orderBy("period", date_col, "id"))


def interval_join(rows: DataFrame, periods: DataFrame, date_col: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """C5 for any number of periods: every pair of a row and a period that holds its date, columns of both.

    A period is put into the bins of the level (widths of 1, 4, 16 ... days) that fits its length, up to
    five of them; a row looks into one bin of each level that occurs.  So rows and periods meet in
    an equality join on (level, bin), each pair once, and the dates are checked there.  A null date, or a
    period that ends before it begins, meets nothing.  No column of ``periods`` may have the name of one of ``rows``.
    """
    widths = F.array(*[F.lit(4 ** i) for i in range(1, 10)])
    length = F.datediff(hi, lo) + 1
    leveled = (periods.where(F.col(lo) <= F.col(hi)).withColumn("_level", F.size(F.filter(widths, lambda w: w <= length)))
               .withColumn("_bin", F.explode(F.expr(f"sequence(shiftright(unix_date(`{lo}`), 2 * _level), "
                                                    f"shiftright(unix_date(`{hi}`), 2 * _level))"))))
    levels = sorted(r[0] for r in leveled.select("_level").distinct().collect())  # ten at most
    if not levels:
        levels = [0]
    looked = (rows.where(F.col(date_col).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels])))
              .withColumn("_bin", F.expr(f"shiftright(unix_date(`{date_col}`), 2 * _level)")))
    return looked.join(leveled, ["_level", "_bin"]).where(F.col(date_col).between(F.col(lo), F.col(hi))).drop("_level", "_bin")


def quick_periods(as_of, kind: str):
    today = date.fromisoformat(str(as_of))
    days = QUICK_PERIOD_DAYS.get(kind, 365)
    return ((today - timedelta(days=days), today),
            (today - timedelta(days=2 * days), today - timedelta(days=days)))


def quick_compare(logs: DataFrame, as_of, kinds=("week", "month", "year"), value: str = V,
                  date_col: str = D) -> DataFrame:
    """Current vs previous period ending at ``as_of`` for each kind, one row
    per kind.  Empty periods give zeros.  All kinds come from one scan."""
    aggs, specs = [], []
    lo_all = None
    for k in kinds:
        cur, prev = quick_periods(as_of, k)
        lo_all = prev[0] if lo_all is None else min(lo_all, prev[0])
        for tag, (lo, hi) in (("cur", cur), ("prev", prev)):
            cond = _in(date_col, lo, hi)
            aggs += [F.count_if(cond).alias(f"{k}_{tag}_n"),
                     F.count_if(cond & F.col(value).isNotNull()).alias(f"{k}_{tag}_v"),
                     F.sum(F.when(cond, X.to_cents(value))).alias(f"{k}_{tag}_sc")]
        specs.append(k)
    df = logs.filter(F.col(date_col).between(F.lit(lo_all).cast("date"), F.lit(as_of).cast("date")))
    g = df.agg(*aggs)
    rows = []
    for k in specs:
        fields = [F.lit(k).alias("period")]
        for tag in ("cur", "prev"):
            n = F.col(f"{k}_{tag}_n")
            sc = F.coalesce(F.col(f"{k}_{tag}_sc"), F.lit(0).cast("decimal(38,0)"))
            fields += [n.alias(f"{tag}_n"), sc.alias(f"{tag}_sc"),
                       F.coalesce(X.half_up_div(sc, F.col(f"{k}_{tag}_v")), F.lit(0).cast("decimal(38,0)")).alias(f"{tag}_ac")]
        rows.append(F.struct(*fields))
    e = g.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return e.select(
        "period",
        F.col("cur_n").alias("current_count"),
        (F.col("cur_ac").cast("double") / F.lit(100.0)).alias("current_avg"),
        (F.col("cur_sc").cast("double") / F.lit(100.0)).alias("current_total"),
        F.col("prev_n").alias("previous_count"),
        (F.col("prev_ac").cast("double") / F.lit(100.0)).alias("previous_avg"),
        (F.col("prev_sc").cast("double") / F.lit(100.0)).alias("previous_total"),
        X.pct_change("prev_n", "cur_n").alias("count_change"),
        X.pct_change("prev_ac", "cur_ac").alias("avg_change"),
        X.pct_change("prev_sc", "cur_sc").alias("total_change"))


def change_by_key(logs: DataFrame, key: str, period1, period2, value: str = V,
                  date_col: str = D) -> DataFrame:
    """H11 for every key at once: count and total change between two periods."""
    c1, c2 = _in(date_col, *period1), _in(date_col, *period2)
    cents = X.to_cents(value)
    lo = min(period1[0], period2[0])
    hi = max(period1[1], period2[1])
    g = (logs.filter(_in(date_col, lo, hi)).groupBy(key)
         .agg(F.count_if(c1).alias("n1"), F.count_if(c2).alias("n2"),
              F.coalesce(F.sum(F.when(c1, cents)), F.lit(0).cast("decimal(38,0)")).alias("s1"),
              F.coalesce(F.sum(F.when(c2, cents)), F.lit(0).cast("decimal(38,0)")).alias("s2")))
    return g.select(key, F.col("n1").alias("count_1"), F.col("n2").alias("count_2"),
                    (F.col("s1").cast("double") / F.lit(100.0)).alias("total_1"),
                    (F.col("s2").cast("double") / F.lit(100.0)).alias("total_2"),
                    X.pct_change("n1", "n2").alias("count_change"),
                    X.pct_change("s1", "s2").alias("total_change"))
