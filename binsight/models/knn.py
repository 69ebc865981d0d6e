"""Exact k-nearest-neighbour regression on the calendar features.

Features are the reference's: one-hot area, one-hot waste type, and the
unscaled integers year, month, day, dayofweek.  The squared distance between a
request and a training row is therefore an integer:

    d2 = pa*[area differs] + pt*[type differs] + dy^2 + dm^2 + dd^2 + dw^2

with pa = 2 (pt = 2), or 1 when the request's area (type) is unknown to the
training data (its one-hot block is all zero).

Training rows are reduced to count and label sum per calendar date, per
(date, area), per (date, type) and per (date, area, type).  For each distinct
request (area, type, date), candidate training dates are generated from
calendar offsets with dy^2 + dm^2 + dd^2 <= rho (``sequence`` generators per
row, not a join with all dates) and equi-joined to those aggregates.  This
yields at most four (distance, count, sum) buckets per candidate date, so no
pair of request and training *rows* is ever formed.  Buckets are accumulated
in distance order per request group.  Every row with d2 <= rho is among the
candidates, so when the k-th nearest row is within rho the answer is exact.
Unresolved groups are retried with a larger rho, up to the calendar span of
the data, where every training date is a candidate.

Ties at the k-th distance: all rows strictly closer are used, and the
remaining slots take the mean of the rows at exactly that distance (the
reference leaves the choice to its neighbour search's internal order).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from binsight.models.train import add_calendar
from binsight.operators.joins import bounded_broadcast, measured_bytes
from binsight.session import ensure_checkpoint_dir

CAL = ["year", "month", "day", "dayofweek"]
TABLES = ("date", "date_area", "date_type", "cell", "areas", "types", "all")
GROUP = ["area", "waste_type", "year", "month", "day", "dayofweek"]


def _cp(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class KnnRegressorModel:
    def __init__(self, tables: dict, n_train: int, years: tuple[int, int], k: int, label: str):
        self.t, self.n_train, self.years, self.k, self.label = tables, n_train, years, k, label

    # ------------------------------------------------------------------ search
    def _round(self, q: DataFrame, rho: int) -> DataFrame:
        """Buckets within squared calendar radius ``rho`` for request groups ``q``."""
        r = math.isqrt(rho)
        seq = lambda lo, hi: F.sequence(F.lit(lo), F.lit(hi))
        # offsets once per distinct request date, held against the training dates
        # before groups (area, type) meet them
        day = ["year", "month", "day"]
        near = (q.select(*day).distinct()
                .withColumn("dy", F.explode(seq(-r, r)))
                .where((F.col("year") + F.col("dy")).between(*self.years))
                .withColumn("dm", F.explode(seq(-min(r, 11), min(r, 11))))
                .where((F.col("month") + F.col("dm")).between(1, 12)
                       & (F.col("dy") * F.col("dy") + F.col("dm") * F.col("dm") <= rho))
                .withColumn("dd", F.explode(seq(-min(r, 30), min(r, 30))))
                .where((F.col("day") + F.col("dd")).between(1, 31))
                .select(*day, (F.col("year") + F.col("dy")).alias("y2"), (F.col("month") + F.col("dm")).alias("m2"),
                        (F.col("day") + F.col("dd")).alias("d2"),
                        (F.col("dy") * F.col("dy") + F.col("dm") * F.col("dm") + F.col("dd") * F.col("dd")).alias("cal"))
                .where(F.col("cal") <= rho))
        t = {k: bounded_broadcast(v, self.sizes[k]) if k in self.sizes else v for k, v in self.t.items()}
        near = near.join(t["date"], ["y2", "m2", "d2"])  # only dates that exist in training
        j = q.select("gid", "pa", "pt", "area", "waste_type", "dayofweek", *day).join(near, day)
        j = j.withColumn("cal", F.col("cal") + (F.col("dayofweek") - F.col("w2")) * (F.col("dayofweek") - F.col("w2")))
        j = j.filter(F.col("cal") <= rho)
        j = (j.join(t["date_area"], ["y2", "m2", "d2", "area"], "left")
             .join(t["date_type"], ["y2", "m2", "d2", "waste_type"], "left")
             .join(t["cell"], ["y2", "m2", "d2", "area", "waste_type"], "left"))
        z = lambda c: F.coalesce(F.col(c), F.lit(0))
        zs = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,6)")  # exact: sums are subtracted
        cal, pa, pt = F.col("cal"), F.col("pa"), F.col("pt")
        buckets = F.array(
            F.struct(cal.alias("dist"), z("n_at").alias("cnt"), zs("s_at").alias("sm")),
            F.struct((cal + pt).alias("dist"), (z("n_a") - z("n_at")).alias("cnt"), (zs("s_a") - zs("s_at")).alias("sm")),
            F.struct((cal + pa).alias("dist"), (z("n_t") - z("n_at")).alias("cnt"), (zs("s_t") - zs("s_at")).alias("sm")),
            F.struct((cal + pa + pt).alias("dist"), (F.col("n") - z("n_a") - z("n_t") + z("n_at")).alias("cnt"),
                     (zs("s") - zs("s_a") - zs("s_t") + zs("s_at")).alias("sm")))
        b = j.select("gid", F.explode(buckets).alias("b")).select("gid", "b.*")
        b = b.filter((F.col("cnt") > 0) & (F.col("dist") <= rho))
        # per group and distance; a group has at most rho + 5 distinct distances
        return b.groupBy("gid", "dist").agg(F.sum("cnt").alias("cnt"), F.sum("sm").alias("sm"))

    def _resolve(self, levels: DataFrame) -> DataFrame:
        """Per group: k-th distance and prediction; groups with fewer than k rows
        within the radius get a NULL prediction (retried with a larger rho)."""
        k = self.k
        w = W.partitionBy("gid").orderBy("dist").rowsBetween(W.unboundedPreceding, W.currentRow)
        lv = (levels.withColumn("run_cnt", F.sum("cnt").over(w)).withColumn("run_sm", F.sum("sm").over(w))
              .withColumn("lt_cnt", F.col("run_cnt") - F.col("cnt")).withColumn("lt_sm", F.col("run_sm") - F.col("sm")))
        hit = lv.filter((F.col("run_cnt") >= k) & (F.col("lt_cnt") < k))  # the level holding the k-th row
        d = lambda c: F.col(c).cast("double")
        pred = (d("lt_sm") + (F.lit(k) - F.col("lt_cnt")) * d("sm") / F.col("cnt")) / F.lit(k)
        return hit.select("gid", pred.alias("prediction"), F.col("dist").alias("kth_dist2"))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (and ``kth_dist2``) to each request row."""
        req = add_calendar(df, self._date_col) if self._date_col else df
        dom_a, dom_t = self.t["areas"], self.t["types"]
        groups = (req.select(*GROUP).distinct()
                  .join(dom_a, "area", "left").join(dom_t, "waste_type", "left")
                  .select(*GROUP, F.when(F.col("_ka").isNull(), F.lit(1)).otherwise(F.lit(2)).alias("pa"),
                          F.when(F.col("_kt").isNull(), F.lit(1)).otherwise(F.lit(2)).alias("pt"))
                  # a unique id per group; fixed by the checkpoint below
                  .withColumn("gid", F.monotonically_increasing_id()))
        groups = _cp(groups)
        yr = groups.agg(F.min("year").alias("a"), F.max("year").alias("b")).first()
        y0, y1 = self.years
        span = max(y1, yr["b"] if yr["b"] is not None else y1) - min(y0, yr["a"] if yr["a"] is not None else y0)
        rho_max = span ** 2 + 11 ** 2 + 30 ** 2 + 6 ** 2
        rho, pending, done = 4, groups, []
        while True:
            rho = min(rho, rho_max)
            res = _cp(self._resolve(self._round(pending, rho)))
            done.append(res)
            pending = _cp(pending.join(res, "gid", "left_anti"))
            if pending.isEmpty():
                break
            if rho >= rho_max:
                # fewer than k training rows in total: mean of all of them
                allm = self.t["all"].select((F.col("s").cast("double") / F.col("n")).alias("prediction"),
                                            F.lit(None).cast("long").alias("kth_dist2"))
                done.append(pending.select("gid").crossJoin(allm))  # all is one row
                break
            rho *= 4
        preds = done[0]
        for d in done[1:]:
            preds = preds.unionByName(d)
        keyed = groups.select(*[F.col(c).alias(f"_g_{c}") for c in GROUP], "gid").join(preds, "gid")
        cond = None
        for c in GROUP:
            e = req[c].eqNullSafe(keyed[f"_g_{c}"])
            cond = e if cond is None else cond & e
        return req.join(keyed, cond, "left").drop("gid", *[f"_g_{c}" for c in GROUP])

    _date_col = None
    sizes: dict = {}

    def save(self, path: str) -> None:
        """The search tables, and one row of parameters."""
        for name, df in self.t.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.t["all"].sparkSession
        (spark.createDataFrame([(self.n_train, *self.years, self.k, self.label, self._date_col)],
                               "n_train long, y0 int, y1 int, k int, label string, date_col string")
         .write.mode("overwrite").parquet(f"{path}/params"))

    @classmethod
    def load(cls, path: str) -> KnnRegressorModel:
        spark = SparkSession.getActiveSession()
        p = spark.read.parquet(f"{path}/params").first()
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
        model = cls(tables, p["n_train"], (p["y0"], p["y1"]), p["k"], p["label"])
        model.sizes = {k: measured_bytes(tables[k]) for k in ("date", "date_area", "date_type", "cell")}
        model._date_col = p["date_col"]
        return model


def fit_knn(train: DataFrame, k: int = 5, label: str = "label", date_col: str | None = None) -> KnnRegressorModel:
    """Aggregate the training rows into the per-date tables used by the search.
    ``train`` has area, waste_type, label and either calendar columns or
    ``date_col``."""
    t = add_calendar(train, date_col) if date_col else train
    t = t.select(*GROUP, F.col(label).cast("decimal(20,6)").alias("_y"))
    key = [F.col("year").alias("y2"), F.col("month").alias("m2"), F.col("day").alias("d2")]
    tables = {
        "date": _cp(t.groupBy(*key, F.col("dayofweek").alias("w2"))
                    .agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"))),
        "date_area": _cp(t.groupBy(*key, "area").agg(F.count(F.lit(1)).alias("n_a"), F.sum("_y").alias("s_a"))),
        "date_type": _cp(t.groupBy(*key, "waste_type").agg(F.count(F.lit(1)).alias("n_t"), F.sum("_y").alias("s_t"))),
        "cell": _cp(t.groupBy(*key, "area", "waste_type").agg(F.count(F.lit(1)).alias("n_at"), F.sum("_y").alias("s_at"))),
        "areas": _cp(t.select("area").distinct().withColumn("_ka", F.lit(True))),
        "types": _cp(t.select("waste_type").distinct().withColumn("_kt", F.lit(True))),
    }
    stats = t.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.min("year").alias("y0"),
                  F.max("year").alias("y1"))
    tables["all"] = _cp(stats)
    row = tables["all"].first()
    # bytes of the search tables: each is broadcast to the candidate
    # join only when within the broadcast bound (the per-date table has one
    # row per training date, bounded by the calendar)
    sizes = {k: measured_bytes(tables[k]) for k in ("date", "date_area", "date_type", "cell")}
    model = KnnRegressorModel(tables, int(row["n"]), (int(row["y0"] or 0), int(row["y1"] or 0)), k, label)
    model.sizes = sizes
    model._date_col = date_col
    return model
