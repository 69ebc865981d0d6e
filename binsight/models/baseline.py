"""Historical-average baselines and their error metrics.

Three baseline predictors are fitted on a history table: the area mean, the
waste-type mean and the overall mean (unseen groups fall back to the overall
mean).  Their errors against observed values are computed with decimal sums so
the metrics do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight.functions import exprs as X


BASELINES = ("area_mean", "type_mean", "overall_mean")


def baseline_columns(history: DataFrame, observed: DataFrame, value: str = "net_weight_kg") -> DataFrame:
    """One row per observed row: label and a prediction column per baseline."""
    from binsight.operators.joins import bounded_broadcast, history_cells
    cells, size = history_cells(history, value)
    mean = F.sum("_s").cast("double") / F.sum("_n")
    a = bounded_broadcast(cells.groupBy(F.col("area").alias("_a")).agg(mean.alias("_am")), size)
    t = bounded_broadcast(cells.groupBy(F.col("waste_type").alias("_t")).agg(mean.alias("_tm")), size)
    o = cells.agg(mean.alias("_om"))
    j = (observed.join(a, observed["area"] == a["_a"], "left")
         .join(t, observed["waste_type"] == t["_t"], "left")
         .crossJoin(F.broadcast(o)))  # one row
    return j.select(F.col(value).alias("label"), F.coalesce("_am", "_om").alias("area_mean"),
                    F.coalesce("_tm", "_om").alias("type_mean"), F.col("_om").alias("overall_mean"))


def exact_metrics(wide: DataFrame, models=BASELINES, label: str = "label") -> DataFrame:
    """MAE, RMSE, R^2 of each model's prediction column, from decimal sums of |e|,
    e^2 and (y - mean)^2.  The mean comes from one aggregate over the labels (one
    row), everything else from one pass; no row is shuffled or repeated per model."""
    y = F.col(label)
    mean = wide.agg((F.sum(y.cast(X.EXACT)).cast("double") / F.count(y)).alias("_mean"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum(((y - F.col("_mean")) * (y - F.col("_mean"))).cast("decimal(38,4)")).alias("_sst")]
    for m in models:
        e = y - F.col(m)
        sums += [F.sum(F.abs(e).cast("decimal(38,6)")).alias(f"_a_{m}"), F.sum((e * e).cast("decimal(38,4)")).alias(f"_q_{m}")]
    one = wide.crossJoin(F.broadcast(mean)).agg(*sums)
    rows = F.array(*[F.struct(F.lit(m).alias("model_id"), F.col(f"_a_{m}").alias("sae"), F.col(f"_q_{m}").alias("sse")) for m in models])
    out = one.select("n", "_sst", F.explode(rows).alias("r")).select("n", "_sst", "r.*")
    return out.select("model_id", "n", (F.col("sae").cast("double") / F.col("n")).alias("mae"),
                      F.sqrt(F.col("sse").cast("double") / F.col("n")).alias("rmse"),
                      (F.lit(1.0) - F.col("sse").cast("double") / F.nullif(F.col("_sst").cast("double"), F.lit(0.0)))
                      .alias("r2"))


class MeanModel:
    """A closed-form predictor with a model's interface: the history's mean by ``key``
    (overall where the key is unknown, or None)."""

    def __init__(self, history: DataFrame, key: str | None, value: str = "net_weight_kg"):
        from binsight.operators.joins import history_cells
        self.key = key
        self.cells, self.size = history_cells(history, value)

    def transform(self, df: DataFrame) -> DataFrame:
        from binsight.operators.joins import bounded_broadcast
        mean = F.sum("_s").cast("double") / F.sum("_n")
        out = df.crossJoin(F.broadcast(self.cells.agg(mean.alias("_om"))))  # one row
        if self.key is None:
            return out.withColumn("prediction", F.col("_om"))
        means = bounded_broadcast(self.cells.groupBy(F.col(self.key).alias("_k")).agg(mean.alias("_km")), self.size)
        return out.join(means, out[self.key] == means["_k"], "left").withColumn("prediction", F.coalesce("_km", "_om"))


def mean_models(history: DataFrame, value: str = "net_weight_kg") -> dict[str, MeanModel]:
    keys = dict(zip(BASELINES, ("area", "waste_type", None), strict=True))
    return {name: MeanModel(history, key, value) for name, key in keys.items()}
