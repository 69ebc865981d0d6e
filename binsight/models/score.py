"""Bulk scoring and model comparison."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.functions import exprs as X
from binsight.models.catalog import DEFAULT_COLOR, DEFAULT_MODEL, MODEL_INFO
from binsight.models.train import add_calendar
from binsight.session import ensure_checkpoint_dir

log = logging.getLogger(__name__)


def score(model, requests: DataFrame, date_col: str, clamp: bool = False) -> DataFrame:
    """Predictions for a whole table of (area, waste_type, date) requests.
    Single-model scoring is not clamped in the reference; ``clamp`` enables it."""
    out = model.transform(add_calendar(requests, date_col))
    p = X.clamp_non_negative("prediction") if clamp else F.col("prediction")
    return out.select(*requests.columns, p.alias("prediction"))


def score_wide(models: dict, requests: DataFrame, date_col: str) -> DataFrame:
    """One row per request: its columns and ``predictions``, an array of
    (model_id, prediction) by falling prediction, clamped at 0 and rounded to
    cents.  Each model adds a column to the row, so nothing is shuffled.  A
    model that fails is logged and left out; if all fail, that is an error.

    The request features are checkpointed once, so the models read them
    instead of each re-running the request plan (joins, scans)."""
    ensure_checkpoint_dir(requests.sparkSession)
    rows = add_calendar(requests, date_col).checkpoint(eager=True)
    found = []
    for mid, m in models.items():
        try:
            rows = m.transform(rows).select(*rows.columns, F.round(X.clamp_non_negative("prediction"), 2).alias(f"_p_{mid}"))
            found.append(mid)
        except Exception as ex:  # keep going, like the reference's scoring loop
            log.error("scoring with %s failed: %s", mid, ex)
    if not found:
        raise RuntimeError("no model could score the requests")
    pairs = F.array_sort(F.array(*[F.struct((-F.col(f"_p_{mid}")).alias("o"), F.lit(mid).alias("model_id"),
                                            F.col(f"_p_{mid}").alias("prediction")) for mid in found]))
    return rows.select(*requests.columns, F.transform(pairs, lambda p: F.struct(p["model_id"], p["prediction"])).alias("predictions"))


def score_all_models(models: dict, requests: DataFrame, date_col: str, request_key: str) -> DataFrame:
    """K12 + F7: every model's prediction per request (clamped at 0, rounded
    to cents), with the model's name and colour, and its rank within the
    request by value."""
    spark = requests.sparkSession
    long = score_wide(models, requests, date_col).select(request_key, F.posexplode("predictions").alias("pos", "p"))
    long = long.select(request_key, F.col("p.model_id").alias("model_id"), F.col("p.prediction").alias("prediction"),
                       (F.col("pos") + 1).alias("rank"))
    info = spark.createDataFrame([(k, v[0], v[2]) for k, v in MODEL_INFO.items()],
                                 "model_id string, name string, color string")
    return (long.join(F.broadcast(info), "model_id", "left")  # fixed 7-row table
            .select(request_key, "model_id", "prediction", F.coalesce("name", "model_id").alias("name"),
                    F.coalesce("color", F.lit(DEFAULT_COLOR)).alias("color"), "rank"))


def ensemble_summary(models: dict, requests: DataFrame, date_col: str, request_key: str) -> DataFrame:
    """Mean, min and max of the models' predictions per request (those that there are)."""
    own = F.filter(F.transform("predictions", lambda p: p["prediction"]), lambda x: x.isNotNull())
    rows = score_wide(models, requests, date_col).select(request_key, own.alias("p"))
    n = F.size("p")
    total = F.aggregate("p", F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x.cast("decimal(30,2)")).cast("decimal(38,2)"))
    return rows.select(request_key, F.when(n > 0, total.cast("double") / n).alias("mean_prediction"),
                       F.array_min("p").alias("min_prediction"), F.array_max("p").alias("max_prediction"),
                       n.cast("long").alias("n_models"))


def leaderboard(lb: DataFrame, current: str = DEFAULT_MODEL) -> DataFrame:
    """K13 + F6 + H19: models by MAE ascending, a zero or missing MAE last;
    metrics rounded like the reference (2, 2, 4 places), R^2 also as a
    percentage; ``is_current`` flag."""
    key = F.when(F.col("mae") > 0, F.col("mae"))
    return (lb.select("model_id", "name", "description", "color",
                      F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"),
                      F.round("r2", 4).alias("r2"), F.round(F.col("r2") * 100, 2).alias("r2_pct"),
                      (F.col("model_id") == current).alias("is_current"),
                      key.alias("_k"))
            .orderBy(F.col("_k").asc_nulls_last(), "model_id").drop("_k"))


def best_model(lb: DataFrame) -> DataFrame:
    """The model with the lowest MAE (one row)."""
    return lb.agg(F.min_by("model_id", "mae").alias("model_id"), F.min("mae").alias("mae"))


def write_leaderboard(lb: DataFrame, path: str) -> None:
    """One JSON line per model."""
    lb.write.mode("overwrite").json(path)


LEGACY_SCHEMA = "map<string, struct<name: string, description: string, color: string, mae: double, rmse: double, r2: double, path: string>>"


def read_leaderboard(spark: SparkSession, path: str, legacy: bool = False) -> DataFrame:
    """Read the leaderboard; ``legacy=True`` reads the reference's single
    JSON object {model_id: {...}} and flattens it to one row per model.  A
    missing file gives the default single-model entry."""
    try:
        if legacy:
            txt = spark.read.text(path, wholetext=True)
            m = txt.select(F.explode(F.from_json("value", LEGACY_SCHEMA)).alias("model_id", "info"))
            return m.select("model_id", "info.*")
        return spark.read.json(path)
    except AnalysisException as ex:
        if ex.getCondition() != "PATH_NOT_FOUND":
            raise
        name, desc, color = MODEL_INFO[DEFAULT_MODEL]
        return spark.createDataFrame([(DEFAULT_MODEL, name, desc, color, 0.0, 0.0, 0.0)],
                                     "model_id string, name string, description string, color string, "
                                     "mae double, rmse double, r2 double")
