"""Feature preparation, training and evaluation.

Training data stays distributed: features are Spark columns, estimators are
Spark ML, and evaluation is one aggregate grouped by model id.  Only scalars
(counts, a label standard deviation) and fitted model objects reach the
driver.
"""

from __future__ import annotations

import logging
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight.functions import exprs as X
from binsight.session import ensure_checkpoint_dir, scratch_path
from binsight.models.cells import packed, shared
from binsight.models.linear import fit_linear
from binsight.models.catalog import MODEL_INFO, SEED, SPARK_ML_MODELS, make_estimator

log = logging.getLogger(__name__)

CATEGORICAL = ["area", "waste_type"]
NUMERIC = ["year", "month", "day", "dayofweek"]
#: Ridge penalty of the reference's linear models.
LINEAR_ALPHA = {"linear_regression": 0.0, "ridge": 1.0}


def add_calendar(df: DataFrame, date_col: str) -> DataFrame:
    """K1: year, month, day, dayofweek (Monday=0) as int columns."""
    d = F.col(date_col)
    return (df.withColumn("year", F.year(d).cast("int")).withColumn("month", F.month(d).cast("int"))
            .withColumn("day", F.dayofmonth(d).cast("int")).withColumn("dayofweek", X.weekday_mon0(d)))


def preprocessing_stages(categorical=CATEGORICAL, numeric=NUMERIC, out: str = "features") -> list:
    """K2: one-hot of the categorical columns (unknown values -> all-zero
    block), numeric columns passed through unscaled, then assembled."""
    idx = [f"{c}_idx" for c in categorical]
    oh = [f"{c}_oh" for c in categorical]
    return [StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep",
                          stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=idx, outputCols=oh, dropLast=True),
            VectorAssembler(inputCols=oh + list(numeric), outputCol=out, handleInvalid="keep")]


def null_where_unknown(numeric=NUMERIC, raw: str = "_raw", out: str = "prediction") -> SQLTransformer:
    """The last stage of a tree model: a row without a date has no prediction, as in the linear models."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in numeric)
    return SQLTransformer(statement=f"SELECT * EXCEPT ({raw}), IF({known}, {raw}, NULL) AS {out} FROM __THIS__")


def random_split(df: DataFrame, key: str = "id", test_pct: int = 20, seed: int = SEED) -> DataFrame:
    """K3: ``is_test`` from a hash (md5) of seed and key: the same rows are held out
    whatever the partitioning (the test share is approximately test_pct %)."""
    digest = F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return df.withColumn("is_test", F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100 < test_pct)


#: Bits of the hash by which a pass of ``exact_split`` narrows the threshold down: 2 ** 15 counts reach the driver.
_SPLIT_BITS, _SPLIT_PASSES = 15, 4


def exact_split(df: DataFrame, key: str = "id", test_pct: int = 20, seed: int = SEED) -> DataFrame:
    """K3: ``is_test`` for exactly ceil(test_pct % of the rows), those of the least hashes (md5) of seed and key:
    the same rows whatever the partitioning.

    Their largest hash is found by counting, not sorting: each pass counts the rows by the next bits of
    the hash among those that share the bits known so far, and ends as soon as the rows up to the
    end of a group are just as many.  Rows of one key stay together: where the last key of the
    test part has several rows, all of them are in it.  A null key counts as empty.
    """
    digest = F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    hashed = F.conv(F.substring(digest, 1, _SPLIT_BITS * _SPLIT_PASSES // 4), 16, 10).cast("bigint")
    path = scratch_path(df.sparkSession, "split")
    df.select(hashed.alias("h")).write.parquet(path)  # the passes read eight bytes a row instead of making the rows again
    numbers = df.sparkSession.read.schema("h long").parquet(path)
    known, below, wanted = 0, 0, None  # bits known so far, rows of smaller hashes, rows to take
    for i in range(_SPLIT_PASSES):
        shift = _SPLIT_BITS * (_SPLIT_PASSES - 1 - i)
        group = F.shiftright("h", shift)
        some = numbers.where(F.shiftright("h", shift + _SPLIT_BITS) == known) if i else numbers
        counts = sorted((r["g"], r["n"]) for r in some.groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect())
        if wanted is None:
            wanted = -(-sum(n for _, n in counts) * test_pct // 100)
            if not wanted:
                return df.withColumn("is_test", F.lit(False))
        for known, n in counts:
            below += n
            if below >= wanted:
                break
        if below == wanted or not shift:
            return df.withColumn("is_test", F.shiftright(hashed, shift) <= known)
        below -= n
    raise AssertionError("unreachable")


def ridge_reg_param(train: DataFrame, label: str, alpha: float = 1.0) -> float:
    """sklearn Ridge(alpha) in Spark's objective: alpha * stddev_pop(y) / n."""
    r = train.agg(F.stddev_pop(label).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return float(alpha) * float(r["s"] or 0.0) / max(int(r["n"]), 1)


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       by: str | list[str] = "model_id") -> DataFrame:
    """MAE, RMSE and R^2 per group in one aggregate.
    R^2 = 1 - SSE / (n * var_pop(y)); NULL when y is constant."""
    e = F.col(label) - F.col(prediction)
    keys = [by] if isinstance(by, str) else list(by)
    g = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"),
                                F.avg(e * e).alias("_mse"), F.sum(e * e).alias("_sse"),
                                F.var_pop(label).alias("_var"))
    return g.select(*keys, "n", "mae", F.sqrt("_mse").alias("rmse"),
                    (F.lit(1.0) - F.col("_sse") / F.nullif(F.col("_var") * F.col("n"), F.lit(0.0))).alias("r2"))


def prepare(df: DataFrame, label: str, date_col: str, key: str = "id") -> DataFrame:
    return add_calendar(df, date_col).select(key, *CATEGORICAL, *NUMERIC, F.col(label).cast("double").alias("label"))


def fit_tree(model_id: str, train: DataFrame, **settings):
    """K4, K5, K7: the estimator's trees, grown from sums per cell (``models.cells``) with its own numbers of
    trees, rounds and levels, or by Spark ML where there are too many cells."""
    est = make_estimator(model_id, **settings)
    with packed(train, CATEGORICAL, NUMERIC) as cells:
        if cells is not None:
            if model_id == "random_forest":
                return cells.forest(est.getNumTrees(), est.getMaxDepth(), est.getSeed())
            if model_id == "gradient_boosting":
                return cells.boosting(est.getMaxIter(), est.getMaxDepth(), est.getStepSize())
            if model_id == "decision_tree":
                return cells.tree(est.getMaxDepth())
    stages = preprocessing_stages() + [est.setPredictionCol("_raw"), null_where_unknown()]
    return Pipeline(stages=stages).fit(train.dropna(subset=["label", *NUMERIC]))


def fit_models(train: DataFrame, model_ids=SPARK_ML_MODELS, extra_estimators: dict | None = None,
               **settings) -> dict:
    """Fit every model.  A model that fails doesn't stop the others, but it is an error once they
    are done: what is scored or ranked without it would look like the whole family.
    The models are fitted at the same time: AdaBoost is many short jobs one after
    the other, which leave cores to the forest's.
    The linear models are solved on the full one-hot design (``models.linear``);
    ``settings`` (such as ``forest_depth``) go to ``make_estimator``.  As the linear models do,
    trees leave rows without a label or a date out."""
    failed = {}

    def fit(mid):
        try:
            if extra_estimators and mid in extra_estimators:
                return extra_estimators[mid](train)
            if mid in LINEAR_ALPHA:
                return fit_linear(train, CATEGORICAL, NUMERIC, alpha=LINEAR_ALPHA[mid])
            return fit_tree(mid, train, **settings)
        except Exception as ex:  # the others go on, like the reference's training loop
            log.error("training %s failed: %s", mid, ex)
            failed[mid] = ex

    ids = list(model_ids)
    with shared(train), ThreadPool(max(len(ids), 1)) as pool:
        models = pool.map(inheritable_thread_target(train.sparkSession)(fit), ids)
    if failed:
        raise RuntimeError(f"training failed: {'; '.join(f'{m}: {ex}' for m, ex in failed.items())}") from next(iter(failed.values()))
    return dict(zip(ids, models, strict=True))


def predict_long(models: dict, df: DataFrame, keep: list[str]) -> DataFrame:
    """Predictions of every model as one long table (model_id, keep..., prediction)."""
    parts = [m.transform(df).select(F.lit(mid).alias("model_id"), *keep, "prediction")
             for mid, m in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leaderboard_frame(spark, metrics: DataFrame) -> DataFrame:
    """Attach name / description / colour to per-model metrics."""
    info = spark.createDataFrame([(k, *v) for k, v in MODEL_INFO.items()],
                                 "model_id string, name string, description string, color string")
    return metrics.join(F.broadcast(info), "model_id", "left")  # fixed 7-row table


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores: a few MB a million rows would be left in one task, but fitting costs far
    more than reading, and each tree's pass goes over all rows."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 2), *df.columns)


def train_eval(df: DataFrame, label: str, date_col: str, model_ids=SPARK_ML_MODELS, key: str = "id",
               in_sample: bool = False, test_pct: int = 20, extra_estimators: dict | None = None, **settings):
    """Split, fit all models, evaluate all of them in one aggregate.

    ``in_sample=True`` fits on all rows and scores the held-out subset, like
    the reference's training script (its published metrics are in-sample).
    Returns (fitted models, leaderboard DataFrame).  The training rows are cached
    while models are fitted and scored; the leaderboard is checkpointed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    data = spread(exact_split(prepare(df, label, date_col, key), key, test_pct)).persist()
    train = data if in_sample else data.filter(~F.col("is_test"))
    test = data.filter(F.col("is_test"))
    try:
        data.count()  # cached before the models, which are fitted at the same time, read it
        models = fit_models(train, model_ids, extra_estimators, **settings)
        metrics = regression_metrics(predict_long(models, test, ["label"]))
        return models, leaderboard_frame(df.sparkSession, metrics).checkpoint(eager=True)
    finally:
        data.unpersist()


def save_models(models: dict, base_path: str) -> dict:
    """One saved model per id (its kind beside it, see ``load_models``); returns id -> path."""
    paths = {}
    for mid, m in models.items():
        p = f"{base_path.rstrip('/')}/{mid}_model"
        if isinstance(m, PipelineModel):
            m.write().overwrite().save(p)
        else:
            m.save(p)
        paths[mid] = p
    return paths


def _loader(module: str, name: str):
    def load(path):
        import importlib
        return getattr(importlib.import_module(module), name).load(path)
    return load


def _load_linear(path):
    from binsight.models.linear import LinearCells
    try:
        return LinearCells.load(path)
    except AnalysisException:  # a pipeline
        return PipelineModel.load(path)


def _load_trees(path):
    from binsight.models.cells import CellTrees
    try:
        return CellTrees.load(path)
    except AnalysisException:  # a pipeline
        return PipelineModel.load(path)


# Models that aren't Spark ML pipelines, or needn't be.
LOADERS = {"knn": _loader("binsight.models.knn", "KnnRegressorModel"),
           "adaboost": _loader("binsight.models.adaboost", "AdaBoostR2Model"),
           **dict.fromkeys(LINEAR_ALPHA, _load_linear),
           **dict.fromkeys(("random_forest", "gradient_boosting", "decision_tree"), _load_trees)}


def load_models(paths: dict) -> dict:
    """Load saved models; missing or unreadable ones are skipped."""
    out = {}
    for mid, p in paths.items():
        try:
            out[mid] = LOADERS.get(mid, PipelineModel.load)(p)
        except Exception as ex:
            log.error("loading %s failed: %s", mid, ex)
    return out


def lag_model(df: DataFrame, value: str, date_col: str, key: str = "id", test_size: float = 0.2):
    """Calendar + lag-1 features, ordered split (last 20 % is test), linear
    regression, metrics on the test part.  Returns (model, metrics frame)."""
    from pyspark.ml.regression import LinearRegression

    from binsight.operators.ordered import lag_global, scratch, temporal_split
    ensure_checkpoint_dir(df.sparkSession)
    base = df.select(key, date_col, F.col(value).cast("double").alias("label"))
    feats = VectorAssembler(inputCols=NUMERIC + ["lag_1"], outputCol="features")
    with scratch(df.sparkSession):
        lagged = lag_global(base, "label", [date_col, key]).na.drop("any")
        split = temporal_split(add_calendar(lagged, date_col), [date_col, key], test_size)
        train = split.filter(F.col("split") == "train")
        test = split.filter(F.col("split") == "test")
        model = Pipeline(stages=[feats, LinearRegression(regParam=0.0)]).fit(train)
        pred = model.transform(test).withColumn("model_id", F.lit("lag_linear"))
        return model, regression_metrics(pred).checkpoint(eager=True)  # one row
