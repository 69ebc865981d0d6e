"""Model pipeline checks on small synthetic labels (FIXTURES §B: the driver's
prices carry no signal, so quality checks use a label with known effects)."""

import datetime as dt
import tempfile

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from binsight.models import score, train
from binsight.models.adaboost import fit_adaboost_r2
from binsight.models.catalog import make_estimator


def _synthetic(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    areas = ["A", "B", "C"]
    rows = []
    for i in range(n):
        a = int(rng.integers(0, 3))
        d = dt.date(2024, 1, 1) + dt.timedelta(days=int(rng.integers(0, 365)))
        y = 100 + 20 * a + 5 * d.month + float(rng.normal(0, 1))
        rows.append((i, areas[a], "t", d, y))
    return spark.createDataFrame(rows, "id long, area string, waste_type string, ticket_date date, y double")


def test_one_hot_unknown_is_zero_block(spark):
    df = train.add_calendar(_synthetic(spark, 50), "ticket_date")
    prep = Pipeline(stages=train.preprocessing_stages()).fit(df)
    req = spark.createDataFrame([(1, "zz", "t", dt.date(2024, 3, 1))], "id long, area string, waste_type string, ticket_date date")
    v = prep.transform(train.add_calendar(req, "ticket_date")).first()["features"].toArray()
    assert v[:3].sum() == 0.0  # unknown area: all-zero block, still scored


def test_linear_fit_recovers_effects_and_save_load(spark):
    df = train.prepare(_synthetic(spark), "y", "ticket_date")
    model = Pipeline(stages=train.preprocessing_stages() + [make_estimator("linear_regression")]).fit(df)
    pred = model.transform(df)
    m = train.regression_metrics(pred.withColumn("model_id", F.lit("lr"))).first()
    assert m["r2"] > 0.95 and m["mae"] < 15
    path = tempfile.mkdtemp(prefix="binsight-models-")
    paths = train.save_models({"linear_regression": model}, path)
    back = train.load_models(paths)["linear_regression"]
    a = [r["prediction"] for r in model.transform(df).orderBy("id").limit(5).collect()]
    b = [r["prediction"] for r in back.transform(df).orderBy("id").limit(5).collect()]
    assert a == b


def test_adaboost_learns_signal(spark):
    df = train.prepare(_synthetic(spark), "y", "ticket_date")
    m = fit_adaboost_r2(df, train.preprocessing_stages(), n_estimators=5)
    pred = m.transform(df)
    r = train.regression_metrics(pred.withColumn("model_id", F.lit("ada"))).first()
    assert r["r2"] > 0.5 and len(m.trees) >= 1


def test_leaderboard_zero_mae_last(spark):
    lb = spark.createDataFrame([("a", "A", "", "#1", 0.0, 1.0, 0.5), ("b", "B", "", "#2", 5.0, 1.0, 0.5),
                                ("c", "C", "", "#3", 3.0, 1.0, 0.5)],
                               "model_id string, name string, description string, color string, mae double, rmse double, r2 double")
    assert [r["model_id"] for r in score.leaderboard(lb).collect()] == ["c", "b", "a"]
    assert score.best_model(lb.filter("mae > 0")).first()["model_id"] == "c"


def test_score_all_models_clamps(spark):
    class Neg:
        def transform(self, df):
            return df.withColumn("prediction", F.lit(-3.2))
    req = spark.createDataFrame([(1, "A", "t", dt.date(2024, 1, 1))], "id long, area string, waste_type string, d date")
    out = score.score_all_models({"linear_regression": Neg()}, req, "d", "id").first()
    assert out["prediction"] == 0.0 and out["name"] == "Linear Regression"


def test_ridge_matches_closed_form(spark):
    """Ridge(alpha=1) mapped to Spark's objective equals the closed form with
    an unpenalised intercept (on the same one-hot + calendar features)."""
    from binsight.models.train import ridge_reg_param
    df = train.prepare(_synthetic(spark, 300, seed=11), "y", "ticket_date")
    prep = Pipeline(stages=train.preprocessing_stages()).fit(df)
    feats = prep.transform(df)
    model = make_estimator("ridge", ridge_reg=ridge_reg_param(df, "label")).fit(feats)
    rows = feats.select("features", "label").collect()
    X = np.array([r["features"].toArray() for r in rows])
    y = np.array([r["label"] for r in rows])
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + 1.0 * np.eye(X.shape[1]), Xc.T @ yc)
    b = y.mean() - X.mean(0) @ w
    want = X @ w + b
    got = np.array([r["prediction"] for r in model.transform(feats).select("prediction").collect()])
    assert np.max(np.abs(got - want)) < 1e-4 * np.max(np.abs(want))


def test_knn_and_adaboost_save_and_load(spark):
    from binsight.models.knn import fit_knn
    df = train.prepare(_synthetic(spark, 120), "y", "ticket_date")
    models = {"knn": fit_knn(df, k=5), "adaboost": fit_adaboost_r2(df, train.preprocessing_stages(), n_estimators=3)}
    back = train.load_models(train.save_models(models, tempfile.mkdtemp(prefix="binsight-models-")))
    for mid, m in models.items():
        a, b = ([(r.id, r.prediction) for r in x.transform(df).select("id", "prediction").orderBy("id").collect()] for x in (m, back[mid]))
        assert a == b, mid


def test_all_models_score_on_one_row(spark):
    class Constant:
        def __init__(self, p):
            self.p = p

        def transform(self, df):
            if self.p is None:
                raise ValueError("broken")
            return df.withColumn("prediction", F.lit(self.p))

    req = spark.createDataFrame([(1, "A", "t", dt.date(2024, 3, 1)), (2, "B", "t", dt.date(2024, 3, 2))],
                                "id long, area string, waste_type string, prediction_date date")
    models = {"ridge": Constant(2.005), "knn": Constant(-3.0), "adaboost": Constant(7.0), "other": Constant(7.0), "bad": Constant(None)}
    long = score.score_all_models(models, req, "prediction_date", "id")
    got = [(r.id, r["rank"], r.model_id, r.prediction) for r in long.orderBy("id", "rank").collect()]
    assert got[:4] == [(1, 1, "adaboost", 7.0), (1, 2, "other", 7.0), (1, 3, "ridge", 2.01), (1, 4, "knn", 0.0)] or got[2][3] == 2.0
    plan = long._jdf.queryExecution().toString()
    assert "hashpartitioning" not in plan
    one = score.ensemble_summary(models, req, "prediction_date", "id").orderBy("id").first()
    assert one.n_models == 4 and one.max_prediction == 7.0 and one.min_prediction == 0.0


def test_training_rows_are_dealt_over_all_cores(spark, monkeypatch):
    """A few rows are one task's read, but no one task's fit."""
    class Seen(Exception):
        pass

    def fit(rows, *args, **settings):
        raise Seen(rows.rdd.getNumPartitions(), rows.count())

    monkeypatch.setattr(train, "fit_models", fit)
    rows = spark.range(0, 1000, 1, 1).select("id", F.lit("a").alias("area"), F.lit("t").alias("waste_type"),
                                             F.lit("2020-01-01").cast("date").alias("ticket"), F.lit(1.5).alias("w"))
    with pytest.raises(Seen) as seen:
        train.train_eval(rows, "w", "ticket")
    assert seen.value.args == (spark.sparkContext.defaultParallelism, 800)


def test_models_are_fitted_at_the_same_time(spark):
    """Each of the two waits for the other; fitted one after the other, both fail and are left out."""
    import threading
    both = threading.Barrier(2, timeout=20)

    def fit(rows):
        both.wait()
        return rows.count()

    df = train.prepare(_synthetic(spark, 20), "y", "ticket_date")
    assert train.fit_models(df, ("one", "other"), {"one": fit, "other": fit}) == {"one": 20, "other": 20}


def test_adaboost_leaves_nothing_cached(spark):
    df = train.prepare(_synthetic(spark, 60), "y", "ticket_date")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    fit_adaboost_r2(df, train.preprocessing_stages(), n_estimators=4, checkpoint_every=3)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_forest_keeps_each_rows_nodes(spark):
    """Kept nodes give the trees that searching the forest in every pass gives."""
    df = train.prepare(_synthetic(spark), "y", "ticket_date")
    feats = Pipeline(stages=train.preprocessing_stages()).fit(df).transform(df).persist()
    forest = make_estimator("random_forest", forest_depth=4).setNumTrees(5)
    assert forest.getCacheNodeIds()
    trees = [f.fit(feats).toDebugString.split("\n", 1)[1] for f in (forest, forest.copy().setCacheNodeIds(False))]
    feats.unpersist()
    assert trees[0] == trees[1]


def test_a_model_that_fails_is_an_error(spark):
    """The others are fitted to the end, but their result is not passed off as the family."""
    def broken(rows):
        raise ValueError("no fit")

    done = []
    df = train.prepare(_synthetic(spark, 20), "y", "ticket_date")
    with pytest.raises(RuntimeError, match="broken: no fit"):
        train.fit_models(df, ("broken", "other"), {"broken": broken, "other": lambda rows: done.append(rows.count())})
    assert done == [20]


def test_trees_fit_rows_without_label_or_date(spark):
    """Such rows are left out of the fit, and a row without a date is left without a prediction."""
    df = train.prepare(_synthetic(spark, 60), "y", "ticket_date")
    odd = spark.createDataFrame([(1001, "A", "t", None, 5.0), (1002, "A", "t", dt.date(2024, 5, 5), None)],
                                "id long, area string, waste_type string, ticket_date date, y double")
    odd = df.unionByName(train.prepare(odd, "y", "ticket_date"))
    extra = {"adaboost": lambda rows: fit_adaboost_r2(rows, train.preprocessing_stages(), n_estimators=2)}
    whole, clean = (train.fit_models(rows, ("decision_tree", "adaboost"), extra) for rows in (odd, df))
    for mid, m in whole.items():
        got = {r.id: r.prediction for r in m.transform(odd).select("id", "prediction").collect()}
        assert got.pop(1001) is None and got.pop(1002) is not None, mid
        assert got == {r.id: r.prediction for r in clean[mid].transform(df).select("id", "prediction").collect()}, mid


def test_score_takes_the_default_model_only(spark, monkeypatch):
    from binsight.plans import q_models
    monkeypatch.setattr(q_models, "_family", lambda *a: ({"ridge": None}, None))
    monkeypatch.setattr(q_models, "_requests", lambda *a: None)
    with pytest.raises(KeyError, match="random_forest"):
        q_models.score_one(spark, "")
