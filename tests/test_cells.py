"""Trees grown from sums per cell against Spark ML's on the rows."""

import datetime as dt
import tempfile

import numpy as np
import pytest

from binsight.models import cells, train
from binsight.models.adaboost import AdaBoostR2Model, fit_adaboost_r2

EXTRA = {"adaboost": lambda rows: fit_adaboost_r2(rows, train.preprocessing_stages(), n_estimators=6, checkpoint_every=2)}


def _rows(spark, n=300):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        a, t = int(rng.integers(0, 3)), int(rng.integers(0, 2))
        d = dt.date(2023, 1, 1) + dt.timedelta(days=int(rng.integers(0, 600)))
        rows.append((i, ["A", "B", None][a], "tu"[t], d, 100.0 + 20 * a + 7 * t + 5 * d.month + float(rng.normal(0, 3))))
    return train.prepare(spark.createDataFrame(rows, "id long, area string, waste_type string, ticket_date date, y double"), "y", "ticket_date")


def _predictions(model, df):
    return {r.id: r.prediction for r in model.transform(df).select("id", "prediction").collect()}


@pytest.fixture(scope="module")
def data(spark):
    df = _rows(spark).persist()
    yield df
    df.unpersist()


@pytest.mark.parametrize("mid", ["decision_tree", "gradient_boosting", "adaboost"])
def test_trees_from_cells_are_spark_mls(spark, data, monkeypatch, mid):
    mine = train.fit_models(data, (mid,), EXTRA)[mid]
    monkeypatch.setattr(cells, "MAX_CELLS", 0)  # too many cells: Spark ML's trees
    theirs = train.fit_models(data, (mid,), EXTRA)[mid]
    assert isinstance(mine, cells.CellTrees) and not isinstance(theirs, cells.CellTrees)
    a, b = _predictions(mine, data), _predictions(theirs, data)
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_boosting_takes_a_few_jobs_whatever_its_rounds(spark, data):
    spark.sparkContext.setJobGroup("boosting", "boosting")
    try:
        model = train.fit_tree("gradient_boosting", data)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("boosting")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(model.trees) == 100 and len(jobs) < 40


def test_forest_draws_each_row_anew_for_each_tree(spark, data):
    forest = train.fit_tree("random_forest", data, forest_depth=4)
    assert len(forest.trees) == 100 and len({t.value.tobytes() for t in forest.trees}) == 100
    # the root of a tree is its draw's mean: they scatter as means of draws with replacement do
    y = np.array([r.label for r in data.collect()])
    roots = np.array([t.value[0] for t in forest.trees])
    assert abs(roots.mean() - y.mean()) < 5 * y.std() / np.sqrt(len(y) * 100)
    assert 0.7 < roots.std() / (y.std() / np.sqrt(len(y))) < 1.3


def test_a_cell_of_many_rows_is_dealt_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(cells, "PART_ROWS", 100)
    day = dt.date(2024, 2, 2)
    rows = spark.createDataFrame([(i, "A", "t", day, float(i)) for i in range(500)] + [(900, "B", "t", day, 3.0)],
                                 "id long, area string, waste_type string, ticket_date date, y double")
    df = train.prepare(rows, "y", "ticket_date")
    with cells.packed(df, train.CATEGORICAL, train.NUMERIC) as found:
        sizes = [len(r.y) // 8 for r in found.rows.collect()]
        assert sum(sizes) == 501 and max(sizes) < 300
        p = _predictions(found.tree(3), df)
    assert p[0] == p[499] == pytest.approx(249.5) and p[900] == pytest.approx(3.0)


def test_saved_trees_score_as_fitted(spark, data):
    models = train.fit_models(data, ("decision_tree", "random_forest", "adaboost"), EXTRA, forest_depth=3)
    back = train.load_models(train.save_models(models, tempfile.mkdtemp(prefix="binsight-models-")))
    odd = train.add_calendar(spark.createDataFrame(
        [(1, "A", "t", dt.date(2031, 3, 3)), (2, "elsewhere", "t", dt.date(1990, 1, 1)), (3, "A", "t", None)],
        "id long, area string, waste_type string, d date"), "d")
    for mid, m in models.items():
        assert _predictions(m, data) == _predictions(back[mid], data), mid
        p = _predictions(m, odd)
        assert p == _predictions(back[mid], odd) and p[3] is None and p[1] is not None and p[2] is not None, mid


def test_spark_ml_adaboost_is_loaded_too(spark, data, monkeypatch):
    monkeypatch.setattr(cells, "MAX_CELLS", 0)
    model = fit_adaboost_r2(data, train.preprocessing_stages(), n_estimators=2)
    back = train.load_models(train.save_models({"adaboost": model}, tempfile.mkdtemp(prefix="binsight-models-")))["adaboost"]
    assert isinstance(back, AdaBoostR2Model) and _predictions(back, data) == _predictions(model, data)


def test_an_infinite_label_is_an_error(spark):
    rows = spark.createDataFrame([(1, "A", "t", dt.date(2024, 1, 1), float("inf"))],
                                 "id long, area string, waste_type string, ticket_date date, y double")
    with pytest.raises(RuntimeError, match="finite"):
        train.fit_models(train.prepare(rows, "y", "ticket_date"), ("decision_tree",))
