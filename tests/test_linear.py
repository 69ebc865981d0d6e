"""Minimum-norm least squares and ridge against numpy on the written-out design."""

import datetime as dt
import random

import numpy as np
import pytest

from binsight.models import linear, train

SCHEMA = "id long, area string, waste_type string, d date, label double"


def rows(n, seed=1, areas=7, types=4):
    rng = random.Random(seed)
    return [(i, f"A{rng.randrange(areas) ** 2 % areas}", f"t{rng.randrange(types)}", dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(900)),
             rng.random() * 100) for i in range(n)]


def design(data, areas, types):
    return np.array([[r[3].year, r[3].month, r[3].day, r[3].weekday(), *(r[1] == a for a in areas), *(r[2] == t for t in types)]
                     for r in data], dtype=float)


def numpy_fit(data, alpha):
    areas, types = sorted({r[1] for r in data}), sorted({r[2] for r in data})
    x, y = design(data, areas, types), np.array([r[4] for r in data])
    xm, ym = x.mean(0), y.mean()
    if alpha:
        w = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    else:
        w = np.linalg.lstsq(x - xm, y - ym, rcond=None)[0]
    return lambda some: design(some, areas, types) @ w + (ym - xm @ w)


@pytest.mark.parametrize("alpha", [0.0, 1.0])
@pytest.mark.parametrize("n", [1, 9, 400])
def test_equals_numpy_unknown_values_included(spark, alpha, n):
    data = rows(n)
    ask = rows(30, 5) + [(100, "unknown", "t1", dt.date(2024, 2, 29), 0.0), (101, "A1", "unknown", dt.date(2019, 1, 1), 0.0),
                         (102, "unknown", "unknown", dt.date(2021, 5, 5), 0.0)]
    frame = train.add_calendar(spark.createDataFrame(data, SCHEMA), "d")
    model = linear.fit_linear(frame.repartition(5), train.CATEGORICAL, train.NUMERIC, alpha=alpha)
    asked = train.add_calendar(spark.createDataFrame(ask, SCHEMA), "d")
    got = {r["id"]: r["prediction"] for r in model.transform(asked).select("id", "prediction").collect()}
    want = numpy_fit(data, alpha)(ask)
    assert np.allclose([got[r[0]] for r in ask], want, rtol=1e-6, atol=1e-6)


def test_saved_and_loaded(spark, tmp_path):
    frame = train.add_calendar(spark.createDataFrame(rows(50), SCHEMA), "d")
    model = linear.fit_linear(frame, train.CATEGORICAL, train.NUMERIC)
    model.save(str(tmp_path / "m"))
    back = linear.LinearCells.load(str(tmp_path / "m"))
    keep = lambda m: sorted(map(tuple, m.transform(frame).select("id", "prediction").collect()))
    assert keep(model) == keep(back)


def test_nulls_and_no_rows(spark):
    frame = spark.createDataFrame([("a", 1.0, 2.0), (None, 1.0, 4.0), ("b", 1.0, None), ("b", None, 5.0), ("c", 2.0, 6.0)],
                                  "area string, n double, label double")
    model = linear.fit_linear(frame, ["area"], ["n"])
    got = [r["prediction"] for r in model.transform(frame.where("label IS NOT NULL AND n IS NOT NULL").orderBy("label")).collect()]
    assert np.allclose(sorted(got), [2.0, 4.0, 6.0])
    with pytest.raises(ValueError):
        linear.fit_linear(frame.limit(0), ["area"], ["n"])
    with pytest.raises(ValueError, match="columns"):
        old, linear.MAX_COLUMNS = linear.MAX_COLUMNS, 2
        try:
            linear.fit_linear(frame, ["area"], ["n"])
        finally:
            linear.MAX_COLUMNS = old


def test_one_category_gives_group_means_and_their_mean_for_strangers(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 5.0), ("b", 10.0)], "area string, label double")
    model = linear.fit_linear(frame, ["area"], [])
    got = {r["area"]: r["prediction"] for r in model.transform(spark.createDataFrame([("a",), ("b",), ("z",)], "area string")).collect()}
    assert np.allclose([got["a"], got["b"], got["z"]], [3.0, 10.0, 6.5])
