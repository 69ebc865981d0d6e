"""Exact kNN regression against numpy brute force (same tie rule)."""

import datetime as dt

import numpy as np

from binsight.models.knn import fit_knn


def _brute(train, req, k=5):
    areas = {a for a, _, _, _ in train}
    types = {t for _, t, _, _ in train}
    out = []
    for a, t, d in req:
        pa = 2 if a in areas else 1
        pt = 2 if t in types else 1
        cal = np.array([d.year, d.month, d.day, d.weekday()])
        d2 = []
        for ta, tt, td, y in train:
            c = np.array([td.year, td.month, td.day, td.weekday()])
            d2.append(pa * (ta != a) + pt * (tt != t) + int(((cal - c) ** 2).sum()))
        d2 = np.array(d2)
        ys = np.array([y for *_, y in train])
        R = np.sort(d2)[k - 1]
        lt = d2 < R
        pred = (ys[lt].sum() + (k - lt.sum()) * ys[d2 == R].mean()) / k
        out.append((pred, R))
    return out


def test_knn_matches_bruteforce(spark):
    rng = np.random.default_rng(7)
    areas, types = ["A", "B", "C", "D"], ["x", "y"]
    base = dt.date(2020, 1, 1)
    train = [(areas[rng.integers(0, 4)], types[rng.integers(0, 2)],
              base + dt.timedelta(days=int(rng.integers(0, 1500))), float(rng.integers(0, 1000)))
             for _ in range(300)]
    req = [(areas[rng.integers(0, 4)], types[rng.integers(0, 2)], base + dt.timedelta(days=int(rng.integers(-400, 1900))))
           for _ in range(40)]
    req += [("zz", "x", dt.date(2021, 6, 1)), ("A", "qq", dt.date(2030, 2, 3))]  # unknown area / type, far date
    tdf = spark.createDataFrame(train, "area string, waste_type string, d date, label double")
    rdf = spark.createDataFrame([(i, a, t, d) for i, (a, t, d) in enumerate(req)],
                                "rid long, area string, waste_type string, d date")
    model = fit_knn(tdf, k=5, date_col="d")
    got = {r["rid"]: (r["prediction"], r["kth_dist2"]) for r in model.transform(rdf).collect()}
    want = _brute(train, req)
    for i, (p, R) in enumerate(want):
        assert got[i][1] == R, (i, got[i], (p, R))
        assert abs(got[i][0] - p) < 1e-9 * max(1.0, abs(p))
