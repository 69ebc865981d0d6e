"""Model queries.

Trained models are kept per (session, data folder) so the queries that need
the same fitted family (scoring, leaderboard, best model, ensemble) train it
once per process.  Only fitted model objects are cached; data stays in Spark.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from binsight.functions import exprs as X
from binsight.models import baseline, score, train
from binsight.models.adaboost import fit_adaboost_r2
from binsight.models.catalog import DEFAULT_COLOR, SEED
from binsight.models.knn import fit_knn
from binsight.models.linear import fit_linear
from binsight.plans import oracle_views as V
from binsight.plans.catalog import register
from binsight.session import scratch_path
from binsight.sources import tables as T

_FITTED: dict = {}
# Depth of the registered queries' forest: the library's default is 30, which on these
# labels (no signal) grows a leaf for nearly every row.
QUERY_FOREST_DEPTH = 12


def _family(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _FITTED:
        _FITTED[key] = train.train_eval(
            T.observations(spark, d), "net_weight_kg", "ticket_date",
            model_ids=train.SPARK_ML_MODELS + ("knn", "adaboost"),
            forest_depth=QUERY_FOREST_DEPTH,
            extra_estimators={"adaboost": lambda tr: fit_adaboost_r2(tr, train.preprocessing_stages()),
                              "knn": lambda tr: fit_knn(tr, k=5)})
    return _FITTED[key]


def _is_test(key: str) -> str:
    return f"CAST('0x' || substr(md5('{SEED}-' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20"


@register("random_split", f"SELECT id, ticket_date, {_is_test('id')} AS is_test FROM ({V.OBSERVATIONS})")
def random_split(spark, d):
    return train.random_split(T.observations(spark, d).select("id", "ticket_date"), "id")


@register("exact_split", f"""
SELECT id, ticket_date, row_number() OVER (ORDER BY CAST('0x' || substr(md5('{SEED}-' || CAST(id AS VARCHAR)), 1, 15) AS BIGINT), id)
       <= (count(*) OVER () * 20 + 99) // 100 AS is_test FROM ({V.OBSERVATIONS})""")
def exact_split(spark, d):
    """K3 with the reference's size: a fifth of the rows, rounded up."""
    return train.exact_split(T.observations(spark, d).select("id", "ticket_date"), "id")


_MET_SQL = f"""
WITH hist AS ({V.OBSERVATIONS}), obs AS ({V.OBSERVED}),
a AS (SELECT area, {V.exact_avg('net_weight_kg')} AS v FROM hist GROUP BY area),
t AS (SELECT waste_type, {V.exact_avg('net_weight_kg')} AS v FROM hist GROUP BY waste_type),
o AS (SELECT {V.exact_avg('net_weight_kg')} AS v FROM hist),
j AS (SELECT obs.net_weight_kg AS label, COALESCE(a.v, o.v) AS am, COALESCE(t.v, o.v) AS tm, o.v AS om
        FROM obs LEFT JOIN a ON obs.area = a.area LEFT JOIN t ON obs.waste_type = t.waste_type CROSS JOIN o),
p AS (SELECT 'area_mean' AS model_id, label, am AS prediction FROM j
      UNION ALL SELECT 'type_mean', label, tm FROM j
      UNION ALL SELECT 'overall_mean', label, om FROM j),
g AS (SELECT model_id, COUNT(*) AS n, SUM(CAST(abs(label - prediction) AS DECIMAL(38,6))) AS sae,
             SUM(CAST((label - prediction) * (label - prediction) AS DECIMAL(38,4))) AS sse,
             {V.exact_avg('label')} AS mean FROM p GROUP BY model_id),
s AS (SELECT p.model_id, SUM(CAST((p.label - g.mean) * (p.label - g.mean) AS DECIMAL(38,4))) AS sst
        FROM p JOIN g ON p.model_id = g.model_id GROUP BY p.model_id)
SELECT g.model_id, g.n, CAST(sae AS DOUBLE) / n AS mae, sqrt(CAST(sse AS DOUBLE) / n) AS rmse,
       1.0 - CAST(sse AS DOUBLE) / NULLIF(CAST(sst AS DOUBLE), 0) AS r2
  FROM g JOIN s ON g.model_id = s.model_id"""


@register("baseline_metrics", _MET_SQL)
def baseline_metrics(spark, d):
    return baseline.exact_metrics(baseline.baseline_columns(T.observations(spark, d), T.observed(spark, d)))


@register("linear_by_area", f"""
WITH hist AS ({V.OBSERVATIONS}), m AS (SELECT area, {V.exact_avg('net_weight_kg')} AS mean FROM hist GROUP BY area)
SELECT area, mean, TRUE AS predicted FROM m
UNION ALL SELECT 'an unknown area', NULL, TRUE""")
def linear_by_area(spark, d):
    """K6 on a design whose solution SQL knows: with the area alone, least squares of least norm gives
    each area its mean, and an unknown area the mean of these means.  ``predicted``: the model's prediction
    is that number but for one part in 10 ** 9, what solving the equations in doubles may be off."""
    hist = T.observations(spark, d)
    means = hist.groupBy("area").agg(X.exact_avg("net_weight_kg").alias("mean"))
    ask = means.unionByName(spark.createDataFrame([("an unknown area", None)], "area string, mean double"))
    every = means.agg(F.avg("mean").alias("_all"))  # one row
    asked = fit_linear(hist, ["area"], [], "net_weight_kg").transform(ask).crossJoin(F.broadcast(every))
    want = F.coalesce("mean", "_all")
    return asked.select("area", "mean", (F.abs(F.col("prediction") - want) <= F.abs(want) * 1e-9).alias("predicted"))


@register("train_eval")
def train_eval(spark, d):
    _, lb = _family(spark, d)
    return lb


@register("leaderboard")
def leaderboard(spark, d):
    _, lb = _family(spark, d)
    return score.leaderboard(lb)


@register("best_model")
def best_model(spark, d):
    _, lb = _family(spark, d)
    return score.best_model(lb)


def _requests(spark, d):
    """Score every logged prediction request (area, type, date)."""
    return T.prediction_logs(spark, d).select("id", "area", "waste_type", "prediction_date")


@register("score_all_models")
def score_all_models(spark, d):
    models, _ = _family(spark, d)
    return score.score_all_models(models, _requests(spark, d), "prediction_date", "id")


@register("score")
def score_one(spark, d):
    from binsight.models.catalog import DEFAULT_MODEL
    models, _ = _family(spark, d)
    return score.score(models[DEFAULT_MODEL], _requests(spark, d), "prediction_date")


@register("ensemble_summary")
def ensemble_summary(spark, d):
    models, _ = _family(spark, d)
    return score.ensemble_summary(models, _requests(spark, d), "prediction_date", "id")


@register("lag_model")
def lag_model(spark, d):
    _, metrics = train.lag_model(T.observations(spark, d), "net_weight_kg", "ticket_date")
    return metrics


_KNN_SQL = f"""
WITH o AS (SELECT id, area, waste_type, year(ticket_date) AS y, month(ticket_date) AS m, day(ticket_date) AS d,
                  (isodow(ticket_date) - 1) AS w, net_weight_kg AS label, {_is_test('id')} AS is_test FROM ({V.OBSERVATIONS})),
tr AS (SELECT * FROM o WHERE NOT is_test),
te AS (SELECT *, CASE WHEN area IN (SELECT area FROM tr) THEN 2 ELSE 1 END AS pa,
              CASE WHEN waste_type IN (SELECT waste_type FROM tr) THEN 2 ELSE 1 END AS pt FROM o WHERE is_test),
p AS (SELECT te.id, te.label, (te.y - tr.y) * (te.y - tr.y) + (te.m - tr.m) * (te.m - tr.m) + (te.d - tr.d) * (te.d - tr.d)
             + (te.w - tr.w) * (te.w - tr.w) + CASE WHEN te.area = tr.area THEN 0 ELSE pa END
             + CASE WHEN te.waste_type = tr.waste_type THEN 0 ELSE pt END AS dist,
             COUNT(*) AS cnt, SUM(CAST(tr.label AS DECIMAL(20,6))) AS sm
        FROM te CROSS JOIN tr GROUP BY 1, 2, 3),
r AS (SELECT *, SUM(cnt) OVER u AS run_cnt, SUM(sm) OVER u AS run_sm FROM p
      WINDOW u AS (PARTITION BY id ORDER BY dist ROWS UNBOUNDED PRECEDING))
SELECT id, label, (CAST(run_sm - sm AS DOUBLE) + (5 - (run_cnt - cnt)) * CAST(sm AS DOUBLE) / cnt) / 5 AS prediction,
       CAST(dist AS BIGINT) AS kth_dist2
  FROM r WHERE run_cnt >= 5 AND run_cnt - cnt < 5"""


@register("knn_regress", _KNN_SQL)
def knn_regress(spark, d):
    """K8: exact 5-nearest-neighbour regression of the held-out rows on the
    training rows (hash split of the observations)."""
    data = train.random_split(train.prepare(T.observations(spark, d), "net_weight_kg", "ticket_date"), "id")
    model = fit_knn(data.filter(~F.col("is_test")), k=5)
    test = data.filter(F.col("is_test")).select("id", "area", "waste_type", *train.NUMERIC, "label")
    return model.transform(test).select("id", "label", "prediction", F.col("kth_dist2").cast("long").alias("kth_dist2"))


# The same operators over closed-form predictors (the history's means), whose values SQL can give.
_MEAN_SCORES = f"""
hist AS ({V.OBSERVATIONS}), req AS ({V.REQUESTS}),
a AS (SELECT area, {V.exact_avg('net_weight_kg')} AS v FROM hist GROUP BY area),
t AS (SELECT waste_type, {V.exact_avg('net_weight_kg')} AS v FROM hist GROUP BY waste_type),
o AS (SELECT {V.exact_avg('net_weight_kg')} AS v FROM hist),
j AS (SELECT req.id, CAST(req.prediction_date AS VARCHAR) AS day, COALESCE(a.v, o.v) AS am, COALESCE(t.v, o.v) AS tm, o.v AS om
        FROM req LEFT JOIN a ON req.area = a.area LEFT JOIN t ON req.waste_type = t.waste_type CROSS JOIN o),
p AS (SELECT id, day, 'area_mean' AS model_id, round(greatest(0.0, am), 2) AS prediction FROM j
      UNION ALL SELECT id, day, 'type_mean', round(greatest(0.0, tm), 2) FROM j
      UNION ALL SELECT id, day, 'overall_mean', round(greatest(0.0, om), 2) FROM j)"""


def _mean_requests(spark, d):
    r = T.requests(spark, d).select("id", "area", "waste_type", "prediction_date")
    # ids repeat between the two logs: the date tells the requests apart
    return r.withColumn("request", F.concat_ws("@", F.col("id").cast("string"), F.col("prediction_date").cast("string")))


@register("mean_scores", f"""WITH {_MEAN_SCORES}
SELECT id || '@' || day AS request, model_id, prediction, model_id AS name, '{DEFAULT_COLOR}' AS color,
       CAST(row_number() OVER (PARTITION BY id, day ORDER BY prediction DESC, model_id) AS INTEGER) AS rank FROM p""")
def mean_scores(spark, d):
    """K12 + F7 + H14: clamp, rounding, rank, names of score_all_models."""
    models = baseline.mean_models(T.observations(spark, d))
    return score.score_all_models(models, _mean_requests(spark, d), "prediction_date", "request")


@register("mean_ensemble", f"""WITH {_MEAN_SCORES}
SELECT id || '@' || day AS request, CAST(SUM(CAST(prediction AS DECIMAL(30,2))) AS DOUBLE) / COUNT(*) AS mean_prediction,
       MIN(prediction) AS min_prediction, MAX(prediction) AS max_prediction, COUNT(*) AS n_models FROM p GROUP BY id, day""")
def mean_ensemble(spark, d):
    """D25 over the closed-form models."""
    models = baseline.mean_models(T.observations(spark, d))
    return score.ensemble_summary(models, _mean_requests(spark, d), "prediction_date", "request")


def _mean_board(spark, d):
    metrics = baseline.exact_metrics(baseline.baseline_columns(T.observations(spark, d), T.observed(spark, d)))
    return train.leaderboard_frame(spark, metrics)


@register("mean_leaderboard", f"""WITH b AS ({_MET_SQL})
SELECT model_id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS color,
       round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(r2, 4) AS r2, round(r2 * 100, 2) AS r2_pct, FALSE AS is_current
  FROM b ORDER BY mae, model_id""")
def mean_leaderboard(spark, d):
    """K13 + F6 + H19 over the closed-form models."""
    return score.leaderboard(_mean_board(spark, d))


@register("mean_best_model", f"""WITH b AS ({_MET_SQL}) SELECT arg_min(model_id, mae) AS model_id, MIN(mae) AS mae FROM b""")
def mean_best_model(spark, d):
    """D26 over the closed-form models."""
    return score.best_model(_mean_board(spark, d))


@register("models_saved")
def models_saved(spark, d):
    """Predictions of kNN, linear regression and AdaBoost (a few rounds) as fitted
    and as loaded again; ``same`` holds for every row."""
    data = train.prepare(T.observations(spark, d), "net_weight_kg", "ticket_date")
    models = train.fit_models(data, ("linear_regression", "knn", "adaboost"), {
        "knn": lambda tr: fit_knn(tr, k=5),
        "adaboost": lambda tr: fit_adaboost_r2(tr, train.preprocessing_stages(), n_estimators=3)})
    back = train.load_models(train.save_models(models, scratch_path(spark, "models")))
    keep = ["id", "prediction"]
    both = [m.transform(data).select(*keep).join(back[mid].transform(data).select("id", F.col("prediction").alias("loaded")), "id")
            .select("id", F.lit(mid).alias("model_id"), "prediction", "loaded", F.col("prediction").eqNullSafe(F.col("loaded")).alias("same"))
            for mid, m in models.items()]
    return both[0].unionByName(both[1]).unionByName(both[2])
