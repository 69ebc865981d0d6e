"""AdaBoost.R2 regression on Spark ML trees.

Drucker's AdaBoost.R2 with linear loss, as configured in the reference
(50 rounds, depth-3 trees, learning rate 1):

    e_i   = |y_i - f_m(x_i)| / max_j |y_j - f_m(x_j)|
    L     = sum(w_i e_i) / sum(w_i)          stop when L >= 0.5
    beta  = L / (1 - L)                      model weight ln(1 / beta)
    w_i  <- w_i * beta ** (1 - e_i)

Sample weights take the place of the reference's weighted resampling.  Where there are
too many cells (``models.cells``), each round is one distributed tree fit
(``weightCol``) plus one aggregate; the weights are a column, never collected.  Lineage is cut with a reliable
checkpoint every few rounds.  The prediction is the weighted median of the
trees' outputs, computed per row with array functions.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.models.catalog import SEED
from binsight.models.cells import CellTrees, packed
from binsight.session import ensure_checkpoint_dir


def numeric_columns(prep_stages: list) -> list[str]:
    """The columns that the preparation's last stage takes as they are."""
    made = {c for s in prep_stages[:-1] for c in s.getOutputCols()}
    return [c for c in prep_stages[-1].getInputCols() if c not in made]


class AdaBoostR2Model:
    def __init__(self, prep, trees, weights):
        self.prep, self.trees, self.weights = prep, trees, weights

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.prep.transform(df)
        cols = []
        for m, tree in enumerate(self.trees):
            out = tree.setPredictionCol(f"_p{m}").transform(out)
            cols.append(F.struct(F.col(f"_p{m}").alias("p"), F.lit(self.weights[m]).alias("w")))
        total = float(sum(self.weights))
        arr = F.array_sort(F.array(*cols))
        init = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("res"))
        med = F.aggregate(arr, init, lambda acc, x: F.struct(
            (acc["cum"] + x["w"]).alias("cum"),
            F.when(acc["res"].isNull() & (acc["cum"] + x["w"] >= F.lit(0.5 * total)), x["p"])
            .otherwise(acc["res"]).alias("res")))
        for c in numeric_columns(self.prep.stages):  # a row without a date has no prediction
            med = F.when(F.col(c).isNotNull(), med)
        return out.withColumn("prediction", med["res"]).drop(*[f"_p{m}" for m in range(len(self.trees))])


    def save(self, path: str) -> None:
        """The preparation, one pipeline of all trees, and their weights."""
        self.prep.write().overwrite().save(f"{path}/prep")
        named = [t.copy().setPredictionCol(f"_p{m}") for m, t in enumerate(self.trees)]
        PipelineModel(stages=named).write().overwrite().save(f"{path}/trees")
        spark = SparkSession.getActiveSession()
        (spark.createDataFrame(list(enumerate(self.weights)), "m int, weight double")
         .write.mode("overwrite").parquet(f"{path}/weights"))

    @classmethod
    def load(cls, path: str) -> AdaBoostR2Model | CellTrees:
        try:
            return CellTrees.load(path)
        except AnalysisException:  # Spark ML trees
            pass
        rows = SparkSession.getActiveSession().read.parquet(f"{path}/weights").orderBy("m").collect()  # one per tree
        return cls(PipelineModel.load(f"{path}/prep"), PipelineModel.load(f"{path}/trees").stages, [r["weight"] for r in rows])


def fit_adaboost_r2(train: DataFrame, prep_stages: list, n_estimators: int = 50, max_depth: int = 3,
                    label: str = "label", checkpoint_every: int = 10) -> AdaBoostR2Model | CellTrees:
    """The trees are grown from sums per cell (``models.cells``), or by Spark ML where there are too many cells."""
    with packed(train, prep_stages[0].getInputCols(), numeric_columns(prep_stages), label) as cells:
        if cells is not None:
            return cells.adaboost(n_estimators, max_depth, checkpoint_every)
    return fit_by_rows(train, prep_stages, n_estimators, max_depth, label, checkpoint_every)


def fit_by_rows(train: DataFrame, prep_stages: list, n_estimators: int = 50, max_depth: int = 3,
                label: str = "label", checkpoint_every: int = 10) -> AdaBoostR2Model:
    train = train.dropna(subset=[label, *numeric_columns(prep_stages)])  # as the linear models do
    prep = Pipeline(stages=prep_stages).fit(train)
    n = train.count()
    data = prep.transform(train).select("features", F.col(label).alias("y"), F.lit(1.0 / n).alias("w"))
    ensure_checkpoint_dir(train.sparkSession)
    data = data.checkpoint(eager=True)
    trees, weights = [], []
    cached = before = None
    for m in range(n_estimators):
        tree = DecisionTreeRegressor(maxDepth=max_depth, weightCol="w", labelCol="y", seed=SEED + m,
                                     predictionCol="_p").fit(data)
        if before is not None:
            before.unpersist()  # the fit has read this round's rows, so they are cached
            before = None
        scored = tree.transform(data).withColumn("_err", F.abs(F.col("y") - F.col("_p")))
        r = scored.agg(F.max("_err").alias("most"), F.sum(F.col("w") * F.col("_err")).alias("err"), F.sum("w").alias("w")).first()
        max_err = r["most"] or 0.0
        if max_err <= 0.0:  # perfect fit: keep it and stop
            trees.append(tree)
            weights.append(1.0)
            break
        e = F.col("_err") / F.lit(max_err)
        loss = float(r["err"]) / (max_err * float(r["w"]))
        if loss >= 0.5:
            if not trees:  # the first tree is kept, as in the reference
                trees.append(tree)
                weights.append(1.0)
            break
        beta = loss / (1.0 - loss)
        trees.append(tree)
        weights.append(math.log(1.0 / beta) if beta > 0 else 1.0)
        new_w = F.col("w") * F.pow(F.lit(beta), F.lit(1.0) - e) if beta > 0 else F.col("w")
        data = scored.select("features", "y", new_w.alias("w"))
        before = cached
        if (m + 1) % checkpoint_every == 0:
            data, cached = data.checkpoint(eager=True), None
        else:
            data = cached = data.persist()
    for kept in (before, cached):
        if kept is not None:
            kept.unpersist()
    for t in trees:
        t.setPredictionCol("prediction")
    return AdaBoostR2Model(prep, trees, weights)
