"""Model family: ids, display metadata and Spark ML estimators.

Display metadata are fixed values shown by the reference's model pages.
"""

from __future__ import annotations

from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)

# Model id -> (name, description, colour).
MODEL_INFO = {
    "random_forest": ("Random Forest", "Ensemble of decision trees, robust and accurate", "#27ae60"),
    "gradient_boosting": ("Gradient Boosting", "Sequential ensemble with high accuracy", "#3498db"),
    "linear_regression": ("Linear Regression", "Simple and interpretable baseline model", "#9b59b6"),
    "ridge": ("Ridge Regression", "Linear model with L2 regularization", "#e74c3c"),
    "decision_tree": ("Decision Tree", "Single tree, fast and interpretable", "#f39c12"),
    "knn": ("K-Nearest Neighbors", "Instance-based learning", "#1abc9c"),
    "adaboost": ("AdaBoost", "Adaptive boosting ensemble", "#e67e22"),
}
DEFAULT_COLOR = "#27ae60"
DEFAULT_MODEL = "random_forest"
SEED = 42
# Spark's own limit.
MAX_FOREST_DEPTH = 30
#: MB of node statistics that a task of the forest holds; more make fewer passes, but fill the executor's memory.
FOREST_MEMORY = 256


def make_estimator(model_id: str, features: str = "features", label: str = "label",
                   ridge_reg: float | None = None, forest_depth: int = MAX_FOREST_DEPTH):
    """Spark ML estimator equivalent to the reference's model of that id.

    * random forest: 100 trees, all features per split, depth ``forest_depth``
      (the reference grows trees without a limit; Spark allows 30, the default); each row's
      nodes are kept, or every pass would send the forest so far to all tasks and search it again
    * gradient boosting: 100 stages, depth 3, step 0.1 (squared loss)
    * linear regression: ordinary least squares
    * ridge (alpha=1): L2 with ``regParam = alpha * stddev(y) / n`` and no
      standardization, which is sklearn's objective in Spark's scaling
      (``ridge_reg`` must be computed by the caller from the training data)
    * decision tree: depth 10
    """
    common = dict(featuresCol=features, labelCol=label)
    if model_id == "random_forest":
        return RandomForestRegressor(numTrees=100, featureSubsetStrategy="all", maxDepth=forest_depth,
                                     maxBins=64, maxMemoryInMB=FOREST_MEMORY, cacheNodeIds=True, seed=SEED, **common)
    if model_id == "gradient_boosting":
        return GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=SEED, maxBins=64, **common)
    if model_id == "linear_regression":
        return LinearRegression(regParam=0.0, **common)
    if model_id == "ridge":
        return LinearRegression(regParam=ridge_reg or 0.0, elasticNetParam=0.0, standardization=False, **common)
    if model_id == "decision_tree":
        return DecisionTreeRegressor(maxDepth=10, seed=SEED, maxBins=64, **common)
    raise KeyError(model_id)


SPARK_ML_MODELS = ("random_forest", "gradient_boosting", "linear_regression", "ridge", "decision_tree")
