"""Least squares on the full one-hot design, without iterating over rows.

The reference encodes every known area and type in a column of its own and fits
an intercept, so the design lacks full rank: many coefficients give the same
fit, and which are taken decides what an unknown area or type (all zeros in its
block) is predicted.  Here, as there, the centred problem is solved with
the coefficients of least norm; ridge adds its penalty to the same matrix.

One aggregate per (area, type) cell gives all that the normal equations need,
since a one-hot column is constant within a cell.  The cells are folded into
the matrix by Spark as well, entry by entry; the driver gets the
matrix, whose size is the number of one-hot columns, and solves it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.operators.joins import bounded_broadcast, measured_bytes

#: Columns of the design up to which the matrix is solved on the driver (8 bytes an entry: 200 MB).
MAX_COLUMNS = 5_000


@dataclass
class LinearCells:
    """A linear model whose categorical part is a number for each known value."""

    categorical: list[str]
    numeric: list[str]
    intercept: float
    slopes: list[float]
    effects: DataFrame  # name, value, effect

    def transform(self, df: DataFrame) -> DataFrame:
        """df with ``prediction``; a value that the training data hadn't adds nothing."""
        out = df
        added = F.lit(self.intercept)
        for c, slope in zip(self.numeric, self.slopes, strict=True):
            added = added + F.col(c) * F.lit(slope)
        size = measured_bytes(self.effects)
        for i, c in enumerate(self.categorical):
            own = self.effects.where(F.col("name") == c).select(F.col("value").alias(f"_v{i}"), F.col("effect").alias(f"_e{i}"))
            out = out.join(bounded_broadcast(own, size), out[c].cast("string") == F.col(f"_v{i}"), "left")
            added = added + F.coalesce(f"_e{i}", F.lit(0.0))
        extra = [f"{p}{i}" for i in range(len(self.categorical)) for p in ("_v", "_e")]
        return out.withColumn("prediction", added).drop(*extra)

    def save(self, path: str) -> None:
        self.effects.write.mode("overwrite").parquet(f"{path}/effects")
        rows = [("", "intercept", self.intercept)] + [(str(i), c, s) for i, (c, s) in enumerate(zip(self.numeric, self.slopes, strict=True))]
        spark = self.effects.sparkSession
        spark.createDataFrame(rows, "at string, name string, value double").write.mode("overwrite").parquet(f"{path}/numbers")
        spark.createDataFrame([(i, c) for i, c in enumerate(self.categorical)], "at int, name string").write.mode("overwrite").parquet(f"{path}/blocks")

    @classmethod
    def load(cls, path: str) -> LinearCells:
        spark = SparkSession.getActiveSession()
        numbers = spark.read.parquet(f"{path}/numbers").collect()  # one per numeric column
        slopes = sorted((int(r["at"]), r["name"], r["value"]) for r in numbers if r["at"])
        blocks = sorted(map(tuple, spark.read.parquet(f"{path}/blocks").collect()))
        return cls([n for _, n in blocks], [n for _, n, _ in slopes], next(r["value"] for r in numbers if not r["at"]),
                   [v for *_, v in slopes], spark.read.parquet(f"{path}/effects"))


def _moments(train: DataFrame, categorical: list[str], numeric: list[str], label: str) -> DataFrame:
    """(i, j, total): the sums of products of every two design columns that meet in a row, the ones and the label among them.

    A design column is a (name, value) pair; a pair of columns is summed where both are not zero,
    so the result has at most as many rows as the matrix has entries.
    """
    numbers = [F.lit(1.0), F.col(label), *[F.col(c).cast("double") for c in numeric]]
    cell = train.groupBy(*[F.col(c).cast("string").alias(c) for c in categorical])
    products = [F.sum(numbers[a] * numbers[b]).alias(f"_p{a}_{b}") for a in range(len(numbers)) for b in range(a, len(numbers))]
    cells = cell.agg(*products)
    names = ["1", "y", *[f"n{i}" for i in range(len(numeric))]]
    entries = [F.struct(F.lit(names[a]).alias("i"), F.lit(names[b]).alias("j"), F.col(f"_p{a}_{b}").alias("total"))
               for a in range(len(numbers)) for b in range(a, len(numbers))]
    known = [(i, c) for i, c in enumerate(categorical)]
    key = {i: F.concat(F.lit(f"c{i}="), F.col(c)) for i, c in known}
    for i, _ in known:
        entries += [F.struct(F.lit(names[b]).alias("i"), key[i].alias("j"), F.col(f"_p0_{b}").alias("total")) for b in range(len(numbers))]
        entries += [F.struct(key[i].alias("i"), key[k].alias("j"), F.col("_p0_0").alias("total")) for k, _ in known if k >= i]
    return (cells.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where("i IS NOT NULL AND j IS NOT NULL")
            .groupBy("i", "j").agg(F.sum("total").alias("total")))


def fit_linear(train: DataFrame, categorical: list[str], numeric: list[str], label: str = "label", alpha: float = 0.0) -> LinearCells:
    """Least squares with an intercept; ``alpha``: ridge penalty on all coefficients but the intercept.

    With ``alpha`` 0 the solution of least norm of the centred problem is taken.  A null
    in a categorical column is a row of none of its columns; rows with a null number or label are left out.
    """
    rows = train.dropna(subset=[label, *numeric])
    sums = _moments(rows, categorical, numeric, label).checkpoint()
    columns = [f"n{i}" for i in range(len(numeric))]
    found = sums.where("i = '1' AND j LIKE 'c%'").count() + len(columns)
    if found > MAX_COLUMNS:
        raise ValueError(f"{found} columns: more than the {MAX_COLUMNS} whose matrix the driver solves")
    entries = {(r["i"], r["j"]): r["total"] for r in sums.collect()}  # at most (MAX_COLUMNS + 2) ** 2
    columns += sorted(j for i, j in entries if i == "1" and j.startswith("c"))
    at = {c: k for k, c in enumerate(columns)}
    n = entries.get(("1", "1"), 0.0)
    if not n:
        raise ValueError("no rows to fit")
    p = len(columns)
    gram, cross, total = np.zeros((p, p)), np.zeros(p), np.zeros(p)
    for (i, j), v in entries.items():
        if i in at and j in at:
            gram[at[i], at[j]] = gram[at[j], at[i]] = v
        elif i == "1" and j in at:
            total[at[j]] = v
        elif "y" in (i, j) and (c := j if i == "y" else i) in at:
            cross[at[c]] = v
    mean, y = total / n, entries[("1", "y")] / n
    gram -= n * np.outer(mean, mean)
    cross -= n * mean * y
    if alpha:
        solved = np.linalg.solve(gram + alpha * np.eye(p), cross)
    else:
        # in units of each column's spread, so that what is zero but for rounding can be told
        values, vectors = np.linalg.eigh(gram)
        keep = values > values.max(initial=0.0) * p * 1e-13
        solved = vectors[:, keep] @ ((vectors[:, keep].T @ cross) / values[keep])
    effects = [(categorical[int(c[1:c.index("=")])], c[c.index("=") + 1:], float(v))
               for c, v in zip(columns, solved, strict=True) if c.startswith("c")]
    frame = train.sparkSession.createDataFrame(effects, "name string, value string, effect double")
    return LinearCells(list(categorical), list(numeric), float(y - mean @ solved), [float(v) for v in solved[:len(numeric)]], frame)
