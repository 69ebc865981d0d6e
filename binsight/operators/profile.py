"""Column profiles and distribution statistics.

Exact quantiles and the KS statistic need each value's ranks.  Rows are first
counted by value, so a very common value is one row; the distinct values are
ranked by ``ordered.value_ranks`` (range partitioning + per-partition offsets),
never by a single-partition sort or a driver-side collect.
"""

from __future__ import annotations

import functools
import math
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binsight.functions import exprs as X
from binsight.operators.ordered import scratch, value_ranks
from binsight.session import ensure_checkpoint_dir

QUARTILES = (0.25, 0.5, 0.75)


def _counted(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-NULL values with their counts (combined before the shuffle) and
    ranks, written once: everything below is read from this table."""
    x = df.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull())
    return value_ranks(x.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "x")


def _one_row(fn):
    """The one-row result is checkpointed, and the table of ranked values dropped."""
    @functools.wraps(fn)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        ensure_checkpoint_dir(df.sparkSession)
        with scratch(df.sparkSession):
            return fn(df, *args, **kwargs).checkpoint(eager=True)
    return run


@_one_row
def describe(df: DataFrame, col: str, quantiles=QUARTILES, exact_quantiles: bool = True) -> DataFrame:
    """Count, mean, std (n-1), min, quantiles (linear interpolation), max.

    The mean is an exact decimal sum of the values to six decimals, and the
    standard deviation a decimal sum of squared deviations around it, so
    neither depends on partitioning.  ``exact_quantiles=False`` uses
    ``percentile_approx`` instead of ranks.
    """
    ranked = _counted(df, col)
    times = F.col("n").cast("decimal(18,0)")
    m = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
                   (F.sum(F.col("x").cast("decimal(32,6)") * times).cast("double") / F.sum("n")).alias("mean"),
                   F.min("x").alias("min"), F.max("x").alias("max"))
    dev = (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))
    ss = ranked.crossJoin(F.broadcast(m.select("mean"))).agg(  # one-row mean
        F.sum(dev.cast("decimal(32,6)") * times).alias("_ss"))
    base = m.crossJoin(ss).select(
        "count", "mean", F.sqrt(F.col("_ss").cast("double") / F.nullif(F.col("count") - 1, F.lit(0))).alias("std"),
        "min", "max")
    names = [f"q{int(round(q * 100)):02d}" for q in quantiles]
    if not exact_quantiles:
        qs = df.agg(F.percentile_approx(F.col(col).cast("double"), list(quantiles), 10000).alias("_q"))
        return base.crossJoin(qs).select("count", "mean", "std", "min",
                                         *[F.col("_q")[i].alias(n) for i, n in enumerate(names)], "max")
    # ranks needed: floor(h)+1 and floor(h)+2 for h = (n-1) q; at most 2 per quantile
    pos = base.select("count", *[((F.col("count") - 1) * F.lit(q)).alias(f"_h{i}") for i, q in enumerate(quantiles)])
    want = pos.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("qi"), (F.floor(F.col(f"_h{i}")) + F.lit(j)).cast("long").alias("rn"))
        for i in range(len(quantiles)) for j in (1, 2)])).alias("w")).select("w.*")
    picked = (ranked.join(F.broadcast(want), F.col("rn").between(F.col("rank_lo"), F.col("rank_hi")))  # 2 x len(quantiles) rows
              .groupBy().pivot("qi", list(range(len(quantiles))))
              .agg(F.min_by("x", "rn").alias("lo"), F.max_by("x", "rn").alias("hi")))
    out = base.crossJoin(picked).crossJoin(pos.drop("count"))
    qcols = []
    for i, n in enumerate(names):
        h = F.col(f"_h{i}")
        frac = h - F.floor(h)
        lo, hi = F.col(f"{i}_lo"), F.col(f"{i}_hi")
        qcols.append(F.when(frac == 0, lo).otherwise(lo + (hi - lo) * frac).alias(n))
    return out.select("count", "mean", "std", "min", *qcols, "max")


def profile_columns(df: DataFrame) -> DataFrame:
    """Per column its Spark type, non-null count and the table's row count."""
    agg = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(f"_nn_{i}")
                                                        for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"),
                     F.col(f"_nn_{i}").alias("non_null"), F.col("_rows").alias("total_rows"))
            for i, (c, t) in enumerate(df.dtypes)]
    return agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@_one_row
def ks_uniform(df: DataFrame, col: str) -> DataFrame:
    """E3 + D23 + H15: one-sample Kolmogorov-Smirnov statistic of the min-max
    scaled column against U(0, 1).  Returns n, min, max, d_stat and p_value (both
    NULL when all values are equal, where the reference divides by zero)."""
    ranked = _counted(df, col)
    mm = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    u = X.min_max_scale("x", "lo", "hi")
    n = F.col("total").cast("double")
    dev = F.greatest(F.col("rank_hi") / n - u, u - (F.col("rank_lo") - 1) / n)
    d = ranked.crossJoin(F.broadcast(mm)).agg(F.max(dev).alias("d_stat"))  # mm is one row
    out = mm.crossJoin(d).select(F.col("total").alias("n"), F.col("lo").alias("min"), F.col("hi").alias("max"), "d_stat")
    exact = F.udf(lambda d, n: None if d is None or n > EXACT_UP_TO else kolmogorov_exact(d, n), "double")  # on one row
    p = F.coalesce(F.round(exact("d_stat", "n"), 9), pvalue_column("d_stat", "n"))
    return out.withColumn("p_value", F.when(F.col("d_stat").isNotNull(), p))


#: Samples up to which the p-value is that of the finite distribution; beyond, the limit's series are used.
EXACT_UP_TO = 140


def kolmogorov_exact(d: float, n: int) -> float:
    """Two-sided p-value of statistic ``d`` on ``n`` samples, by the distribution for that n.

    The probability of a smaller statistic is an entry of the n-th power of a matrix of
    2 k - 1 rows, k = ceil(n d) (Marsaglia, Tsang and Wang 2003).  The power is
    taken by squaring; a common factor is kept apart, so that nothing overflows.
    """
    if n <= 0:
        return float("nan")
    if d <= 1 / (2 * n):
        return 1.0
    if d >= 1:
        return 0.0
    k = math.ceil(n * d)
    h, m = k - n * d, 2 * k - 1
    at = np.arange(m)
    step = at[:, None] - at[None, :] + 1
    matrix = (step >= 0).astype(float)
    border = h ** (at + 1)
    matrix[:, 0] -= border
    matrix[-1, :] -= border[::-1]
    matrix[-1, 0] += max(0.0, 2 * h - 1) ** m
    matrix /= np.array([float(math.factorial(max(i, 0))) if i < 171 else math.inf for i in step.ravel().tolist()]).reshape(m, m)
    power, scale, out, shift, left = matrix, 0, np.eye(m), 0, n
    while left:
        if left & 1:
            out, shift = out @ power, shift + scale
        power, scale, left = power @ power, 2 * scale, left >> 1
        if power[k - 1, k - 1] > 1e140:
            power, scale = power * 1e-140, scale + 140
        if out[k - 1, k - 1] > 1e140:
            out, shift = out * 1e-140, shift + 140
    below = out[k - 1, k - 1]
    for i in range(1, n + 1):  # times n! / n ** n
        below *= i / n
        if below < 1e-140:
            below, shift = below * 1e140, shift - 140
    return float(min(1.0, max(0.0, 1 - below * 10.0 ** shift)))


def pvalue_column(d: str, n: str) -> Column:
    """``kolmogorov_pvalue`` as a column, to nine decimals.  Eight terms of either
    series are below 1e-17 where it is used."""
    t = F.sqrt(F.col(n).cast("double")) * F.col(d)
    small = [F.exp(F.lit(-((2 * k - 1) * math.pi) ** 2 / 8) / (t * t)) for k in range(1, 9)]
    large = [F.exp(F.lit(-2.0 * k * k) * t * t) * F.lit((-1.0) ** (k - 1)) for k in range(1, 9)]
    p = (F.when(t <= 0, F.lit(1.0)).when(t < 1.18, F.lit(1.0) - F.lit(math.sqrt(2 * math.pi)) / t * reduce(add, small))
         .otherwise(F.lit(2.0) * reduce(add, large)))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)), 9)


def kolmogorov_pvalue(d: float, n: int) -> float:
    """Asymptotic two-sided p-value of statistic ``d`` on ``n`` samples.  Each of
    the two series of Kolmogorov's distribution is summed until its terms vanish
    where it converges fast: one for large sqrt(n) d, the other for small."""
    if d is None or n <= 0:
        return float("nan")
    t = math.sqrt(n) * d
    if t <= 0:
        return 1.0
    total, k = 0.0, 1
    if t < 1.18:
        while (term := math.exp(-((2 * k - 1) * math.pi) ** 2 / (8 * t * t))) > 1e-17:
            total, k = total + term, k + 1
        return max(0.0, min(1.0, 1 - math.sqrt(2 * math.pi) / t * total))
    while (term := math.exp(-2.0 * k * k * t * t)) > 1e-17:
        total, k = total + (-1) ** (k - 1) * term, k + 1
    return max(0.0, min(1.0, 2.0 * total))
