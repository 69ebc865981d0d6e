"""The finite-sample Kolmogorov distribution against closed forms, exact fractions and published values."""

import math
from fractions import Fraction

import pytest

from binsight.operators import profile


def exact_below(d: Fraction, n: int) -> Fraction:
    """P(D_n < d) in fractions: the sample's distribution function stays within d of the diagonal.

    Between the points where an empirical step could leave the band, the counts follow a Poisson
    process conditioned on n events; f[j] is the weight of j events that stayed inside so far.
    """
    cuts = sorted({Fraction(0), Fraction(1), *(x for i in range(n + 1) for x in (Fraction(i, n) - d, Fraction(i, n) + d) if 0 < x < 1)})
    f = {0: Fraction(1)}
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        g = {}
        for j, w in f.items():
            for more in range(n - j + 1):
                i = j + more
                # the count before the stretch's events must not be too low at its end, nor that after them too high at its start
                if Fraction(i, n) - d <= lo and hi <= Fraction(j, n) + d:
                    g[i] = g.get(i, 0) + w * (hi - lo) ** more / math.factorial(more)
        f = g
    return f.get(n, Fraction(0)) * math.factorial(n)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 12])
def test_equals_exact_fractions(n):
    for num in range(1, 40):
        d = Fraction(num, 41)
        want = 1.0 if d <= Fraction(1, 2 * n) else float(1 - exact_below(d, n))
        assert abs(profile.kolmogorov_exact(float(d), n) - want) < 1e-9, (n, d)


def test_closed_forms_and_published_value():
    for d in (0.55, 0.7, 0.93):
        assert abs(profile.kolmogorov_exact(d, 1) - (1 - (2 * d - 1))) < 1e-12
        assert abs(profile.kolmogorov_exact(d, 2) - 2 * (1 - d) ** 2) < 1e-12
    assert abs(1 - profile.kolmogorov_exact(0.274, 10) - 0.6284796154565) < 1e-12


def test_approaches_the_limit_and_is_monotone():
    for n in (50, 100, 140):
        p = [profile.kolmogorov_exact(i / 100, n) for i in range(1, 60)]
        assert all(a >= b - 1e-12 for a, b in zip(p, p[1:], strict=False)) and p[-1] < 1e-12
    d = 1.0 / math.sqrt(140)
    assert abs(profile.kolmogorov_exact(d, 140) - profile.kolmogorov_pvalue(d + 1 / (6 * 140), 140)) < 2e-3


def test_small_samples_use_it(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 4, 10)], "x double")
    row = profile.ks_uniform(df, "x").first()
    assert row["n"] == 5 and abs(row["p_value"] - profile.kolmogorov_exact(row["d_stat"], 5)) < 1e-8
    big = spark.range(1000).selectExpr("pow(id, 2) AS x")
    row = profile.ks_uniform(big, "x").first()
    assert abs(row["p_value"] - profile.kolmogorov_pvalue(row["d_stat"], 1000)) < 1e-8
    same = profile.ks_uniform(spark.createDataFrame([(1.0,)] * 3, "x double"), "x").first()
    assert same["d_stat"] is None and same["p_value"] is None
