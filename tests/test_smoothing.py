"""Density and local fits from block moments against the plain sums over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from perfengine.operators import smoothing as S


def plain_density(v, points):
    h = v.std(ddof=1) * len(v) ** -0.2
    at = v.min() + np.arange(points) * ((v.max() - v.min()) / (points - 1))
    return np.exp(-0.5 * ((at[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))


def plain_fit(x, y, frac, points, robust):
    at = x.min() + np.arange(points) * ((x.max() - x.min()) / (points - 1))
    at[-1] = x.max()
    need, own = int(frac * len(x) + 1e-10), np.ones(len(x))
    for turn in range(robust + 1):
        fit = np.empty(points)
        for i, g in enumerate(at):
            r = np.sort(np.abs(x - g))[max(need, 1) - 1]
            t = np.divide(x - g, r, out=np.where(x == g, 0.0, 2.0), where=r > 0)
            w = np.where(np.abs(t) < 1, (1 - np.abs(t) ** 3) ** 3, 0) * own
            s0, s1, s2 = w.sum(), (w * (x - g)).sum(), (w * (x - g) ** 2).sum()
            den = s0 * s2 - s1 * s1
            slope = (s0 * (w * (x - g) * y).sum() - s1 * (w * y).sum()) / den if den > 1e-12 * s0 * s0 else 0.0
            fit[i] = ((w * y).sum() - slope * s1) / s0
        res = np.abs(y - np.interp(x, at, fit))
        mid = np.median(res)
        e = res / (6 * mid) if mid > 0 else (res > 0) * 1.0
        own = np.where(e >= 0.999, 0, np.where(e <= 0.001, 1, (1 - e**2) ** 2))
    return fit


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(5)
    smooth = rng.uniform(0, 10, 3000)
    skewed = np.exp(rng.normal(0, 2, 2500))  # a few values far from a dense mass
    steps = rng.integers(0, 9, 2000).astype(float)  # ties
    out = {"smooth": (smooth, np.sin(smooth) + rng.normal(0, 0.1, 3000)), "skewed": (skewed, np.log(skewed) + rng.normal(0, 0.5, 2500)),
           "steps": (steps, steps**2 + rng.normal(0, 1, 2000)), None: (smooth[:40] + 1e6, smooth[:40])}
    out["smooth"][1][::50] += 8  # outliers for the robust passes
    return out


@pytest.fixture(scope="module")
def df(spark, groups):
    rows = [(g, float(a), float(b)) for g, (x, y) in groups.items() for a, b in zip(x, y)]
    rows += [("smooth", None, 1.0), ("smooth", 1.0, float("nan")), ("empty", None, None)]
    return spark.createDataFrame(rows, "g string, x double, y double").repartition(7)


def test_density(df, groups):
    got = S.density(df, "x", "g", 50).toPandas()
    for g, (x, _) in groups.items():
        if g != "smooth":  # that one has a further row for y
            mine = got[got.g.isna() if g is None else got.g == g].sort_values("k").density
            assert np.allclose(mine, plain_density(x, 50), rtol=1e-9, atol=1e-12)
    assert not (got.g == "empty").any()


@pytest.mark.parametrize("robust, blocks", [(0, 256), (0, 16), (2, 64)])
def test_local_fit(df, groups, robust, blocks):
    got = S.local_fit(df, "x", "y", "g", 0.4, 40, robust, blocks).toPandas()
    for g, (x, y) in groups.items():
        mine = got[got.g.isna() if g is None else got.g == g].sort_values("k").fitted
        assert len(mine) == 40
        assert np.allclose(mine, plain_fit(x, y, 0.4, 40, robust), rtol=1e-6, atol=1e-7), g


def test_one_value_and_no_rows(spark):
    one = spark.createDataFrame([("a", 2.0, 3.0), ("a", 2.0, 5.0)], "g string, x double, y double")
    assert {r.fitted for r in S.local_fit(one, "x", "y", "g", points=5).collect()} == {4.0}
    assert all(r.density is None for r in S.density(one, "x", "g", 5).collect())
    none = one.limit(0)
    assert S.local_fit(none, "x", "y", "g", points=5).count() == 0 and S.density(none, "x", "g").count() == 0


def test_nothing_stays_cached(spark, df):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    S.local_fit(df, "x", "y", "g", 0.5, 10, robust=1).count()
    S.density(df, "x", "g", 10).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_rows_meet_cuts_and_curve_in_generated_code(spark, monkeypatch):
    """The search and the residual leave no lambda and no array of the curve in the plans of the robust passes."""
    plans = []
    wanted = S.quantiles

    def seen(df, col, *args):
        plans.append(df.where(F.col(col).isNotNull())._jdf.queryExecution().optimizedPlan().toString())
        return wanted(df, col, *args)

    monkeypatch.setattr(S, "quantiles", seen)
    df = spark.range(300).selectExpr("string(id % 2) AS g", "double(id * 7 % 101) AS x", "double(id * id % 53) AS y")
    assert S.local_fit(df, "x", "y", "g", points=10, robust=1).count() == 20
    assert plans and not any("_curve" in p or "lambda" in p for p in plans)
