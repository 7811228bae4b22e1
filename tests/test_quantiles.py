"""Exact quantile selection against numpy, including the bracket and narrowing paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from perfengine.operators import quantiles as Q

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def _df(spark, groups):
    rows = [(g, float(x)) for g, arr in groups.items() for x in arr]
    return spark.createDataFrame(rows, "g string, x double")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    return {"cont": rng.normal(size=6000), "ties": rng.integers(0, 6, 4000).astype(float),
            "heavy": np.concatenate([np.full(3000, 2.5), rng.exponential(size=1500)]),
            "one": np.array([4.0]), "two": np.array([1.0, 9.0])}


@pytest.fixture(params=["sketch", "few buckets", "useless sketch"])
def setting(request, monkeypatch):
    """The rounds must lead to the same values from few buckets and from brackets that miss the rank."""
    if request.param != "sketch":
        monkeypatch.setattr(Q, "BUCKETS", 4)
    if request.param == "useless sketch":
        monkeypatch.setattr(Q, "ACCURACY", 2)
        monkeypatch.setattr(Q, "BROADCAST_TARGETS", 0)
    return request.param


def test_global_matches_numpy(spark, data, setting):
    for name in ("cont", "heavy", "two"):
        got = Q.exact_quantiles(_df(spark, {name: data[name]}), "x", PROBS)
        assert np.allclose(got, np.quantile(data[name], PROBS), rtol=0, atol=1e-12), name


def test_grouped_matches_numpy(spark, data, setting):
    wild = np.concatenate([2.0 ** np.arange(-1000, 1000, 3), -(2.0 ** np.arange(-1000, 1000, 7)), [0.0, 0.0]])
    data = data | {"wild": wild, "zero": np.r_[np.zeros(50), 10.0 ** -np.arange(300)], None: np.array([3.0, 4.0, 8.0])}
    got = {r["g"]: [r[f"q{i}"] for i in range(len(PROBS))]
           for r in Q.quantiles(_df(spark, data), "x", PROBS, ["g"]).collect()}
    assert set(got) == set(data)
    for name, arr in data.items():
        assert np.allclose(got[name], np.quantile(arr, PROBS), rtol=1e-12, atol=0), name


def test_infinities_nulls_and_nothing(spark):
    inf = float("inf")
    rows = [("a", x) for x in (-inf, -inf, 1.0, 2.0, inf, None, float("nan"))] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: list(r)[1:] for r in Q.quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0], ["g"]).collect()}
    assert got == {"a": [-inf, -inf, 1.0, 2.0, inf]}
    assert Q.exact_quantiles(df.where("g = 'b'"), "x", [0.5]) == [None]
    assert Q.quantiles(df.where("g = 'b'"), "x", [0.5], ["g"]).columns == ["g", "q0"]


def test_as_many_jobs_for_many_groups(spark):
    """The rounds go over all groups at once."""
    tracker, counts = spark.sparkContext.statusTracker(), []
    for groups in (6, 600):
        df = spark.range(30_000).select((F.col("id") % groups).cast("string").alias("g"), F.rand(3).alias("x"))
        spark.sparkContext.setJobGroup(f"q{groups}", "")
        Q.quantiles(df, "x", [0.25, 0.75], ["g"]).collect()
        counts.append(len(tracker.getJobIdsForGroup(f"q{groups}")))
    spark.sparkContext.setJobGroup("", "")
    assert abs(counts[0] - counts[1]) <= 4  # a round more or less


def test_column_quantiles_long_form(spark, data):
    import pandas as pd
    pdf = pd.DataFrame({"a": data["cont"][:4000], "b": data["ties"]})
    df = spark.createDataFrame(pdf)
    got = {r["column"]: r["q0"] for r in Q.column_quantiles(df, ["a", "b"], [0.5]).collect()}
    assert np.isclose(got["a"], np.median(pdf["a"])) and np.isclose(got["b"], np.median(pdf["b"]))


def test_fences_need_no_joined_targets(spark, monkeypatch):
    """The sequential fences select by literal brackets alone, also where earlier fences move the ranks."""
    from perfengine.operators.clean import iqr_bounds
    rng = np.random.default_rng(11)
    a, b = rng.standard_cauchy(400), rng.normal(size=400)
    b[np.abs(a) > 3] += 50
    monkeypatch.setattr(Q, "_selected", None)
    got = iqr_bounds(spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double"), ["a", "b"])
    for k, (name, lo, hi) in enumerate(got):
        q1, q3 = np.quantile((a, b)[k], [0.25, 0.75])
        assert np.allclose([lo, hi], [q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)], rtol=0, atol=1e-9), name
        kept = ((a, b)[k] >= lo) & ((a, b)[k] <= hi)
        a, b = a[kept], b[kept]
