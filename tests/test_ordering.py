"""Ranges, boundary rows and what is built on them, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from perfengine.operators import windows as W
from perfengine.operators.ordering import running, with_count_up_to, with_position, with_range

SCHEMA = "id long, g string, day date, v double, _row string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(3000):
        g = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        day = None if rng.random() < 0.05 else dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(40))
        out.append((i, g, day, None if rng.random() < 0.1 else rng.gauss(0, 5), "x"))
    return out


def _order(r):
    return (r[2] is not None, r[2] or dt.date(1, 1, 1), r[0])


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).drop("_row").repartition(5).cache()


def _groups(rows):
    out = {}
    for r in sorted(rows, key=_order):
        out.setdefault(r[1], []).append(r)
    return out


def test_ranges_follow_the_order_and_split_a_hot_day(spark, rows, table):
    got = {r.id: r._pid for r in with_range(table, ["day", "id"], 16).collect()}
    pids = [got[r[0]] for r in sorted(rows, key=_order)]
    assert pids == sorted(pids) and len(set(pids)) == 16
    assert max(pids.count(p) for p in set(pids)) < 3 * len(rows) / 16
    one_day = table.withColumn("day", F.lit(dt.date(2024, 1, 1)))
    assert with_range(one_day, ["day", "id"], 16).select("_pid").distinct().count() == 16


def test_ranges_from_a_sample_and_by_a_struct(spark):
    big = spark.range(40_000).select(F.struct((F.col("id") % 7).alias("a"), F.col("id").alias("b")).alias("k"))
    got = with_range(big, ["k"], 4).groupBy("_pid").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    parts = got.orderBy("_pid").collect()
    assert len(parts) == 4 and all(p.n < 20_000 for p in parts)
    assert all(x.hi < y.lo for x, y in zip(parts, parts[1:]))


def test_position_and_running_values(spark, rows, table):
    pos = {r.id: r.pos for r in with_position(table, ["day", "id"], ["g"]).collect()}
    total = {r.id: r.running_sum for r in running(table, "v", ["day", "id"], "sum", ["g"]).collect()}
    low = {r.id: r.running_min for r in running(table, "v", ["day", "id"], "min").collect()}
    for group in _groups(rows).values():
        s = None
        for n, r in enumerate(group):
            s = s if r[3] is None else (s or 0) + r[3]
            assert pos[r[0]] == n
            assert (total[r[0]] is None) == (s is None) and (s is None or abs(total[r[0]] - s) < 1e-6)
    m = None
    for r in sorted(rows, key=_order):
        m = m if r[3] is None else r[3] if m is None else min(m, r[3])
        assert low[r[0]] == m


def test_steps_and_slopes_with_nulls(spark, rows, table):
    steps = {r.g: r.v_mean_step for r in W.mean_step(table, "v", ["day", "id"], "g").collect()}
    slopes = {r.g: r.v_trend for r in W.positional_slopes(table, "v", ["day", "id"], "g").collect()}
    for g, group in _groups(rows).items():
        d = [y[3] - x[3] for x, y in zip(group, group[1:]) if x[3] is not None and y[3] is not None]
        assert abs(steps[g] - sum(d) / len(d)) < 1e-9
        xy = [(n, r[3]) for n, r in enumerate(group) if r[3] is not None]
        mx, my = (sum(c) / len(xy) for c in zip(*xy))
        want = sum((x - mx) * (y - my) for x, y in xy) / sum((x - mx) ** 2 for x, _ in xy)
        assert abs(slopes[g] - want) < 1e-12


def test_empty_single_and_all_null(spark, table):
    none = table.where("false")
    assert with_position(none, ["day", "id"], ["g"]).count() == 0
    assert running(none, "v", ["id"]).count() == 0
    assert W.mean_step(none, "v", ["id"]).first()[0] is None
    assert W.positional_slopes(none, "v", ["id"], "g").count() == 0
    one = spark.createDataFrame([(1, "g", None, 2.0, None)], SCHEMA).drop("_row")
    assert with_position(one, ["day", "id"]).first().pos == 0
    assert W.mean_step(one, "v", ["day", "id"], "g").first()[1] is None
    assert W.positional_slopes(one, "v", ["day", "id"], "g").first()[1] is None
    nulls = spark.createDataFrame([(i, "g", None, None, None) for i in range(5)], SCHEMA).drop("_row")
    assert [tuple(r) for r in W.positional_slopes(nulls, "v", ["id"], "g").collect()] == [("g", None)]
    assert [r.running_sum for r in running(nulls, "v", ["id"]).collect()] == [None] * 5


def test_nothing_is_kept_or_joined(spark, table):
    for df in (W.mean_step(table, "v", ["day", "id"], "g"), running(table, "v", ["day", "id"], "sum", ["g"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    W.mean_step(table, "v", ["day", "id"], "g").collect()
    W.positional_slopes(table, "v", ["day", "id"], "g").collect()
    with_position(table, ["day", "id"], ["g"]).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept


def test_count_up_to(spark):
    """Numbers of cuts up to a value, for arrays of every length to 9, against a plain count."""
    rows = [(list(map(float, range(0, 2 * n, 2))), float(x)) for n in range(10) for x in range(-1, 2 * n + 1)]
    df = spark.createDataFrame(rows, "cuts array<double>, x double")
    got = with_count_up_to(df, "cuts", "x", 9, "n")
    assert all(r["n"] == sum(c <= r["x"] for c in r["cuts"]) for r in got.collect())
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_ranges_are_found_in_generated_code(spark, table):
    ranged = with_range(table, ["d", "id"] if "d" in table.columns else table.columns[:2], 4)
    assert "lambda" not in ranged._jdf.queryExecution().optimizedPlan().toString() and "_pid" in ranged.columns
    assert not [c for c in ranged.columns if c.startswith("_pid_")]
