"""Spark ML operators on the sf0.001 fixture: shapes and ranges (their values are model-dependent)."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from perfengine.functions.features import with_features
from perfengine.ml import ensembles, evaluation, forecast as FC, models as M, pca, selection, split
from perfengine.ml.metrics import regression_metrics
from perfengine.plans import inputs as I
from perfengine.schema import CLASS, EFF, FEATURES_INTERACTION, NUMERIC_COLS

KEY = "reading_key"


@pytest.fixture(scope="module")
def keyed(spark):
    return I.cleaned(spark, SF_SMALL, keyed=True).persist()


@pytest.fixture(scope="module")
def inter(keyed):
    return M.labelled(with_features(keyed, "interaction"), EFF).persist()


def test_forecast_shapes_and_ranges(keyed):
    out = FC.forecast(keyed, KEY, num_trees=10, max_depth=5)
    pred = out["predictions"]
    per_class = {r[0]: r[1] for r in pred.groupBy(CLASS).count().collect()}
    assert per_class and all(n == 60 for n in per_class.values())
    imp = out["importances"].groupBy(CLASS).agg(F.sum("importance").alias("s")).collect()
    assert all(math.isclose(r["s"], 1.0, rel_tol=1e-9) for r in imp)
    for r in out["metrics"].collect():
        assert r["r2"] is None or r["r2"] <= 1.0
    rep = out["replacement"].collect()
    assert len(rep) == len(per_class)
    assert all(0 <= r["replacement_age"] <= 60 for r in rep)
    adv = FC.advice(out["replacement"]).collect()
    assert all(r["check_at_age"] == r["replace_at_age"] - 5 for r in adv)


def test_hash_split_is_deterministic_and_disjoint(keyed):
    train, test = split.hash_split(keyed, KEY)
    n, a, b = keyed.count(), train.count(), test.count()
    assert a + b == n and 0.1 < b / n < 0.3
    assert train.join(test, KEY).count() == 0
    again = split.hash_split(keyed.repartition(7), KEY)[1]
    assert sorted(r[0] for r in again.select(KEY).collect()) == sorted(r[0] for r in test.select(KEY).collect())


def test_cross_validation_and_oof(inter):
    data = split.with_hash_folds(inter, KEY)
    metrics, pred = evaluation.cross_validate(
        data, lambda: M.pipeline(FEATURES_INTERACTION, M.forest(10, 5), "standard"))
    rows = metrics.orderBy("fold").collect()
    assert [r["fold"] for r in rows] == [1, 2, 3, 4, 5]
    assert all(r["r2"] <= 1 and r["rmse"] >= 0 for r in rows)
    assert pred.count() == data.count()  # every row predicted exactly once


def test_learning_curve_sizes(inter):
    data = split.with_ordered_folds(inter, [KEY])
    lc = evaluation.learning_curve(data, lambda: M.pipeline(FEATURES_INTERACTION, M.forest(5, 4), "standard"),
                                   sizes=[0.5, 1.0])
    rows = lc.collect()
    assert len(rows) == 2 and rows[0]["train_size"] < rows[1]["train_size"]
    assert all(r["training_score"] <= 1 for r in rows)


def test_grid_and_random_search(inter):
    data = split.with_hash_folds(inter, KEY)
    est = M.gbt(5, 2)
    pipe = M.pipeline(FEATURES_INTERACTION, est, "standard")
    cv = evaluation.grid_search(data, pipe, est, {"maxDepth": [2, 3]})
    assert len(cv.avgMetrics) == 2
    rf = M.forest(5, 3)
    model, trials = evaluation.random_search(data, M.pipeline(FEATURES_INTERACTION, rf, "standard"), rf,
                                             {"numTrees": (3, 6), "maxDepth": (2, 4)}, n_trials=3)
    from perfengine.operators.windows import best_so_far
    best = best_so_far(trials, "value", ["trial"]).orderBy("trial").collect()
    assert len(best) == 3 and best[-1]["best_value"] == min(r["value"] for r in best)


def test_selection(inter):
    data = split.with_hash_folds(inter, KEY)
    kept, table = selection.select_lasso(data, FEATURES_INTERACTION, [1e-4, 1e-2])
    assert table.count() == len(FEATURES_INTERACTION) and set(kept) <= set(FEATURES_INTERACTION)
    kept, table = selection.select_rfe(inter, FEATURES_INTERACTION, keep=8, num_trees=5, step=3, max_depth=6)
    assert len(kept) == 8
    model = M.pipeline(FEATURES_INTERACTION, M.forest(5, 4), "standard").fit(inter)
    imp = selection.permutation_importance(model, inter, FEATURES_INTERACTION[:3], [KEY])
    assert imp.count() == 3


def test_ensembles(inter):
    data = split.with_hash_folds(inter, KEY)
    train, test = split.hash_split(data, KEY)
    makers = {"rf": lambda: M.pipeline(FEATURES_INTERACTION, M.forest(5, 4), "standard"),
              "lin": lambda: M.pipeline(FEATURES_INTERACTION, M.linear(), "standard")}
    vote = ensembles.fit_voting(train, makers).transform(test)
    r = vote.select(((F.col("pred_rf") + F.col("pred_lin")) / 2 - F.col("prediction")).alias("d")) \
        .agg(F.max(F.abs("d"))).first()[0]
    assert r < 1e-12
    assert {r["fold"] for r in train.select("fold").distinct().collect()} == set(range(5))
    oof = ensembles.out_of_fold(train, {"lin": makers["lin"]})
    assert oof.count() == train.count()
    stack = ensembles.fit_stacking(train, makers)
    m = regression_metrics(stack.transform(test)).first()
    assert m["n"] == test.count()


def test_compare_models_and_schedule(keyed):
    cmp = FC.compare_models(with_features(keyed, "interaction"), KEY, FEATURES_INTERACTION, num_trees=5, max_depth=8)
    assert {r["model"] for r in cmp.collect()} == {"Random Forest", "Gradient Boosting"}
    out = FC.maintenance_schedule(keyed.where(F.col(CLASS).isin("PROMO", "SMALL")), KEY, "2002-01-01")
    assert out["schedule"].groupBy(CLASS).count().where("count != 60").count() == 0


def test_pca_against_numpy(keyed):
    import numpy as np
    v = pca.pca(keyed, NUMERIC_COLS).collect()
    assert len(v) == len(NUMERIC_COLS) and math.isclose(v[-1]["cumulative"], 1.0, rel_tol=1e-9)
    x = np.array([[r[c] for c in NUMERIC_COLS] for r in keyed.select(*NUMERIC_COLS).collect()])
    z = (x - x.mean(0)) / x.std(0)
    ev = np.sort(np.linalg.eigvalsh(np.cov(z, rowvar=False)))[::-1]
    assert np.allclose([r["explained_variance_ratio"] for r in v], ev / ev.sum(), atol=1e-9)
    p = pca.pca_project(keyed, NUMERIC_COLS, 3, [CLASS])
    assert p.columns == [CLASS, "PC1", "PC2", "PC3"]
    pcs = np.array([[r["PC1"], r["PC2"], r["PC3"]] for r in p.collect()])
    assert np.allclose(pcs.var(0), ev[:3] * (len(x) - 1) / len(x), rtol=1e-6)


def test_one_tree_without_a_limit_gives_cell_means(spark):
    """A staircase of 24 steps, taller from step to step, can only be cut off one step at a time: deeper than ten."""
    rows = [(float(x), 4.0 ** x + e) for x in range(24) for e in (-0.25, 0.25)]
    df = spark.createDataFrame(rows, "x double, label double")
    data = M.assembled(df, ["x"], ["x"])
    model = M.forest(1, bootstrap=False).fit(data)
    assert model.trees[0].depth > 10
    for r in model.transform(data).collect():
        assert r.prediction == pytest.approx(4.0 ** r.x, rel=1e-9)
    # leaves hold the asked number of rows
    wide = M.forest(1, min_leaf=8, bootstrap=False).fit(data).transform(data).groupBy("prediction").count()
    assert wide.count() > 1 and min(r["count"] for r in wide.collect()) >= 8


def test_depth_and_node_memory_bounds():
    assert M.forest(10).getMaxDepth() == 30 and M.forest(10, 0).getMaxDepth() == 0
    with pytest.raises(ValueError):
        M.forest(10, 31)
    assert M.node_memory(1, 3) == M.NODE_MEMORY[0] and M.node_memory(100, 30) == M.NODE_MEMORY[1]


def test_rows_of_a_tree_task_are_bounded(spark, monkeypatch):
    """A table of more rows than the cores' tasks may hold is divided; no row is lost and small tables keep their plan."""
    df = spark.range(2000).selectExpr("double(id) AS x", "double(id % 7) AS label").coalesce(1)
    assert M.assembled(df, ["x"], ["x"]).rdd.getNumPartitions() == 1
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(M, "MOST_ROWS_PER_TASK", 2000 // (2 * cores))
    out = M.assembled(df, ["x"], ["x"])
    assert out.rdd.getNumPartitions() >= 2 * cores
    assert out.count() == 2000 and out.agg(F.sum("x")).first()[0] == sum(range(2000))


def test_shallow_boosting_keeps_no_node_table(spark):
    assert not M.gbt(50).getCacheNodeIds() and M.gbt(3, 8).getCacheNodeIds()
    rows = spark.range(0, 4_000, 1, 4).select(*[F.rand(i).alias(f"x{i}") for i in range(4)]).withColumn(
        "label", F.col("x0") * F.col("x1") + F.sin(F.col("x2") * 6))
    data = M.assembled(rows, [f"x{i}" for i in range(4)], []).persist()
    trees = [e.fit(data).toDebugString.split("\n", 1)[1] for e in (M.gbt(5), M.gbt(5).setCacheNodeIds(True))]
    data.unpersist()
    assert trees[0] == trees[1]
