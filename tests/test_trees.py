"""The forests of ``ml/trees.py`` against Spark's own learner, plain sums and the bootstrap's distribution."""

import math

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from perfengine.ml import models as M, trees as T


def _data(spark, n=6_000, parts=3):
    rows = spark.range(0, n, 1, parts).select(*[F.rand(i).alias(f"x{i}") for i in range(5)]).withColumn(
        "label", F.round(F.col("x0") * 3) + F.sin(F.col("x1") * 6) * F.col("x2") + F.randn(9) / 10)
    return M.assembled(rows, [f"x{i}" for i in range(5)], [])


def _walk(model):
    """(feature, threshold, prediction) of the nodes of a model's trees, from the root downwards."""
    def nodes(n):
        if n.numDescendants() == 0:
            return [(None, None, round(n.prediction(), 9))]
        return [(n.split().featureIndex(), round(n.split().threshold(), 9), round(n.prediction(), 9)), *nodes(n.leftChild()), *nodes(n.rightChild())]

    return [nodes(t._java_obj.rootNode()) for t in model.trees]


def _spark_twin(forest):
    twin = RandomForestRegressor()
    for p in forest.params:
        if forest.isSet(p):
            twin.set(twin.getParam(p.name), forest.getOrDefault(p))
    return twin


@pytest.mark.parametrize("paired", [0, 16])
def test_tree_without_bootstrap_is_sparks_tree(spark, monkeypatch, paired):
    """Only the bootstrap's draws differ from Spark's learner: without it, nodes and importances are the same."""
    monkeypatch.setattr(T, "PAIRED_NODES", paired)
    data = _data(spark).persist()
    forest = M.forest(1, 6, 5, bootstrap=False)
    ours, theirs = forest.fit(data), _spark_twin(forest).fit(data)
    assert _walk(ours) == _walk(theirs) and ours.trees[0].depth == 6
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray(), rtol=1e-9)
    data.unpersist()


def test_forest_is_as_good_as_sparks(spark):
    data = _data(spark, 12_000).persist()
    forest = M.forest(30, 6)
    errors = []
    for model in (forest.fit(data), _spark_twin(forest).fit(data)):
        assert len(model.trees) == 30 and math.isclose(sum(model.featureImportances.toArray()), 1.0, rel_tol=1e-9)
        errors.append(model.transform(data).agg(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0])
    assert errors[0] == pytest.approx(errors[1], rel=0.05)
    data.unpersist()


def test_trees_do_not_hang_on_tasks_or_passes(spark, monkeypatch):
    """The same trees whatever the tasks of a level, on rows in the same order (partitions are merged in an order that may change)."""
    data = _data(spark, parts=1).persist()
    first = _walk(M.forest(6, 5).fit(data))
    assert len({str(t) for t in first}) == 6
    monkeypatch.setattr(T, "TASK_STEPS", 1_000)
    assert _walk(M.forest(6, 5).fit(data)) == first
    data.unpersist()


def test_open_nodes_of_a_pass_are_bounded(monkeypatch):
    """Nodes counted in several passes over the blocks have the sums of one pass."""
    import pyarrow as pa
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 8, (3, 500)).astype("u1"), rng.random(500)
    tree = T._Tree()
    for feature in (0, 1, 2):
        nodes = np.zeros(len(tree.frontier), T._NODE)
        nodes["feature"], nodes["bin"] = feature, 3
        tree.grow(nodes)
    batch = pa.RecordBatch.from_pylist([{"block": 0, "n": 500, "bins": x.tobytes(), "label": y.tobytes(), "group": 0, "groups": 1}])

    def counted():
        out = []
        for b in T._counter({0: tree.table(3, 255)}, 3, 8, "u1", 1, True, True)(iter([batch])):
            (r,) = b.to_pylist()
            out.append((np.frombuffer(r["counts"], "<i4").reshape(3, -1, 8), np.frombuffer(r["sums"], "<f8").reshape(3, -1, 8)))
        return [np.concatenate(part, 1) for part in zip(*out)]

    one = counted()
    monkeypatch.setattr(T, "OPEN_NODES", 3)
    monkeypatch.setattr(T, "PAIRED_NODES", 0)
    three = counted()
    w = T.poisson(1, 0, 0, 500)
    assert one[0].shape == (3, 8, 8) and (one[0].sum((1, 2)) == w.sum()).all()
    assert (one[0] == three[0]).all() and np.allclose(one[1], three[1], rtol=1e-12)
    place = (x[0] > 3) * 4 + (x[1] > 3) * 2 + (x[2] > 3)
    plain = np.zeros((8, 8))
    np.add.at(plain, (place, x[1]), w * y)
    assert np.allclose(sorted(one[1][1].ravel()), sorted(plain.ravel()), rtol=1e-12)


def test_poisson_counts():
    n = 2_000_000
    w = T.poisson(42, 3, 5, n)
    assert (w == T.poisson(42, 3, 5, n)).all() and (w != T.poisson(42, 4, 5, n)).any()
    for k in range(9):
        p = math.exp(-1) / math.factorial(k)
        assert abs((w == k).mean() - p) < 5 * math.sqrt(p / n) + 1e-9
    assert w.max() < 20


def test_one_row(spark):
    """Trees whose bootstrap draws nothing predict 0, the others the row's label."""
    data = M.assembled(spark.createDataFrame([(1.0, 3.0)], "x double, label double"), ["x"], [])
    model = M.forest(20, 4).fit(data)
    leaves = [t._java_obj.rootNode().prediction() for t in model.trees]
    assert set(leaves) == {0.0, 3.0} and model.transform(data).first()["prediction"] == pytest.approx(sum(leaves) / 20)


def test_labels_and_features_without_a_value_are_refused(spark):
    from pyspark.ml.linalg import Vectors
    for rows in ([(Vectors.dense([1.0]), None)], [(Vectors.dense([float("nan")]), 1.0)]):
        with pytest.raises(Exception, match="NaN|null|Null"):
            M.forest(2, 2).fit(spark.createDataFrame([*rows, (Vectors.dense([2.0]), 1.0)], ["features", "label"]))
