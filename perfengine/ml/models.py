"""Estimators, preprocessing pipelines and per-class fitting.

Per-class models (the reference fits one model per filter class) are fitted
concurrently: a small driver thread pool submits one distributed fit per class
over a persisted, class-filtered table. Prediction and metrics are then single
whole-table plans.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, RobustScaler, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfengine.ml.trees import HistogramForest

# Spark's own bound on a tree's depth; a tree without a limit of its own ends by its leaf size or here.
DEEPEST = 30
# Bounds of the memory a task gives to the statistics of open nodes, in MB.
NODE_MEMORY = (256, 1024)
FIT_THREADS = 6
# Rows a task of a tree fit should have at least: every task fills and ships the statistics of all open nodes
# (nodes x features x bins), whatever its rows, so that many small tasks cost more than they save.
ROWS_PER_TASK = 32_768
# Rows a task of a tree fit should have at most: Spark keeps them as objects of some 300 bytes, more with many trees.
MOST_ROWS_PER_TASK = 2_000_000
# Boosted trees up to this depth walk every row from the root at each level: a table of the rows' nodes, made anew for
# each level of each tree, costs more than so short a walk.
WALKED_DEPTH = 3


def node_memory(trees: int, depth: int, bins: int = 32, n_features: int = 16) -> int:
    """MB for the (sum, square sum, count) of every feature and bin of the widest level of all trees, within
    ``NODE_MEMORY``: a level that needs more is grown in several passes, so deep trees cost passes, not memory."""
    low, high = NODE_MEMORY
    return min(high, max(low, (trees * 2 ** min(depth, DEEPEST) * n_features * bins * 24) >> 20))


def forest(num_trees: int = 100, max_depth: int | None = None, min_leaf: int = 1, seed: int = 42,
           label: str = "label", features: str = "features", max_bins: int = 32,
           bootstrap: bool = True) -> HistogramForest:
    """M2: random forest; all features considered at each split (the regressor default), grown by ``ml/trees.py``.

    Without ``max_depth`` a branch ends when its rows are pure, when a split would leave fewer than
    ``min_leaf`` rows, or at ``DEEPEST``. One tree without ``bootstrap`` is a plain regression tree.
    """
    depth = DEEPEST if max_depth is None else max_depth
    if not 0 <= depth <= DEEPEST:
        raise ValueError(f"max_depth must lie between 0 and {DEEPEST}")
    return HistogramForest(numTrees=num_trees, maxDepth=depth,
                           minInstancesPerNode=min_leaf, featureSubsetStrategy="all", seed=seed,
                           maxBins=max_bins, labelCol=label, featuresCol=features, bootstrap=bootstrap,
                           maxMemoryInMB=node_memory(num_trees, depth, max_bins), cacheNodeIds=True)


def gbt(max_iter: int = 100, max_depth: int = 3, step: float = 0.1, seed: int = 42, subsample: float = 1.0,
        label: str = "label", features: str = "features") -> GBTRegressor:
    """M3: gradient-boosted trees (stands in for both boosted-tree libraries); the trees are the same with or
    without ``cacheNodeIds``."""
    return GBTRegressor(maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=seed,
                        subsamplingRate=subsample, labelCol=label, featuresCol=features,
                        maxMemoryInMB=1024, cacheNodeIds=max_depth > WALKED_DEPTH)


def linear(reg: float = 0.0, l1: float = 0.0, label: str = "label", features: str = "features") -> LinearRegression:
    """M4 (and the lasso of M19 with ``l1=1``)."""
    return LinearRegression(regParam=reg, elasticNetParam=l1, solver="normal" if l1 == 0 else "auto",
                            labelCol=label, featuresCol=features, standardization=False)


ESTIMATORS = {"random_forest": forest, "gradient_boosting": gbt, "linear": linear}


def pipeline(features: list[str], estimator, scale: str | None = "robust", categorical: list[str] | None = None) -> Pipeline:
    """M5: categorical one-hot (first level dropped) + assembled numeric columns + scaler + estimator.

    The scaler is a pipeline stage, fitted on the training rows only.
    """
    stages, inputs = [], list(features)
    for c in categorical or []:
        # alphabetDesc puts the alphabetically first level last; dropLast then drops it. With "keep" an
        # extra slot for unknown levels would come last and be dropped instead.
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_idx", stringOrderType="alphabetDesc",
                                    handleInvalid="error"))
        stages.append(OneHotEncoder(inputCol=f"{c}_idx", outputCol=f"{c}_ohe", dropLast=True))
        inputs.append(f"{c}_ohe")
    raw = "raw_features" if scale else "features"
    stages.append(VectorAssembler(inputCols=inputs, outputCol=raw, handleInvalid="keep"))
    if scale == "robust":
        stages.append(RobustScaler(inputCol=raw, outputCol="features", withCentering=True, withScaling=True,
                                   relativeError=1e-4))
    elif scale == "standard":
        stages.append(StandardScaler(inputCol=raw, outputCol="features", withMean=True, withStd=True))
    stages.append(estimator)
    return Pipeline(stages=stages)


def assembled(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """``features`` as a vector, ``label`` and the columns ``keep``: what tree fits need, which no scaling changes."""
    vector = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
    rows = divided(df.select(*dict.fromkeys([*features, "label", *keep])))
    return vector.transform(rows).select("features", "label", *keep)


def divided(df: DataFrame) -> DataFrame:
    """``df`` in partitions of about ``MOST_ROWS_PER_TASK`` rows or fewer; tables that the session's cores can share so keep theirs."""
    wanted = -(-df.count() // MOST_ROWS_PER_TASK)
    return df.repartition(wanted) if wanted > df.sparkSession.sparkContext.defaultParallelism else df


def compact(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of ``rows`` rows in no more partitions than hold ``ROWS_PER_TASK`` rows each; large tables keep theirs."""
    return df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


def labelled(df: DataFrame, y: str) -> DataFrame:
    return df.withColumn("label", F.col(y).cast("double"))


def class_values(df: DataFrame, by: str) -> list:
    """The (few) classes; an aggregate of one row per class."""
    return [r[0] for r in df.select(by).distinct().orderBy(by).collect()]


def per_class(df: DataFrame, by: str, fn, threads: int = FIT_THREADS) -> dict:
    """Run ``fn(class_df, class_value)`` for every class, submitted concurrently.

    ``df`` is persisted once so each class filter scans the cache.
    """
    data = df.persist(StorageLevel.MEMORY_AND_DISK)
    classes = class_values(data, by)
    with ThreadPoolExecutor(max(1, min(threads, len(classes)))) as pool:
        futures = {c: pool.submit(fn, data.where(F.col(by) == F.lit(c)), c) for c in classes}
        return {c: f.result() for c, f in futures.items()}


def importances(model, features: list[str], spark) -> DataFrame:
    """Impurity importances of a fitted tree model (or the last stage of a pipeline), ranked."""
    m = model.stages[-1] if isinstance(model, PipelineModel) else model
    vals = m.featureImportances.toArray().tolist()
    rows = [(f, float(v)) for f, v in zip(features, vals)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


def predictions(model, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Actual vs predicted table."""
    return model.transform(df).select(*(keep or []), F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
