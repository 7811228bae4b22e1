"""Joins (J1-J6) and the size-checked broadcast used to bring per-group values back to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfengine.schema import CLASS, FILTER_COSTS

# Largest small side (rows) we broadcast; beyond it the join is a plain shuffle join
# (sort-merge, with AQE skew splitting).
BROADCAST_ROW_LIMIT = 1_000_000


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               limit_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Join a per-group result back onto a large table.

    The small side is materialised once (it is an aggregate: one row per group),
    its row count is checked, and only a side under ``limit_rows`` is broadcast.
    The big side is then never shuffled, so a hot group costs nothing extra.
    """
    small = small.persist()
    n = small.count()
    side = F.broadcast(small) if n <= limit_rows else small
    return big.join(side, on, how)


def cost_table(spark, costs: dict[str, float] = FILTER_COSTS, key: str = CLASS) -> DataFrame:
    """Class -> cost dimension as a tiny DataFrame."""
    return spark.createDataFrame(sorted(costs.items()), f"{key} string, cost double")


def with_cost(stats: DataFrame, costs: DataFrame, key: str = CLASS) -> DataFrame:
    """Attach the cost of each class; a class missing from the table is kept (cost NULL)."""
    return join_small(stats, costs, key, "left")


def compare_tables(raw: DataFrame, clean: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """Mean and sample std of each column, raw next to cleaned.

    One pass over the union of both tables with conditional aggregates, which
    is the full outer join on the key without a join.
    """

    keys = [by] if by else []
    both = (raw.select(*keys, *cols, F.lit("raw").alias("_t"))
            .unionByName(clean.select(*keys, *cols, F.lit("clean").alias("_t"))))
    aggs = []
    for tag in ("raw", "clean"):
        for c in cols:
            x = F.when(F.col("_t") == tag, F.col(c))
            aggs += [F.avg(x).alias(f"{c}_mean_{tag}"), F.stddev_samp(x).alias(f"{c}_std_{tag}")]
    return (both.groupBy(*keys) if keys else both.groupBy()).agg(*aggs)


def compare_classes(df: DataFrame, a: str, b: str, y: str = "efficiency", by: str = CLASS) -> DataFrame:
    """Mean, median, std, min, max of ``y`` for two classes, one metric per row.

    One grouped aggregate over the two classes, then unpivot and pivot to
    ``metric | <a> | <b>`` without any per-class scan.
    """
    from perfengine.operators.quantiles import quantiles
    two = df.where(F.col(by).isin(a, b))
    med = quantiles(two, y, [0.5], [by]).select(by, F.col("q0").alias("Median Efficiency"))
    agg = two.groupBy(by).agg(
        F.avg(y).alias("Mean Efficiency"), F.stddev_samp(y).alias("Std Dev"),
        F.min(y).alias("Min"), F.max(y).alias("Max")).join(med, by)
    metrics = ["Mean Efficiency", "Median Efficiency", "Std Dev", "Min", "Max"]
    long = agg.unpivot(by, metrics, "metric", "value")
    return long.groupBy("metric").pivot(by, [a, b] if a != b else [a]).agg(F.first("value"))
