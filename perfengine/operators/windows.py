"""Per-group broadcasts, positional and top-k operators.

No operator here windows over a whole class: per-class values come from a
partial aggregate joined back after a size check, positions from the
ranges in ``ordering``, and top-n from a ranking
whose limit is applied inside each task first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perfengine.operators.joins import join_small
from perfengine.operators.ordering import range_slopes, range_steps, running, with_position
from perfengine.schema import CLASS, EFF, PRESSURE, REPLACE_FRACTION



def group_values(df: DataFrame, by: str, aggs: dict) -> DataFrame:
    """Per-group scalars (one partial aggregate) attached to every row."""
    small = df.groupBy(by).agg(*[e.alias(n) for n, e in aggs.items()])
    return join_small(df, small, by)


def stability(df: DataFrame, y: str = EFF, by: str = CLASS, name: str | None = None) -> DataFrame:
    """``1 - std(y)`` of the row's class on every row."""
    return group_values(df, by, {name or f"{y.split('_')[0]}_stability": 1 - F.stddev_samp(y)})


def positional_slopes(df: DataFrame, y: str, order: list[str], by: str = CLASS) -> DataFrame:
    """W2 per class: slope of ``y`` against the row's position (0, 1, ...) within its class."""
    return range_slopes(df, y, order, [by])


def with_positional_trend(df: DataFrame, y: str, order: list[str], by: str = CLASS) -> DataFrame:
    """The class's positional slope attached to every row."""
    return join_small(df, positional_slopes(df, y, order, by), by)


def mean_step(df: DataFrame, y: str, order: list[str], by: str | None = None) -> DataFrame:
    """Mean of successive differences of ``y`` in ``order`` (``Series.diff().mean()``).

    A range of the order gives its own steps, and its first and last row the steps between ranges;
    NULL gaps are handled exactly and nothing runs in one task.
    """
    return range_steps(df, y, order, [by] if by else [])


def _top(df: DataFrame, by: str, col: str, n: int, desc: bool) -> DataFrame:
    """Top-n rows per group; ties go by the remaining columns, so the kept rows are always the same.

    Spark cuts each group to n rows inside every task before the shuffle (the partial window group
    limit, for n up to ``spark.sql.optimizer.windowGroupLimitThreshold``), so a hot group stays small.
    """
    o = F.col(col).desc_nulls_last() if desc else F.col(col).asc_nulls_last()
    ties = [F.col(c) for c in df.columns if c not in (by, col)]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(o, *ties))).where(F.col("rank") <= n)


def peak(df: DataFrame, by: str = CLASS, hi: str = EFF, lo: str = PRESSURE, n: int = 10) -> DataFrame:
    """Mean of the n largest ``hi`` and of the n smallest ``lo`` per class."""
    top = _top(df.select(by, hi).where(F.col(hi).isNotNull()), by, hi, n, True).groupBy(by).agg(F.avg(hi).alias(f"{hi}_top{n}_mean"))
    bottom = _top(df.select(by, lo).where(F.col(lo).isNotNull()), by, lo, n, False).groupBy(by).agg(F.avg(lo).alias(f"{lo}_bottom{n}_mean"))
    return top.join(bottom, by, "full_outer")


def cumulative_share(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Cumulative sum of ``value`` in order (cumulative explained variance)."""
    return running(df, value, order, "sum", name=f"cumulative_{value}")


def best_so_far(df: DataFrame, value: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Running minimum of ``value`` in order (best objective so far)."""
    return running(df, value, order, "min", by, name="best_value")


def forecast_replacement(pred: DataFrame, by: str = CLASS, age: str = "age", y: str = "predicted_efficiency",
                         frac: float = REPLACE_FRACTION, horizon: int = 60) -> DataFrame:
    """W7 + W9: first grid age whose prediction is under ``frac`` x the prediction at the
    youngest age; ``horizon`` if none; and the prediction at min(age, horizon - 1)."""
    init = pred.groupBy(by).agg(F.min_by(y, age).alias("initial_efficiency"))
    first = (join_small(pred.select(by, age, y), init, by).groupBy(by).agg(
        F.first("initial_efficiency").alias("initial_efficiency"),
        F.min(F.when(F.col(y) < F.col("initial_efficiency") * frac, F.col(age))).alias("_below")))
    rep = first.select(by, "initial_efficiency",
                       F.coalesce(F.col("_below"), F.lit(horizon)).cast("bigint").alias("replacement_age"))
    at = pred.select(by, F.col(age).cast("bigint").alias("_age"), F.col(y).alias("efficiency_at_replacement"))
    return (rep.withColumn("_age", F.least(F.col("replacement_age"), F.lit(horizon - 1)).cast("bigint"))
            .join(at, [by, "_age"], "left").drop("_age"))


def replacement_date(sched: DataFrame, as_of, by: str = CLASS, date: str = "date",
                     y: str = "predicted_efficiency", threshold: float = REPLACE_FRACTION) -> DataFrame:
    """First date whose prediction is under the absolute ``threshold`` and days from
    ``as_of`` (an argument, not the clock) until then; initial prediction too."""
    g = sched.groupBy(by).agg(
        F.min_by(y, date).alias("initial_efficiency"),
        F.min(F.when(F.col(y) < threshold, F.col(date))).alias("replacement_date"))
    return g.withColumn("days_until_replacement",
                        F.datediff(F.to_date("replacement_date"), F.to_date(F.lit(as_of))).cast("bigint"))


def series(df: DataFrame, ts: str, cols: list[str], by: str | None = CLASS, long: bool = False) -> DataFrame:
    """Time-ordered series (global range-partitioned sort); ``long`` unpivots the metrics."""
    keys = [by] if by else []
    d = df.select(*keys, ts, *cols)
    if long:
        d = d.unpivot([*keys, ts], cols, "metric", "value")
        return d.orderBy(*keys, ts, "metric")
    return d.orderBy(*keys, ts)


def daily_frames(df: DataFrame, ts: str, cols: list[str], by: str | None = CLASS) -> DataFrame:
    """Animation frames keyed by calendar date; ``frame`` counts days from the first date."""
    first = df.agg(F.min(F.to_date(ts)).alias("d")).first()["d"]
    keys = [by] if by else []
    return (df.select(*keys, F.to_date(ts).alias("date"), *cols)
            .withColumn("frame", F.datediff("date", F.lit(first)).cast("bigint"))
            .orderBy("frame", *keys))


def first_seen(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Distinct classes in order of first appearance, with their rank."""
    firsts = df.groupBy(by).agg(F.min(F.struct(*order)).alias("_first"))
    return with_position(firsts, ["_first"], name="first_seen_rank").select(by, "first_seen_rank")


def top_k(df: DataFrame, score: str, k: int, by: str | None = None, desc: bool = True) -> DataFrame:
    """O2: k best rows overall (``orderBy().limit``) or per group (ranked with a limit in each task)."""
    if by is None:
        o = F.col(score).desc() if desc else F.col(score).asc()
        return df.orderBy(o, *[c for c in df.columns if c != score]).limit(k)
    return _top(df, by, score, k, desc)


def best_by(df: DataFrame, by: str, item: str, score: str) -> DataFrame:
    """O3: the item with the highest score per group (``max_by``, a partial aggregate)."""
    return df.groupBy(by).agg(F.max_by(item, score).alias(f"best_{item}"), F.max(score).alias(f"best_{score}"))


def first_by(df: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    """Value of the first row of each group in ``order``."""
    return df.groupBy(by).agg(F.min_by(value, F.struct(*order)).alias(f"first_{value}"))
