"""Grouped statistics A4-A27. Every operator is one (or two) partial aggregates:
map-side combine first, then a shuffle of one row per group and task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfengine.functions.columns import removal_pct, ratio
from perfengine.operators.joins import join_small
from perfengine.schema import (AGE, CLASS, EFF, IN10, IN25, LOAD, OUT10, OUT25, PRESSURE,
                               REPLACE_FRACTION, TS)

_STATS = {
    "mean": F.avg, "std": F.stddev_samp, "std_pop": F.stddev_pop, "var": F.var_samp,
    "min": F.min, "max": F.max, "median": F.median, "count": F.count, "sum": F.sum,
}


def stat(name: str, col: str) -> Column:
    return _STATS[name](F.col(col))


def class_stats(df: DataFrame, spec: dict[str, list[str]], by: str | list[str] | None = CLASS,
                digits: int | None = None) -> DataFrame:
    """``{column: [stat, ...]}`` per group, flat names ``<column>_<stat>``."""
    aggs = []
    for c, names in spec.items():
        for s in names:
            e = stat(s, c)
            aggs.append((F.round(e, digits) if digits is not None and s != "count" else e).alias(f"{c}_{s}"))
    keys = [by] if isinstance(by, str) else list(by or [])
    return df.groupBy(*keys).agg(*aggs)


PERFORMANCE_SPEC = {EFF: ["mean", "std"], PRESSURE: ["mean", "std"],
                    "pm25_removal_efficiency": ["mean"], "pm10_removal_efficiency": ["mean"], AGE: ["mean"]}
ADVANCED_SPEC = {EFF: ["mean", "std", "min", "max"], PRESSURE: ["mean", "std", "min", "max"],
                 "performance_ratio": ["mean", "std"], AGE: ["mean", "std"]}


def performance_stats(df: DataFrame, by: str = CLASS, digits: int | None = 2) -> DataFrame:
    """A4: efficiency / pressure mean+std, removal means, mean age per class."""
    d = df.withColumns({"pm25_removal_efficiency": removal_pct(IN25, OUT25),
                        "pm10_removal_efficiency": removal_pct(IN10, OUT10)})
    return class_stats(d, PERFORMANCE_SPEC, by, digits)


def advanced_stats(df: DataFrame, by: str = CLASS, digits: int | None = 3) -> DataFrame:
    """A5: mean/std/min/max of efficiency and pressure, performance ratio, age."""
    d = df.withColumn("performance_ratio", ratio(EFF, PRESSURE))
    return class_stats(d, ADVANCED_SPEC, by, digits)


def removal_mean_of_ratios(df: DataFrame, by: str = CLASS) -> DataFrame:
    """Mean over rows of the per-row removal percentage."""
    return df.groupBy(by).agg(F.avg(removal_pct(IN25, OUT25)).alias("pm25_removal"),
                              F.avg(removal_pct(IN10, OUT10)).alias("pm10_removal"))


def _ratio_of_means(inlet: str, outlet: str) -> Column:
    return F.try_divide(F.avg(F.col(inlet) - F.col(outlet)), F.avg(inlet)) * 100


def removal_ratio_of_means(df: DataFrame, by: str = CLASS) -> DataFrame:
    """mean(in - out) / mean(in) x 100 (differs from A7 by design)."""
    return df.groupBy(by).agg(_ratio_of_means(IN25, OUT25).alias("pm25_removal"),
                              _ratio_of_means(IN10, OUT10).alias("pm10_removal"))


def trend(df: DataFrame, by: str | None = CLASS, x: str = AGE, y: str = EFF) -> DataFrame:
    """Least-squares line per group (``np.polyfit`` degree 1); slope also in percent."""
    g = df.groupBy(by) if by else df.groupBy()
    return g.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")) \
        .withColumn("slope_pct", F.col("slope") * 100)


def replacement_age(df: DataFrame, by: str = CLASS, age: str = AGE, y: str = EFF,
                    frac: float = REPLACE_FRACTION) -> DataFrame:
    """Youngest age with ``y < frac * max(y)`` in the group, else the group's oldest age.

    Pass 1 aggregates the max per group; the (group-sized) result is broadcast
    back after a size check, and pass 2 takes the conditional minimum. Neither
    pass shuffles rows, only partial aggregates.
    """
    first = df.groupBy(by).agg(F.max(y).alias("max_efficiency"), F.max(age).alias("max_age"))
    first = first.withColumn("threshold", F.col("max_efficiency") * frac).persist()
    second = (join_small(df.select(by, age, y), first.select(by, "threshold"), by)
              .groupBy(by).agg(F.min(F.when(F.col(y) < F.col("threshold"), F.col(age))).alias("_first_below")))
    return (join_small(first, second, by, "left")
            .select(by, "max_efficiency", "threshold",
                    F.coalesce("_first_below", "max_age").alias("replacement_age")))


def efficiency_days(df: DataFrame, by: str = CLASS, age: str = AGE, y: str = EFF) -> DataFrame:
    """Mean per (group, age), then their sum ("efficiency-days") and their mean."""
    per_age = df.groupBy(by, age).agg(F.avg(y).alias("_m"))
    return per_age.groupBy(by).agg(F.sum("_m").alias("efficiency_days"), F.avg("_m").alias("mean_daily_efficiency"))


def performance_patterns(df: DataFrame, by: str = CLASS) -> DataFrame:
    """mean/std efficiency, mean pressure, removal as ratio of means."""
    return df.groupBy(by).agg(
        F.avg(EFF).alias("avg_efficiency"), F.stddev_samp(EFF).alias("std_efficiency"),
        F.avg(PRESSURE).alias("avg_pressure_drop"),
        _ratio_of_means(IN25, OUT25).alias("pm25_removal"), _ratio_of_means(IN10, OUT10).alias("pm10_removal"))


def cost_effectiveness(report: DataFrame, costs: DataFrame, by: str = CLASS,
                       age_col: str = "optimal_replacement_age", eff_col: str = "avg_efficiency") -> DataFrame:
    """Cost per day of service and per unit of efficiency.

    ``eff_col`` chooses the divisor: the plain mean, or the mean of per-age
    means (A9). A class missing from the cost table keeps NULL costs.
    """
    r = join_small(report, costs, by, "left")
    return (r.withColumn("cost_per_day", F.try_divide(F.col("cost"), F.col(age_col)))
             .withColumn("cost_per_efficiency", F.try_divide(F.col("cost_per_day"), F.col(eff_col))))


def pivot_mean(df: DataFrame, row: str, col: str, y: str, values: list | None = None) -> DataFrame:
    """Mean of ``y`` per (row, col), ``col`` values spread into columns."""
    return df.groupBy(row).pivot(col, values).agg(F.avg(y))


def kpis(df: DataFrame, ts: str = TS) -> DataFrame:
    """Table KPIs in one aggregate pass."""
    span_us = F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts))
    return df.agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(EFF).alias("efficiency_mean"), F.stddev_samp(EFF).alias("efficiency_std"),
        F.avg(PRESSURE).alias("pressure_mean"), F.stddev_samp(PRESSURE).alias("pressure_std"),
        F.avg(LOAD).alias("load_mean"), F.stddev_samp(LOAD).alias("load_std"),
        (1 - F.try_divide(F.avg(PRESSURE), F.max(PRESSURE))).alias("pressure_performance"),
        F.avg(ratio(EFF, PRESSURE)).alias("pressure_efficiency"),
        F.floor(span_us / F.lit(86_400_000_000)).alias("date_span_days"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def radar(df: DataFrame, by: str = CLASS) -> DataFrame:
    """Five radar metrics per class (pressure management as 1 - mean(p) / max(p))."""
    return df.groupBy(by).agg(
        F.avg(EFF).alias("efficiency"), F.avg(LOAD).alias("load_handling"),
        (1 - F.try_divide(F.avg(PRESSURE), F.max(PRESSURE))).alias("pressure_management"),
        (1 - F.avg(ratio(OUT25, IN25))).alias("pm25_removal"),
        (1 - F.avg(ratio(OUT10, IN10))).alias("pm10_removal"))


def basic_stats(df: DataFrame, by: str = CLASS, y: str = EFF) -> DataFrame:
    """Sample size, mean, median (exact) and [min, max] range per class."""
    from perfengine.operators.quantiles import quantiles
    med = quantiles(df, y, [0.5], [by]).select(by, F.col("q0").alias("median"))
    base = df.groupBy(by).agg(F.count(F.lit(1)).alias("sample_size"), F.avg(y).alias("mean"),
                              F.array(F.min(y), F.max(y)).alias("range"))
    return base.join(med, by).select(by, "sample_size", "mean", "median", "range")


def hierarchy_sum(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Totals of ``value`` at every prefix of the hierarchy (rollup)."""
    return df.rollup(*levels).agg(F.sum(value).alias("total"))


def model_summary(results: DataFrame, by: list[str] = ("filter_class", "model"),
                  metrics: list[str] = ("r2", "rmse", "mae")) -> DataFrame:
    """Mean of each metric per (class, model)."""
    return results.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def cv_summary(folds: DataFrame, metrics: list[str], by: list[str] | None = None,
               two_sigma: bool = False) -> DataFrame:
    """Mean and sample std over folds (``two_sigma``: dashboard mean +- 2 population std)."""
    aggs = []
    for m in metrics:
        aggs.append(F.avg(m).alias(f"{m}_mean"))
        aggs.append((2 * F.stddev_pop(m) if two_sigma else F.stddev_samp(m)).alias(f"{m}_std"))
    return (folds.groupBy(*by) if by else folds.groupBy()).agg(*aggs)
