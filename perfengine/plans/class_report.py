"""A16 flagship: the per-class report (decline, replacement age, removal, cost).

Two passes over the readings, both partial aggregates:
  1. one ``groupBy`` for slope, max, mean, std, pressure and removal;
  2. the per-class threshold (one row per class, size-checked broadcast) is
     joined onto the rows and a conditional minimum gives the replacement age.
The cost lookup is a broadcast of the tiny cost dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfengine.operators.aggregates import _ratio_of_means, cost_effectiveness
from perfengine.operators.joins import join_small
from perfengine.schema import AGE, CLASS, EFF, IN10, IN25, OUT10, OUT25, PRESSURE, REPLACE_FRACTION

REPORT_COLUMNS = ["filter_class", "decline_rate", "optimal_replacement_age", "max_efficiency", "threshold",
                  "avg_efficiency", "std_efficiency", "avg_pressure_drop", "pm25_removal", "pm10_removal",
                  "cost", "cost_per_day", "cost_per_efficiency"]


def class_report(df: DataFrame, costs: DataFrame, by: str = CLASS, frac: float = REPLACE_FRACTION) -> DataFrame:
    stats = df.groupBy(by).agg(
        (F.regr_slope(EFF, AGE) * 100).alias("decline_rate"),
        F.max(EFF).alias("max_efficiency"),
        F.max(AGE).alias("_max_age"),
        F.avg(EFF).alias("avg_efficiency"),
        F.stddev_samp(EFF).alias("std_efficiency"),
        F.avg(PRESSURE).alias("avg_pressure_drop"),
        _ratio_of_means(IN25, OUT25).alias("pm25_removal"),
        _ratio_of_means(IN10, OUT10).alias("pm10_removal"),
    ).withColumn("threshold", F.col("max_efficiency") * frac).persist()  # one row per class, reused twice
    below = (join_small(df.select(by, AGE, EFF), stats.select(by, "threshold"), by)
             .groupBy(by).agg(F.min(F.when(F.col(EFF) < F.col("threshold"), F.col(AGE))).alias("_first_below")))
    report = (join_small(stats, below, by, "left")
              .withColumn("optimal_replacement_age", F.coalesce("_first_below", "_max_age"))
              .drop("_first_below", "_max_age"))
    return cost_effectiveness(report, costs, by).select(*[c if c != "filter_class" else by for c in REPORT_COLUMNS])
