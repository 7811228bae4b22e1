"""Inputs shared by the registered queries: the readings view and its cleaned form.

The cleaning fences depend only on the data, so they are computed once per
input folder (like the reference's cleaned file, written once and read by
every later analysis) and then applied as literal filters.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfengine.operators.clean import apply_bounds, drop_incomplete, iqr_bounds
from perfengine.operators.joins import cost_table
from perfengine.sources.readers import events, readings_from_tables

_BOUNDS: dict[tuple, list] = {}

# --- Fixed values: cost dimension for the driver tables' classes (part types) ---
DRIVER_COSTS = {"ECONOMY": 100.0, "LARGE": 90.0, "MEDIUM": 80.0, "PROMO": 70.0, "SMALL": 50.0, "STANDARD": 30.0}


def _key(spark: SparkSession, sf_dir: str) -> tuple:
    stamp = tuple(os.path.getmtime(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part")
                  if os.path.exists(f"{sf_dir}/{t}.parquet"))
    return (spark.sparkContext.applicationId, os.path.abspath(sf_dir), stamp)


def readings(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    return readings_from_tables(spark, sf_dir, keyed)


def spread(df: DataFrame) -> DataFrame:
    """Spread a table read from few files over the session's cores before repeated passes.

    A single parquet row group is read by one task, so everything downstream
    would run on one core. Input made of at least ``defaultParallelism`` files
    (any large table) is left as it is: no shuffle at scale.
    """
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(par) if len(df.inputFiles()) < par else df


def _base(spark: SparkSession, sf_dir: str, keyed: bool) -> DataFrame:
    return spread(drop_incomplete(readings(spark, sf_dir, keyed)))


def cleaned(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    """P1 + P2 over the readings view, fences memoised per input; the fences are literal filters of the scan."""
    key = _key(spark, sf_dir)
    if key not in _BOUNDS:
        _BOUNDS[key] = iqr_bounds(_base(spark, sf_dir, False))
    return apply_bounds(_base(spark, sf_dir, keyed), _BOUNDS[key])


def costs(spark: SparkSession) -> DataFrame:
    return cost_table(spark, DRIVER_COSTS)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir)


def normalize(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: doubles rounded, small integers widened to bigint."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)
