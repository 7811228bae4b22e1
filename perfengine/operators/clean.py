"""Cleaning and table profiling: P1, P2, P4, P7, P12, F5, A1, A2."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfengine.operators.quantiles import exact_quantiles, first_brackets, global_quantiles
from perfengine.schema import NUMERIC_COLS

# Share of the rows by which earlier fences may move a quartile's rank before its bracket misses it, which costs a round.
SURVIVOR_SLACK = 0.02


def drop_incomplete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop a row with any missing value (NaN was turned into NULL at ingest)."""
    return df.na.drop("any", subset=cols)


def iqr_bounds(df: DataFrame, cols: list[str] = NUMERIC_COLS, k: float = 1.5,
               accuracy: int | None = None, persist: bool = True) -> list[tuple[str, float, float]]:
    """Fences of the **sequential** IQR filter.

    Column i's quartiles are computed on the rows that survived the fences of
    columns 0..i-1 (never independent fences). Each step is one selection
    whose result is two doubles; the fences then enter later steps as literals,
    so with a parquet source they are pushed into the scan. ``persist`` keeps the
    fenced columns alone while the steps run.
    """
    base = df.select(*cols)
    if persist:
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
    # the brackets of all columns from one pass: on the survivors they are still near, and only have to be near
    brackets = {} if accuracy else first_brackets(base, list(cols), [0.25, 0.75], SURVIVOR_SLACK)
    cur, bounds = base, []
    for c in cols:
        q1, q3 = (global_quantiles(cur, {c: [0.25, 0.75]}, accuracy)[c] if accuracy
                  else exact_quantiles(cur, c, [0.25, 0.75], brackets.get(c)))
        if q1 is None:  # no rows left: every later fence removes everything as well
            lo = hi = None
            cur = cur.where(F.lit(False))
        else:
            iqr = q3 - q1
            lo, hi = q1 - k * iqr, q3 + k * iqr
            cur = cur.where((F.col(c) >= F.lit(lo)) & (F.col(c) <= F.lit(hi)))
        bounds.append((c, lo, hi))
    if persist:
        base.unpersist()
    return bounds


def apply_bounds(df: DataFrame, bounds: list[tuple[str, float, float]]) -> DataFrame:
    """Keep rows inside every fence (inclusive); one filter with literal bounds."""
    cond = F.lit(True)
    for c, lo, hi in bounds:
        if lo is None:
            return df.where(F.lit(False))
        cond = cond & (F.col(c) >= F.lit(lo)) & (F.col(c) <= F.lit(hi))
    return df.where(cond)


def iqr_filter(df: DataFrame, cols: list[str] = NUMERIC_COLS, k: float = 1.5,
               accuracy: int | None = None, persist: bool = True) -> DataFrame:
    """Sequential IQR outlier filter (global, k=1.5, bounds inclusive)."""
    bounds = iqr_bounds(df, cols, k, accuracy, persist)
    return apply_bounds(df, bounds)


def clean(df: DataFrame, cols: list[str] = NUMERIC_COLS, k: float = 1.5, accuracy: int | None = None) -> DataFrame:
    """P1 then P2: the cleaned readings table."""
    return iqr_filter(drop_incomplete(df), cols, k, accuracy)


def cleaning_summary(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """A1: row and column counts before and after, rows removed."""
    tagged = raw.select(F.lit(1).alias("_r"), F.lit(0).alias("_c")).unionByName(
        cleaned.select(F.lit(0).alias("_r"), F.lit(1).alias("_c")))
    return (tagged.agg(F.sum("_r").cast("bigint").alias("rows_original"),
                       F.sum("_c").cast("bigint").alias("rows_cleaned"))
            .withColumn("rows_removed", F.col("rows_original") - F.col("rows_cleaned"))
            .withColumn("columns", F.lit(len(raw.columns)).cast("bigint")))


def winsorise(df: DataFrame, cols: list[str], lo: float = 0.01, hi: float = 0.99,
              accuracy: int | None = None) -> DataFrame:
    """clip columns to their global lo/hi quantiles (one selection for all columns).

    NULL stays NULL (``greatest``/``least`` would otherwise replace it by a bound).
    """
    q = global_quantiles(df, {c: [lo, hi] for c in cols}, accuracy)
    out = {}
    for c in cols:
        a, b = q[c]
        if a is None:
            continue
        out[c] = F.when(F.col(c).isNull(), F.lit(None).cast("double")).otherwise(
            F.least(F.greatest(F.col(c), F.lit(a)), F.lit(b)))
    return df.withColumns(out) if out else df


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of numeric columns, from the schema (no data pass)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def select_classes(df: DataFrame, values: list[str] | None, by: str = "filter_class") -> DataFrame:
    """Keep the chosen classes; an empty choice keeps all."""
    return df.where(F.col(by).isin(list(values))) if values else df


def profile(df: DataFrame) -> DataFrame:
    """One row per column with its type and non-null count (one aggregate job)."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    pairs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("dtype"),
                      F.col(f"`{c}`").cast("bigint").alias("non_null")) for i, (c, t) in enumerate(df.dtypes)]
    return counts.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def describe_exact(df: DataFrame, cols: list[str], accuracy: int | None = None) -> DataFrame:
    """A2: count, mean, std, min, 25/50/75 %, max per column (exact quantiles), long form."""
    from perfengine.operators.quantiles import column_quantiles
    moments = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(c).cast("double").alias("count"),
                                 F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                                 F.min(c).cast("double").alias("min"),
                                 F.max(c).cast("double").alias("max")).alias(c) for c in cols])
    moments = moments.select(F.explode(F.array(*[F.col(f"`{c}`") for c in cols])).alias("d")).select("d.*")
    q = column_quantiles(df, cols, [0.25, 0.5, 0.75], None, accuracy).select(
        "column", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    return moments.join(q, "column").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")
