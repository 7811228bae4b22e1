"""Distribution and curve data behind the charts.

Grids are generated per group with ``explode(sequence(...))`` from a one-row-per-
group aggregate; data rows meet a grid only after being pre-aggregated to
distinct (group, value) pairs, and the expanded rows are summed by a partial
aggregate in the same task. No cross join, no pairs of data rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfengine.functions.features import with_parallel_metrics
from perfengine.operators.joins import join_small
from perfengine.operators.quantiles import column_quantiles, quantiles
from perfengine.operators.scaling import minmax_scale, with_category_code
from perfengine.schema import AGE, CLASS, EFF, GRID_AGES, GRID_HOUR, GRID_MONTH, GRID_WEEKDAY, LOAD, PARALLEL_COLS


def age_grid(spark, n: int = GRID_AGES) -> DataFrame:
    """Ages 0 .. n-1."""
    return spark.range(n).select(F.col("id").cast("bigint").alias("age"))


def date_grid(df: DataFrame, ts: str, days: int = GRID_AGES, by: str | None = CLASS) -> DataFrame:
    """P10: ``days`` daily timestamps from each group's latest timestamp, with the day index."""
    keys = [by] if by else []
    last = (df.groupBy(*keys) if keys else df.groupBy()).agg(F.max(ts).alias("_start"))
    seq = F.sequence(F.col("_start"), F.col("_start") + F.expr(f"INTERVAL {days - 1} DAYS"), F.expr("INTERVAL 1 DAY"))
    return last.select(*keys, F.posexplode(seq).alias("day", "date")).withColumn("day", F.col("day").cast("bigint"))


def trend_line(df: DataFrame, by: str = CLASS, x: str = AGE, y: str = EFF, points: int = 100) -> DataFrame:
    """``points`` evenly spaced x from min to max per group with the fitted line's y."""
    g = df.groupBy(by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"),
                           F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    pts = g.select(by, "_lo", "_hi", "_a", "_b", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(points - 1)
    xv = F.when(F.col("k") == points - 1, F.col("_hi")).otherwise(F.col("_lo") + F.col("k") * step)
    return (pts.withColumn("x", xv).withColumn("y", F.col("_a") + F.col("_b") * F.col("x"))
            .select(by, F.col("k").cast("bigint").alias("k"), "x", "y"))


def box_stats(df: DataFrame, by: str, y: str, k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last point within k x IQR, outlier count per group."""
    q = quantiles(df, y, [0.25, 0.5, 0.75], [by]).select(
        by, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    q = q.withColumn("_lo", F.col("q1") - k * (F.col("q3") - F.col("q1"))) \
         .withColumn("_hi", F.col("q3") + k * (F.col("q3") - F.col("q1")))
    v = F.col(y)
    agg = join_small(df.select(by, y).where(v.isNotNull()), q, by).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(v >= F.col("_lo"), v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("_hi"), v)).alias("whisker_high"),
        F.count(F.when((v < F.col("_lo")) | (v > F.col("_hi")), 1)).alias("outliers"))
    return agg


def histogram(df: DataFrame, y: str, bins: int = 20, by: str | None = CLASS,
              lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Counts in ``bins`` equal bins over [lo, hi] (whole-table range by default);
    the last bin is closed on the right, values outside are not counted."""
    if lo is None or hi is None:
        r = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi")).first()
        lo, hi = (r["lo"] if lo is None else lo), (r["hi"] if hi is None else hi)
    keys = [by] if by else []
    v = F.col(y)
    width = (hi - lo) / bins if hi != lo else 1.0
    b = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    d = df.where((v >= lo) & (v <= hi)).select(*keys, b.alias("bin"))
    return d.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count")) \
        .withColumn("bin_start", F.lit(lo) + F.col("bin") * F.lit(width))


def condition_grid(df: DataFrame, cols: list[str], stat: str = "median", by: str = CLASS, ages: int = GRID_AGES,
                   age: str = AGE, fixed: dict | None = None, derived: dict[str, Column] | None = None) -> DataFrame:
    """Reference-condition grid: ages 0..ages-1 with the other features held at the
    class median (or mean), hour 12, weekday 3, month 6; ``derived`` columns are
    computed on the grid rows (e.g. ratios of the held values)."""
    fixed = {"hour": GRID_HOUR, "day_of_week": GRID_WEEKDAY, "month": GRID_MONTH} if fixed is None else fixed
    others = [c for c in cols if c != age]
    if stat == "median":
        med = column_quantiles(df, others, [0.5], [by])
        held = med.groupBy(by).pivot("column", others).agg(F.first("q0"))
    else:
        held = df.groupBy(by).agg(*[F.avg(c).alias(c) for c in others])
    grid = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(ages - 1))).alias("_age"))
    grid = grid.withColumn(age, F.col("_age").cast("double")).drop("_age")
    grid = grid.withColumns({k: F.lit(v) for k, v in fixed.items()})
    if derived:
        grid = grid.withColumns(derived)
    return grid


def surface(df: DataFrame, by: str = CLASS, x: str = AGE, y: str = LOAD, z: str = EFF, cells: int = 20,
            x_range: tuple[float, float] = (0.0, 100.0), y_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Observed mean of ``z`` on a cells x cells grid over (x, y); rows outside are skipped."""
    def cell(c, lo, hi):
        w = (hi - lo) / cells
        return F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(w)), F.lit(cells - 1)).cast("bigint")
    inside = (F.col(x).between(*x_range)) & (F.col(y).between(*y_range))
    return (df.where(inside).groupBy(by, cell(x, *x_range).alias("x_cell"), cell(y, *y_range).alias("y_cell"))
            .agg(F.avg(z).alias(f"{z}_mean"), F.count(F.lit(1)).alias("n")))


def hash_bucket(key: str, buckets: int = 1000) -> Column:
    """Partition-independent bucket of a key string: first 8 hex digits of its MD5, mod ``buckets``."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(key)), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def sample_points(df: DataFrame, cols: list[str], key: str, fraction: float = 0.1) -> DataFrame:
    """Deterministic sample of rows (by key hash) with the chosen columns."""
    return df.where(hash_bucket(key) < F.lit(int(round(fraction * 1000)))).select(key, *cols)


def parallel_table(df: DataFrame, by: str = CLASS, order: list[str] | None = None) -> DataFrame:
    """F11 metrics, min-max normalised (F15), class colour code (F16)."""
    d = minmax_scale(with_parallel_metrics(df), PARALLEL_COLS)
    return with_category_code(d, by, order)
