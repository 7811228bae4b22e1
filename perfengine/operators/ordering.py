"""Row-order primitives that stay distributed.

The reference relies on file order. Here every positional operator takes an
explicit total order and is computed without a window over a whole class
(a hot class would otherwise land in one task):

* ``with_range`` gives every row the number of its range of the order. The cut
  points are read once from a bounded sample and stand in the plan as literals,
  so a row's range depends on the row alone: every consumer, and every task run
  again after a loss, sees the same ranges, and nothing has to be kept;
* per (group, range) totals form a small table (groups x ranges rows) whose
  prefix over the earlier ranges is what a range starts from;
* this start enters each (group, range) as one boundary row before its first
  row, so that a window inside the range finishes the job without a join.

The input is read several times and must give the same rows each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Sampled rows for each range, for the cut points alone.
SAMPLE_PER_RANGE = 32


def _leaves(schema: StructType, names: list[str]) -> list[tuple[str, DataType]]:
    """(path, type) of the order columns; structs are taken field by field."""
    out = []
    for name in names:
        kind = schema[name].dataType
        inner = _leaves(kind, kind.names) if isinstance(kind, StructType) else None
        out += [(f"`{name}`", kind)] if inner is None else [(f"`{name}`.{path}", t) for path, t in inner]
    return out


def ascending(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def with_range(df: DataFrame, order: list[str], n: int | None = None, name: str = "_pid") -> DataFrame:
    """``df`` with the number of each row's range of ``order``, non-decreasing in it; equal keys share a range.

    There are about ``n`` ranges (the session's shuffle partitions) of about equal size. The sample
    has ``SAMPLE_PER_RANGE`` rows a range, whatever the input's size.
    """
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    leaves = _leaves(df.schema, order)
    keys = df.select(*[F.col(path).alias(f"k{i}") for i, (path, _) in enumerate(leaves)])
    rows = keys.count()
    wanted = n * SAMPLE_PER_RANGE
    if rows > 4 * wanted:
        keys = keys.sample(wanted / rows, seed=7)
    sample = keys.orderBy(*ascending(keys.columns)).collect() if rows else []
    cuts = [sample[len(sample) * i // n] for i in range(1, n)] if len(sample) >= n else sample[1:]
    if not cuts:
        return df.withColumn(name, F.lit(0))
    # sorted by Spark, as the driver's values may order otherwise (time zones, nulls)
    points = F.sort_array(F.array(*[
        F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, (_, t)) in enumerate(zip(cut, leaves))]) for cut in cuts]))
    key = F.struct(*[F.col(path).alias(f"k{i}") for i, (path, _) in enumerate(leaves)])
    at = with_count_up_to(df.withColumn(f"{name}_cuts", points).withColumn(f"{name}_key", key), f"`{name}_cuts`", f"`{name}_key`", len(cuts), name)
    return at.drop(f"{name}_cuts", f"{name}_key")


def with_count_up_to(df: DataFrame, cuts: str, x: str, most: int, name: str) -> DataFrame:
    """``df`` with the number of the values of the sorted array ``cuts`` (of ``most`` values or fewer) up to ``x``.

    The cuts are halved step by step in plain expressions: a function with a lambda would leave generated code, and
    every row would be copied with its array.
    """
    out = df.withColumn(name, F.lit(0))
    for step in [1 << i for i in reversed(range(most.bit_length()))]:
        out = out.withColumn(name, F.expr(f"CASE WHEN get({cuts}, {name} + {step - 1}) <= {x} THEN {name} + {step} ELSE {name} END"))
    return out


def _before(by: list[str]):
    """The earlier ranges of a group (few rows: one a range)."""
    return Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)


def _carried(df: DataFrame, order: list[str], by: list[str], agg, value: Column) -> tuple[DataFrame, Column]:
    """The rows with one boundary row for each (group, range), and ``agg`` of ``value`` up to each row.

    A boundary row has ``_row`` 0 and holds in ``_carry`` the state of all earlier ranges.
    """
    ranged = with_range(df, order).withColumn("_value", value)
    parts = ranged.groupBy(*by, "_pid").agg(agg("_value").alias("_carry"))
    start = parts.select(*by, "_pid", agg("_carry").over(_before(by)).alias("_carry"), F.lit(0).alias("_row"))
    rows = ranged.withColumn("_row", F.lit(1)).unionByName(start, allowMissingColumns=True)
    up_to = (Window.partitionBy(*by, "_pid").orderBy("_row", *ascending(order))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows, agg(F.when(F.col("_row") == 0, F.col("_carry")).otherwise(F.col("_value"))).over(up_to)


def with_position(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "pos") -> DataFrame:
    """0-based position of each row in ``order`` within its group (global when ``by`` is empty)."""
    rows, count = _carried(df, order, list(by or []), F.sum, F.lit(1))
    kept = [c for c in df.columns if c != name]
    return rows.withColumn(name, (count - 1).cast("bigint")).where("_row = 1").select(*kept, name)


_RUNNING = {"sum": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, value: str, order: list[str], how: str = "sum", by: list[str] | None = None,
            name: str | None = None) -> DataFrame:
    """Cumulative sum / min / max of ``value`` in ``order`` (W5, W6), per group if ``by``; NULLs are passed over."""
    name = name or f"running_{how}"
    rows, state = _carried(df, order, list(by or []), _RUNNING[how], F.col(value))
    kept = [c for c in df.columns if c != name]
    return rows.withColumn(name, state).where("_row = 1").select(*kept, name)


def range_slopes(df: DataFrame, y: str, order: list[str], by: list[str]) -> DataFrame:
    """Least-squares slope of ``y`` on the position in ``order``, per group.

    A range gives its moments about its own means, by positions that start at 0; the number of rows
    before it moves them to their place, and the moments of all ranges add up. No row is joined.
    """
    ranged = with_range(df.select(*by, y, *[c for c in order if c not in (*by, y)]), order)
    at = F.row_number().over(Window.partitionBy(*by, "_pid").orderBy(*ascending(order))).cast("double")
    y_, x_ = F.col("_y"), F.col("_x")
    parts = (ranged.select(*by, "_pid", F.col(y).cast("double").alias("_y"), at.alias("_x")).groupBy(*by, "_pid").agg(
        F.count(F.lit(1)).alias("_rows"), F.regr_count(y_, x_).alias("_n"), F.regr_avgx(y_, x_).alias("_ax"),
        F.regr_avgy(y_, x_).alias("_ay"), F.regr_sxx(y_, x_).alias("_sxx"), F.regr_sxy(y_, x_).alias("_sxy")))
    placed = parts.withColumn("_ax", F.col("_ax") + F.coalesce(F.sum("_rows").over(_before(by)), F.lit(0)))
    whole = Window.partitionBy(*by)  # the ranges of a group
    mean = lambda c: F.sum(F.col("_n") * F.col(c)).over(whole) / F.sum("_n").over(whole)
    moved = placed.withColumn("_dx", F.col("_ax") - mean("_ax")).withColumn("_dy", F.col("_ay") - mean("_ay")).groupBy(*by).agg(
        F.sum(F.expr("_sxx + _n * _dx * _dx")).alias("_sxx"), F.sum(F.expr("_sxy + _n * _dx * _dy")).alias("_sxy"))
    # ranges without a value have NULL moments, which the sums pass over
    return moved.select(*by, F.expr("try_divide(_sxy, _sxx)").alias(f"{y}_trend"))


def range_steps(df: DataFrame, y: str, order: list[str], by: list[str]) -> DataFrame:
    """Mean difference of ``y`` from each row to the next in ``order``, per group (W3); a NULL on either side gives none.

    Steps inside a range come from a window in it; a range's first and last value are kept as its
    boundary, and the step from the last row of one range to the first of the next is made of these.
    """
    ranged = with_range(df.select(*by, y, *[c for c in order if c not in (*by, y)]), order)
    inside = Window.partitionBy(*by, "_pid").orderBy(*ascending(order))
    rows = ranged.select(*by, "_pid", F.col(y).alias("_y"), (F.col(y) - F.lag(y).over(inside)).alias("_d"),
                         F.lag(F.lit(1)).over(inside).isNull().alias("_first"), F.lead(F.lit(1)).over(inside).isNull().alias("_last"))
    parts = rows.groupBy(*by, "_pid").agg(
        F.sum("_d").alias("_sum"), F.count("_d").alias("_n"),
        F.max(F.when(F.col("_first"), F.col("_y"))).alias("_from"), F.max(F.when(F.col("_last"), F.col("_y"))).alias("_to"))
    across = F.col("_from") - F.lag("_to").over(Window.partitionBy(*by).orderBy("_pid"))
    joined = parts.select(*by, "_sum", "_n", across.alias("_across"))
    grouped = joined.groupBy(*by) if by else joined.groupBy()
    total = F.coalesce(F.sum("_sum"), F.lit(0)) + F.coalesce(F.sum("_across"), F.lit(0))
    return grouped.agg(F.try_divide(total, F.sum("_n") + F.count("_across")).alias(f"{y}_mean_step"))
