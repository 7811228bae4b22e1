"""Scaling and banding (F14-F19). Global parameters come from ONE aggregate job
(a handful of doubles) and enter the projection as literals: no join, no window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfengine.operators.joins import join_small
from perfengine.operators.ordering import with_position
from perfengine.operators.quantiles import global_quantiles
from perfengine.schema import CLASS, QUARTILE_LABELS


def minmax_scale(df: DataFrame, cols: list[str], suffix: str = "_normalized") -> DataFrame:
    """``(x - min) / (max - min)`` over the whole table; a constant column gives NULL."""
    row = df.agg(*[F.min(c).alias(f"{c}__min") for c in cols], *[F.max(c).alias(f"{c}__max") for c in cols]).first()
    out = {}
    for c in cols:
        lo, hi = row[f"{c}__min"], row[f"{c}__max"]
        out[c + suffix] = F.try_divide(F.col(c) - F.lit(lo), F.lit(hi) - F.lit(lo)) if lo is not None else F.lit(None)
    return df.withColumns(out)


def standard_scale(df: DataFrame, cols: list[str], suffix: str = "", ddof: int = 0) -> DataFrame:
    """centre and divide by the population std (``ddof=0``, as scikit-learn); std 0 -> 1."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = df.agg(*[F.avg(c).alias(f"{c}__m") for c in cols], *[sd(c).alias(f"{c}__s") for c in cols]).first()
    out = {}
    for c in cols:
        m, s = row[f"{c}__m"], row[f"{c}__s"]
        s = 1.0 if not s else s
        out[c + suffix] = (F.col(c) - F.lit(m)) / F.lit(s)
    return df.withColumns(out)


def robust_scale(df: DataFrame, cols: list[str], suffix: str = "", accuracy: int | None = None) -> DataFrame:
    """``(x - median) / (q75 - q25)`` with exact quantiles; a zero IQR scales by 1."""
    q = global_quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols}, accuracy)
    out = {}
    for c in cols:
        q1, med, q3 = q[c]
        scale = (q3 - q1) if q1 is not None and q3 != q1 else 1.0
        out[c + suffix] = (F.col(c) - F.lit(med)) / F.lit(scale)
    return df.withColumns(out)


def quartile_band(df: DataFrame, y: str, name: str | None = None, labels: list[str] = QUARTILE_LABELS,
                  accuracy: int | None = None) -> DataFrame:
    """quartile bands over the whole table, right-closed, lowest value in the first band.

    Equal values always share a band (unlike ``ntile``).
    """
    q1, q2, q3 = global_quantiles(df, {y: [0.25, 0.5, 0.75]}, accuracy)[y]
    x = F.col(y)
    band = (F.when(x.isNull(), F.lit(None)).when(x <= q1, labels[0]).when(x <= q2, labels[1])
            .when(x <= q3, labels[2]).otherwise(labels[3]))
    return df.withColumn(name or f"{y}_category", band)


def category_codes(df: DataFrame, by: str = CLASS, order: list[str] | None = None) -> DataFrame:
    """F16 code table: 0-based code per class, by first appearance in ``order`` or alphabetically.

    The class table is an aggregate (one row per class); the code is its
    position, computed with the distributed position primitive.
    """
    if order:
        firsts = df.groupBy(by).agg(F.min(F.struct(*order)).alias("_first"))
        return with_position(firsts, ["_first"], name="code").select(by, "code")
    return with_position(df.select(by).distinct(), [by], name="code").select(by, "code")


def with_category_code(df: DataFrame, by: str = CLASS, order: list[str] | None = None,
                       name: str = "color_value") -> DataFrame:
    """F16: attach the class code to every row (size-checked broadcast of the code table)."""
    return join_small(df, category_codes(df, by, order).withColumnRenamed("code", name), by)
