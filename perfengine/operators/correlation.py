"""Correlation (X1-X3) and one-way ANOVA (X4), each a single aggregate pass."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfengine.operators.joins import join_small


def _pair_r(a: str, b: str):
    """Pearson r over rows where both are present (pandas' pairwise deletion).

    ``try_divide`` makes a constant column give NULL instead of an ANSI error.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def _pairwise_wide(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """All pairs with pairwise deletion (any NULLs): covariance / std per pair, one aggregate."""
    n = len(cols)
    aggs = [_pair_r(cols[i], cols[j]).alias(f"r_{i}_{j}") for i in range(n) for j in range(i + 1, n)]
    return (df.groupBy(*keys) if keys else df.groupBy()).agg(*aggs)


def _centered_wide(df: DataFrame, cols: list[str], keys: list[str], means) -> DataFrame:
    """No NULLs: two-pass form, sums of products of centred values (plain codegen'd sums)."""
    n = len(cols)
    if keys:
        d = join_small(df.select(*keys, *cols), means, keys)
        cen = {c: F.col(c) - F.col(f"_m{i}") for i, c in enumerate(cols)}
    else:
        row = means.first()
        d = df.select(*cols)
        cen = {c: F.col(c) - F.lit(row[f"_m{i}"]) for i, c in enumerate(cols)}
    aggs = [F.sum(cen[cols[i]] * cen[cols[j]]).alias(f"s_{i}_{j}") for i in range(n) for j in range(i, n)]
    sums = (d.groupBy(*keys) if keys else d.groupBy()).agg(*aggs)
    return sums.select(*keys, *[F.try_divide(F.col(f"s_{i}_{j}"), F.sqrt(F.col(f"s_{i}_{i}") * F.col(f"s_{j}_{j}")))
                                .alias(f"r_{i}_{j}") for i in range(n) for j in range(i + 1, n)])


def corr_matrix(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """Pearson matrix, long form ``(a, b, i, j, r)``, full square incl. diagonal.

    A first aggregate gives per-column counts and means. Without NULLs (the
    cleaned table) the matrix is one pass of centred cross-product sums; with
    NULLs each pair uses only rows where both are present (pandas' pairwise
    deletion). A constant column gives NULL, never an ANSI error.
    """
    n = len(cols)
    keys = [by] if by else []
    first = (df.groupBy(*keys) if keys else df.groupBy()).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_c{i}") for i, c in enumerate(cols)],
        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)]).persist()
    complete = first.where(" OR ".join(f"_c{i} != _n" for i in range(n)) or "false").count() == 0
    wide = (_centered_wide(df, cols, keys, first.select(*keys, *[f"_m{i}" for i in range(n)]))
            if complete else _pairwise_wide(df, cols, keys))
    cells = []
    for i in range(n):
        for j in range(n):
            if i == j:
                r = F.lit(1.0)
            else:
                lo, hi = min(i, j), max(i, j)
                r = F.col(f"r_{lo}_{hi}")
            cells.append(F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"),
                                  F.lit(i).alias("i"), F.lit(j).alias("j"), r.alias("r")))
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def strong_pairs(df: DataFrame, cols: list[str], threshold: float = 0.5, by: str | None = None,
                 weight: float | None = None) -> DataFrame:
    """Upper-triangle pairs with ``|r| > threshold``; optional edge weight ``|r| * weight``."""
    m = corr_matrix(df, cols, by).where((F.col("i") < F.col("j")) & (F.abs("r") > threshold))
    if weight is not None:
        m = m.withColumn("weight", F.abs("r") * weight)
    return m


def anova(df: DataFrame, by: str, y: str) -> DataFrame:
    """One-way ANOVA F statistic of ``y`` across groups, plus its p-value.

    F comes from one grouped aggregate (n, mean, var per group) reduced by a
    second tiny aggregate; only the p-value (a scalar) is evaluated on the driver.
    """
    g = df.where(F.col(y).isNotNull()).groupBy(by).agg(
        F.count(y).alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v"))
    g = g.persist()
    t = g.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"),
              (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand")).first()
    n_all, k, grand = t["N"] or 0, t["k"] or 0, t["grand"]
    res = g.agg(
        F.sum(F.col("n") * (F.col("m") - F.lit(grand)) ** 2).alias("ss_between"),
        F.sum(F.coalesce((F.col("n") - 1) * F.col("v"), F.lit(0.0))).alias("ss_within"))
    res = res.select(
        F.lit(k - 1).cast("bigint").alias("df_between"), F.lit(n_all - k).cast("bigint").alias("df_within"),
        F.try_divide(F.col("ss_between") / F.lit(float(k - 1) if k > 1 else None),
                     F.col("ss_within") / F.lit(float(n_all - k) if n_all > k else None)).alias("f_statistic"))
    row = res.first()
    g.unpersist()
    p = f_sf(row["f_statistic"], row["df_between"], row["df_within"]) if row["f_statistic"] is not None else None
    return res.withColumn("p_value", F.lit(p).cast("double"))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(20)
_PANELS = 100_000


def _mass(log_density, slope, start: float, direction: int, peak: float, width: float) -> float:
    """Integral of exp(log_density) from ``start`` to infinity in ``direction``, by Gauss-Legendre panels
    that are never wider than the density changes e-fold; ends where a panel past the peak adds nothing."""
    total, s = 0.0, start
    for _ in range(_PANELS):
        step = min(width, 1.0 / max(abs(slope(s)), 1e-300))
        part = step / 2 * float(_WEIGHTS @ np.exp(log_density(s + direction * step / 2 * (1 + _NODES))))
        total, s = total + part, s + direction * step
        if direction * (s - peak) > 0 and part <= 1e-17 * total:
            return total
    raise ArithmeticError("the F distribution's tail did not converge")


def f_sf(f: float, d1: float, d2: float) -> float | None:
    """Survival function of the F distribution.

    The share of the density above ``f`` in the total, both integrated numerically over the logarithm
    of d1 F / d2 and scaled by the density's peak: no gamma function, so nothing cancels at large ``d2``.
    """
    if f is None or d1 <= 0 or d2 <= 0:
        return None
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    a, b = d2 / 2.0, d1 / 2.0
    peak = math.log(b / a)

    def log_density(s):
        return b * (s - peak) - (a + b) * (np.log1p(np.exp(s)) - math.log1p(b / a))

    def slope(s):
        return b - (a + b) / (1.0 + math.exp(-s))

    width, at = min(1.0, math.sqrt((a + b) / (a * b))), math.log(d1 * f / d2)
    above, below = (_mass(log_density, slope, at, way, peak, width) for way in (1, -1))
    return above / (above + below)
