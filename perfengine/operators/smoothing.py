"""Local linear smoothing and kernel density from block moments.

Rows never meet a grid point one by one. They are summed once into blocks of near values (a few hundred a group,
whatever the number of rows), as sums of powers about the block's middle. A kernel that is a polynomial on a whole
block, or a short series there, is then summed over its rows from these powers alone. Only the two or three blocks
in which a grid point's window begins, ends or turns send their rows to that point.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfengine.operators.joins import BROADCAST_ROW_LIMIT
from perfengine.operators.ordering import with_count_up_to
from perfengine.operators.quantiles import quantiles
from perfengine.schema import CLASS
from perfengine.session import cut_lineage

#: blocks a group, cut at equal shares of its distinct x
BLOCKS = 256
#: a group's cuts are broadcast only while all groups' cuts are under this size
CUT_BYTES = 64 << 20
#: a kernel's series ends after this power: |offset| <= 1/4 bandwidth leaves 1.1 * 4**-13 / sqrt(13!) < 2.1e-13 of its peak
SERIES = 12
#: bandwidths beyond which a kernel is under 2e-17 of its peak and not summed
REACH = 9.0


def _group(by: list[str]):
    """The group as one value, in which null keys are equal."""
    return F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))


def _beside(big: DataFrame, small: DataFrame, on, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Join a written table to the rows; it is broadcast only up to ``limit`` rows."""
    return big.join(F.broadcast(small) if small.count() <= limit else small, on)


def _opened(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*[F.col(f"_g.{c}").alias(c) for c in by], *[c for c in df.columns if c != "_g"])


def _power(name: str, p: int) -> str:
    return "*".join([name] * p) or "1D"


# ----------------------------------------------------------------------------- density


def density(df: DataFrame, y: str, by: str | None = CLASS, points: int = 100) -> DataFrame:
    """Gaussian kernel density on ``points`` grid values from each group's min to max.

    Bandwidth ``h = std * n ** (-1/5)`` (Scott's rule in one dimension). Values are summed into cells of half a
    bandwidth as powers of their offset; a grid point adds each cell's Hermite series, so the work after one partial
    aggregate grows with the cells (range / h) and not with rows or distinct values. Against the plain sum the error
    is under 2.1e-13 of a kernel's peak (``SERIES``, ``REACH``). Nulls and NaN are left out; density is null for
    one value or equal values.
    """
    keys = [by] if by else []
    base = df.select(_group(keys).alias("_g"), F.col(y).cast("double").alias("_y")).where("_y IS NOT NULL AND NOT isnan(_y)")
    params = base.groupBy("_g").agg(F.expr("min(_y) AS _lo"), F.expr("max(_y) AS _hi"), F.expr("count(1) AS _n"),
                                    F.expr("stddev_samp(_y) * pow(CAST(count(1) AS DOUBLE), -0.2D) AS _h"))
    params = cut_lineage(params)
    last = points - 1
    cells = _beside(base, params, "_g").selectExpr("_g", "_y", "_lo", "_hi", "_h", "CAST(round(try_divide(_y - _lo, _h / 2)) AS BIGINT) AS _c")
    cells = cells.where("_c IS NOT NULL").selectExpr("_g", "_c", "_lo", "_hi", "_h", "(_y - (_lo + _c * (_h / 2))) / _h AS _v")
    sums = cells.groupBy("_g", "_c").agg(*[F.expr(f"first({c}) AS {c}") for c in ("_lo", "_hi", "_h")],
                                         *[F.expr(f"sum({_power('_v', p)}) AS m{p}") for p in range(SERIES + 1)])
    near = sums.selectExpr("*", "_lo + _c * (_h / 2) AS _mid", f"(_hi - _lo) / {last} AS _step").selectExpr(
        "*", f"explode(sequence(CAST(greatest(0, floor((_mid - {REACH}D * _h - _lo) / _step)) AS INT), "
             f"CAST(least({last}, ceil((_mid + {REACH}D * _h - _lo) / _step)) AS INT))) AS _k")
    near = near.selectExpr("*", "(_lo + _k * _step - _mid) / _h AS _a")
    # sum over p of He_p(a) m_p / p!, gathered by powers of a and nested
    by_power: dict[int, list[str]] = {}
    for p in range(SERIES + 1):
        for j in range(p // 2 + 1):
            he = (-1) ** j * math.factorial(p) / (math.factorial(j) * math.factorial(p - 2 * j) * 2**j)
            by_power.setdefault(p - 2 * j, []).append(f"{he / math.factorial(p)!r}D * m{p}")
    series = "0D"
    for i in sorted(by_power, reverse=True):
        series = f"({series}) * _a + ({' + '.join(by_power[i])})"
    added = near.selectExpr("_g", "_k", f"exp(-0.5D * _a * _a) * ({series}) AS _w").groupBy("_g", "_k").agg(F.sum("_w").alias("_s"))
    grid = params.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("_k")).join(added, ["_g", "_k"], "left")
    out = grid.selectExpr("_g", "CAST(_k AS BIGINT) AS k", f"_lo + _k * ((_hi - _lo) / {last}) AS x",
                          f"try_divide(coalesce(_s, 0D), _n * _h * {math.sqrt(2 * math.pi)!r}D) AS density")
    return _opened(out, keys)


# ----------------------------------------------------------------------------- local linear fit


def _tagged(rows: DataFrame, heads: DataFrame, blocks: int, points: int) -> DataFrame:
    """Rows with their block ``_b`` (the number of cuts up to ``_x``), its middle ``_m`` and half width ``_s``, and the grid
    point ``_i`` from which the curve runs straight past them, with the grid's ``_step``."""
    d = _beside(rows, heads.select("_g", "_lo", "_hi", "_cuts"), "_g", CUT_BYTES // (8 * (blocks + 4)))
    d = with_count_up_to(d, "_cuts", "_x", blocks - 1, "_b")
    d = d.selectExpr("*", "CASE WHEN _b = 0 THEN _lo ELSE get(_cuts, _b - 1) END AS _from", "coalesce(get(_cuts, _b), _hi) AS _to")
    d = d.selectExpr("*", f"(_hi - _lo) / {points - 1} AS _step")
    return d.selectExpr("_g", "_x", "_y", "_b", "(_from + _to) / 2 AS _m", "CASE WHEN _to > _from THEN (_to - _from) / 2 ELSE 1D END AS _s",
                        f"CAST(least({points - 2}, coalesce(floor(try_divide(_x - _lo, _step)), 0)) AS INT) AS _i", "_step")


def _sent(vals: DataFrame, pairs: DataFrame, cols: list[str]) -> DataFrame:
    """The rows of a block beside each grid point that asks for the block: a list a block, opened once joined."""
    asked = cut_lineage(pairs.groupBy("_g", "_b").agg(F.collect_list(F.struct("_k", *cols)).alias("_asks")))
    return _beside(vals, asked, ["_g", "_b"], CUT_BYTES // 4096).select("_g", "_x", "_c", "_sw", "_sy", F.explode("_asks").alias("_a")).select("_g", "_x", "_c", "_sw", "_sy", "_a.*")


def _radii(vals: DataFrame, grid: DataFrame) -> DataFrame:
    """The distance of the ``_need``-th nearest row of each grid point, exactly.

    Whole blocks counted by their nearest and farthest value bracket it; only blocks that reach into the bracket send rows.
    """
    blocks = vals.groupBy("_g", "_b").agg(F.expr("min(_x) AS _min"), F.expr("max(_x) AS _max"), F.expr("sum(_c) AS _n"))
    pairs = grid.join(blocks, "_g").selectExpr("*", "greatest(_min - _at, _at - _max, 0D) AS _near", "greatest(abs(_min - _at), abs(_max - _at)) AS _far")
    over = "OVER (PARTITION BY _g, _k ORDER BY {} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    pairs = pairs.selectExpr("*", f"sum(_n) {over.format('_near')} AS _reach", f"sum(_n) {over.format('_far')} AS _sure")
    whole = "OVER (PARTITION BY _g, _k)"
    pairs = pairs.selectExpr("*", f"min(CASE WHEN _reach >= _need THEN _near END) {whole} AS _r0", f"min(CASE WHEN _sure >= _need THEN _far END) {whole} AS _r1")
    pairs = pairs.selectExpr("*", f"sum(CASE WHEN _far < _r0 THEN _n ELSE 0 END) {whole} AS _below")
    rows = _sent(vals, pairs.where("_far >= _r0 AND _near <= _r1"), ["_at", "_need", "_below", "_r0", "_r1"])
    rows = rows.selectExpr("_g", "_k", "_need", "_below", "abs(_x - _at) AS _d", "_r0", "_r1", "_c").where("_d <= _r1")
    # rows under the bracket are counted; those in it are ranked
    rows = rows.selectExpr("_g", "_k", "_need", "_below", "CASE WHEN _d < _r0 THEN -1D ELSE _d END AS _d", "_c").groupBy("_g", "_k", "_need", "_below", "_d").agg(F.sum("_c").alias("_c"))
    rows = rows.selectExpr("*", f"_below + sum(_c) {over.format('_d')} AS _cum")
    return rows.where("_d >= 0 AND _cum >= _need").groupBy("_g", "_k").agg(F.min("_d").alias("_r"))


def _fits(vals: DataFrame, grid: DataFrame) -> DataFrame:
    """Each grid point's weighted line at the point: tricube weights in its radius, times the rows' own weights."""
    top = 11  # a weight has power 9, a moment two more
    powers = vals.selectExpr("*", "(_x - _m) / _s AS _u").groupBy("_g", "_b").agg(
        *[F.expr(f"{a} AS {n}") for a, n in (("min(_x)", "_min"), ("max(_x)", "_max"), ("first(_m)", "_m"), ("first(_s)", "_s"))],
        *[F.expr(f"sum(_sw * {_power('_u', p)}) AS w{p}") for p in range(top + 1)],
        *[F.expr(f"sum(_sy * {_power('_u', p)}) AS y{p}") for p in range(top)])
    pairs = grid.join(powers, "_g").selectExpr("*", "greatest(_min - _at, _at - _max, 0D) AS _near", "greatest(abs(_min - _at), abs(_max - _at)) AS _far")
    inside = "(_far <= _r AND (_min >= _at OR _max <= _at) AND _r > 0)"
    full = pairs.where(inside).selectExpr("*", "CASE WHEN _min >= _at THEN 1D ELSE -1D END AS _side")
    full = full.selectExpr("*", "_side * (_m - _at) / _r AS _a", "_side * _s / _r AS _q")

    def moment(kind: str, q: int) -> str:  # sum of t^q, t = a + q u the distance in radii
        return "(" + " + ".join(f"{math.comb(q, p)}D * {_power('_a', q - p)} * {_power('_q', p)} * {kind}{p}" for p in range(q + 1)) + ")"

    def tricube(kind: str, j: int) -> str:  # sum of (1 - t^3)^3 t^j
        return f"{moment(kind, j)} - 3D * {moment(kind, j + 3)} + 3D * {moment(kind, j + 6)} - {moment(kind, j + 9)}"

    whole = full.selectExpr("_g", "_k", f"{tricube('w', 0)} AS s0", f"_side * ({tricube('w', 1)}) AS s1", f"{tricube('w', 2)} AS s2",
                            f"{tricube('y', 0)} AS t0", f"_side * ({tricube('y', 1)}) AS t1")
    rows = _sent(vals, pairs.where(f"NOT {inside} AND (_near < _r OR _near = 0)"), ["_at", "_r"])
    rows = rows.selectExpr("*", "CASE WHEN _x = _at THEN 0D ELSE try_divide(_x - _at, _r) END AS _z").where("abs(_z) < 1")
    rows = rows.selectExpr("*", "pow(1 - pow(abs(_z), 3), 3) AS _w")
    parts = rows.selectExpr("_g", "_k", "_w * _sw AS s0", "_w * _sw * _z AS s1", "_w * _sw * _z * _z AS s2", "_w * _sy AS t0", "_w * _sy * _z AS t1")
    s = whole.unionByName(parts).groupBy("_g", "_k").agg(*[F.sum(c).alias(c) for c in ("s0", "s1", "s2", "t0", "t1")])
    s = grid.join(s, ["_g", "_k"], "left").selectExpr("*", "s0 * s2 - s1 * s1 AS _den")
    s = s.selectExpr("*", "CASE WHEN _den * _r * _r > 1e-12D * s0 * s0 THEN try_divide(s0 * t1 - s1 * t0, _den) ELSE 0D END AS _slope")
    return s.selectExpr("_g", "_k", "_at", "_r", "try_divide(t0 - _slope * s1, s0) AS _fit")


def _robust(rows: DataFrame, fits: DataFrame, points: int) -> DataFrame:
    """Rows with bisquare weights of their residuals from the fitted points, joined by straight lines between these."""
    # a row a stretch: with the whole curve beside each row, the quantiles' filter would search it once for every use of the residual
    line = fits.selectExpr("_g", "_k AS _i", "_at", "_fit AS _f0", "lead(_fit) OVER (PARTITION BY _g ORDER BY _k) AS _f1")
    d = _beside(rows, cut_lineage(line.where(f"_i <= {points - 2}")), ["_g", "_i"])
    d = d.selectExpr(*rows.columns, "abs(_y - (_f0 + (_f1 - _f0) * coalesce(try_divide(_x - _at, _step), 0D))) AS _res")
    middle = quantiles(d, "_res", [0.5], ["_g"]).withColumnRenamed("q0", "_mid")
    d = _beside(d, middle, "_g")
    d = d.selectExpr(*rows.columns, "CASE WHEN _mid > 0 THEN _res / (6 * _mid) WHEN _res > 0 THEN 1D ELSE 0D END AS _e")
    return d.selectExpr(*rows.columns, "CASE WHEN _e >= 0.999D THEN 0D WHEN _e <= 0.001D THEN 1D ELSE pow(1 - _e * _e, 2) END AS _w")


def local_fit(df: DataFrame, x: str, y: str, by: str | None = CLASS, frac: float = 2.0 / 3.0, points: int = 100,
              robust: int = 0, blocks: int = BLOCKS) -> DataFrame:
    """X11: locally weighted linear fit ("lowess" trend line) on ``points`` grid values per group.

    A grid value g has the radius of its int(frac * n)-th nearest row; rows inside weigh ``(1 - (|x - g| / radius)^3)^3``
    and the weighted least-squares line is evaluated at g. ``robust`` more passes weigh rows by the bisquare of their
    residual over six times the group's median absolute residual, the curve between grid points being straight.

    The weight is a polynomial on either side of g, so whole blocks enter by their powers (relative rounding about
    1e-12); a row reaches only grid points whose window has an end or its middle in the row's block. Each pass is one
    aggregate of the rows. Rows with a null or NaN are left out; all weights zero give null; a radius of zero fits
    the mean of the rows at g.
    """
    keys = [by] if by else []
    base = df.select(_group(keys).alias("_g"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    base = base.where("_x IS NOT NULL AND _y IS NOT NULL AND NOT isnan(_x) AND NOT isnan(_y)")
    shares = ", ".join(f"{i / blocks!r}D" for i in range(1, blocks))
    heads = base.groupBy("_g", "_x").agg(F.expr("count(1) AS _c")).groupBy("_g").agg(
        F.expr("min(_x) AS _lo"), F.expr("max(_x) AS _hi"), F.expr("sum(_c) AS _n"),
        F.expr(f"array_distinct(percentile_approx(_x, array({shares}), {16 * blocks})) AS _cuts"))
    heads = cut_lineage(heads)
    rows = _tagged(base, heads, blocks, points)
    grid = heads.selectExpr("_g", f"CAST(floor(_n * {frac!r}D + 1e-10D) AS BIGINT) AS _need", "_lo", "_hi", f"explode(sequence(0, {points - 1})) AS _k")
    grid = grid.selectExpr("_g", "_k", "_need", f"CASE WHEN _k = {points - 1} THEN _hi ELSE _lo + _k * ((_hi - _lo) / {points - 1}) END AS _at")
    fits, weighted = None, rows.selectExpr("*", "1D AS _w")
    for turn in range(robust + 1):
        if turn:
            weighted = _robust(rows, fits, points)
        vals = weighted.groupBy("_g", "_x", "_b", "_m", "_s").agg(F.expr("count(1) AS _c"), F.expr("sum(_w) AS _sw"), F.expr("sum(_w * _y) AS _sy")).persist()
        if not turn:
            grid = cut_lineage(grid.join(_radii(vals, grid), ["_g", "_k"]).select(*grid.columns, "_r"))
        fits = cut_lineage(_fits(vals, grid))
        vals.unpersist()
    return _opened(fits.selectExpr("_g", "CAST(_k AS BIGINT) AS k", "_at AS x", "_fit AS fitted"), keys)
