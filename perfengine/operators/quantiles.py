"""Quantiles: exact (linear interpolation, as pandas / DuckDB ``quantile_cont``) or sketched.

Exact quantiles are one selection for all groups, columns and probabilities at once:

1. one aggregate gives each group's count, extremes and a fixed-size ``percentile_approx`` sketch; every
   probability becomes a target (rank, bracket [lo, hi]), a row of a small DataFrame;
2. a round joins the values with their group's targets and counts them in ``BUCKETS`` buckets across the
   bracket, one more below and one above it. A running count over a target's buckets (a bounded number
   of rows) finds the bucket of the rank. Its smallest and largest value are the next bracket, unless they
   or the next bucket already give the wanted order statistics.

The sketch only speeds this up: a rank outside of its bracket lies in the bucket below or above. Both ends
of a bracket fall into different buckets, so it shrinks every round; two rounds are usual. The
rounds do not depend on the number of groups, no value histogram is read, and the targets stay a DataFrame,
kept in memory (a row each) until the result is checkpointed.
``accuracy`` switches to the one-pass sketch instead.

One column of a whole table (``exact_quantiles``) needs no DataFrame of targets: its few brackets stand in the
plan as literals, a round is one aggregate without a join, and its buckets (a bounded number) go to the driver.
"""

from __future__ import annotations

import re
from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfengine.session import cut_lineage

ACCURACY = 2_000
BUCKETS = 4_096
#: Targets (of about 100 bytes) up to this many are broadcast to the values; beyond it the join shuffles.
BROADCAST_TARGETS = 50_000


def quantile_expr(col: str, probs, accuracy: int | None = None) -> Column:
    c = F.col(col).cast("double")
    if accuracy:
        return F.percentile_approx(c, probs, accuracy)
    return F.percentile(c, probs)


def quantiles(df: DataFrame, col: str, probs: list[float], by: list[str] | None = None,
              accuracy: int | None = None, prefix: str = "q") -> DataFrame:
    """One row per group with one column per probability (``q0``, ``q1`` ...); without ``by`` one row.

    Exact by default (the selection above); ``accuracy`` gives the sketch.
    """
    keys, probs = list(by or []), list(probs)
    if accuracy:
        agg = (df.groupBy(*keys) if keys else df.groupBy()).agg(quantile_expr(col, probs, accuracy).alias("_q"))
        return agg.select(*keys, *[F.col("_q")[i].alias(f"{prefix}{i}") for i in range(len(probs))])
    out, kept = _selected(df.select(*keys, F.col(col).cast("double").alias("_v")), keys, probs, prefix)
    out = cut_lineage(out)
    _freed(kept)
    return out


def _bucket(finer: bool) -> str:
    """SQL of a value's bucket: -1 below the bracket, 0 ... BUCKETS inside, BUCKETS + 1 above; ``_lo`` and ``_hi`` never share one.

    Buckets have equal widths; ``finer``, for the third round on, gives them equal ratios where the bracket
    spans some binades, so that values of any spread are told apart in a few more rounds.
    """
    inside = linear = f"floor((_v / 2 - _lo / 2) / (_hi / 2 - _lo / 2) * {BUCKETS})"
    if finer:
        def ratio(a, b):
            return f"floor((ln(abs(_v)) - ln(abs({a}))) / (ln(abs({b})) - ln(abs({a}))) * {BUCKETS})"
        wide = "abs(ln(abs(_hi)) - ln(abs(_lo))) > 3"
        inside = f"""CASE WHEN _lo < 0 AND _hi > 0 THEN signum(_v) + 1 WHEN _lo = 0 THEN int(_v > 0) WHEN _hi = 0 THEN int(_v = 0)
                     WHEN _lo > 0 AND {wide} THEN {ratio('_lo', '_hi')} WHEN {wide} THEN {BUCKETS} - {ratio('_hi', '_lo')} ELSE {linear} END"""
    infinite = "double('Infinity')"
    return f"""int(CASE WHEN _v < _lo THEN -1 WHEN _v > _hi THEN {BUCKETS + 1} WHEN _v = _lo THEN 0
                    WHEN _hi = {infinite} THEN int(_v = _hi) WHEN _lo = -{infinite} THEN 1
                    WHEN _v = _hi THEN {BUCKETS} ELSE greatest(0, least({BUCKETS}, {inside})) END)"""


def _targets(vals: DataFrame, probs: list[float]) -> DataFrame:
    """(_g, _i, _p, _lo, _hi): each group's probabilities and the brackets of their ranks."""
    d = 3.0 / ACCURACY
    at = [min(1.0, max(0.0, p + s)) for p in probs for s in (-d, d)]
    heads = vals.groupBy("_g").agg(F.percentile_approx("_v", at, ACCURACY).alias("_a"))
    rows = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(float(p)).alias("_p"), F.col("_a")[2 * i].alias("_lo"), F.col("_a")[2 * i + 1].alias("_hi"))
                     for i, p in enumerate(probs)])
    return heads.select("_g", F.explode(rows).alias("_t")).select("_g", "_t.*")


def _narrowed(vals: DataFrame, targets: DataFrame, finer: bool) -> DataFrame:
    """The targets after a round, with the order statistics ``_x`` and ``_y`` where they are found."""
    counts = vals.join(targets, "_g").groupBy("_g", "_i", "_p", F.expr(_bucket(finer)).alias("_b")).agg(
        F.expr("count(1) AS _c"), F.expr("min(_v) AS _min"), F.expr("max(_v) AS _max"))
    here = counts.selectExpr("*", "sum(_c) OVER (PARTITION BY _g, _i ORDER BY _b) AS _end", "lead(_min) OVER (PARTITION BY _g, _i ORDER BY _b) AS _next",
                             "(sum(_c) OVER (PARTITION BY _g, _i) - 1) * _p AS _place")
    here = here.selectExpr("*", "floor(_place) AS _rank", "_place - floor(_place) AS _frac").where("_rank < _end AND _rank >= _end - _c")
    x = "CASE WHEN _min = _max OR _rank = _end - 1 THEN _max WHEN _frac = 0 AND _rank = _end - _c THEN _min END"
    y = f"CASE WHEN _frac = 0 THEN {x} WHEN _rank = _end - 1 THEN _next WHEN _min = _max THEN _max END"
    return here.selectExpr("_g", "_i", "_p", "_frac", "_min AS _lo", "_max AS _hi", f"{x} AS _x", f"{y} AS _y")


def _grouped(vals: DataFrame, keys: list[str]) -> DataFrame:
    """(_g, _v): the group as one value, in which null keys are equal too; without nulls and NaN."""
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    return vals.select(group.alias("_g"), "_v").where(F.col("_v").isNotNull() & ~F.isnan("_v"))


def _selected(vals: DataFrame, keys: list[str], probs: list[float], prefix: str) -> tuple[DataFrame, list[DataFrame]]:
    """Quantiles of ``_v`` by ``keys``, and what to unpersist once they are read."""
    names = [f"{prefix}{i}" for i in range(len(probs))]
    vals = _grouped(vals, keys)
    targets = _targets(vals, probs).persist()
    kept, found, left, n = [targets], [], targets.count(), 0
    out = targets.select("_g", *[F.lit(None).cast("double").alias(c) for c in names]).limit(0)
    while left:
        done = _narrowed(vals, F.broadcast(targets) if left <= BROADCAST_TARGETS else targets, n >= 2).persist()
        kept.append(done)
        found.append(done.where(F.col("_y").isNotNull()))
        targets = done.where(F.col("_y").isNull()).select("_g", "_i", "_p", "_lo", "_hi")
        left, n = targets.count(), n + 1
    if found:
        # the interpolation that Spark's percentile and DuckDB use
        value = F.when(F.col("_frac") == 0, F.col("_x")).otherwise((1 - F.col("_frac")) * F.col("_x") + F.col("_frac") * F.col("_y"))
        out = reduce(DataFrame.unionByName, found).groupBy("_g").agg(*[F.max(F.when(F.col("_i") == i, value)).alias(c) for i, c in enumerate(names)])
    return (out.select("_g.*", *names) if keys else out.groupBy().agg(*[F.max(c).alias(c) for c in names])), kept


def _freed(tables: list[DataFrame]) -> None:
    for table in tables:
        table.unpersist()


def first_brackets(df: DataFrame, cols: list[str], probs: list[float], slack: float = 0.0) -> dict[str, list[tuple[float, float]]]:
    """Brackets of the probabilities of every column from one aggregate, to start ``exact_quantiles``. ``slack``: how far
    (as a share of the rows) the rank may move in the part of the rows that is asked for."""
    d = 3.0 / ACCURACY + slack
    at = [min(1.0, max(0.0, p + s)) for p in probs for s in (-d, d)]
    v = [F.col(c).cast("double") for c in cols]
    row = df.agg(*[F.percentile_approx(F.when(~F.isnan(x), x), at, ACCURACY) for x in v]).first()
    return {c: [(a[2 * i], a[2 * i + 1]) for i in range(len(probs))] for c, a in zip(cols, row) if a}


def global_quantiles(df: DataFrame, spec: dict[str, list[float]], accuracy: int | None = None) -> dict[str, list]:
    """Quantiles of several columns over the whole table, all in one selection; a row a column to the driver.

    Exact by default; ``accuracy`` gives the one-pass sketch instead.
    """
    probs = sorted({p for ps in spec.values() for p in ps})
    if accuracy:
        rows = column_quantiles(df, list(spec), probs, None, accuracy).collect()
    else:
        out, kept = _selected(_long(df, list(spec), []), ["column"], probs, "q")
        rows = out.collect()
        _freed(kept)
    at = {r["column"]: dict(zip(probs, list(r)[1:])) for r in rows}
    return {c: [at.get(c, {}).get(p) for p in ps] for c, ps in spec.items()}


def _bucket_between(lo: float, hi: float, finer: bool) -> str:
    ends = {"_lo": f"double('{lo!r}')", "_hi": f"double('{hi!r}')"}
    return re.sub(r"\b_(?:lo|hi)\b", lambda m: ends[m[0]], _bucket(finer))


def _order_statistics(buckets: list[tuple], p: float) -> tuple[float | None, float | None, float, tuple[float, float]]:
    """(x, y, share of y, next bracket) from (bucket, count, smallest, largest), as in ``_narrowed``; y is None if they are not found."""
    place = (sum(b[1] for b in buckets) - 1) * p
    rank, end = floor(place), 0
    frac = place - rank
    for k, (_, n, least, most) in enumerate(buckets):
        end += n
        if rank < end:
            break
    x = most if least == most or rank == end - 1 else least if rank == end - n and (frac == 0 or n == 2) else None
    y = x if frac == 0 else buckets[k + 1][2] if rank == end - 1 else most if least == most or (x is not None and n == 2) else None
    return x, y, frac, (least, most)


def exact_quantiles(df: DataFrame, col: str, probs: list[float], brackets: list[tuple[float, float]] | None = None) -> list[float | None]:
    """Exact linearly interpolated quantiles of a column over the whole table; ``brackets`` (one a probability) only say where to begin."""
    vals = df.select(F.col(col).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    brackets = brackets or first_brackets(vals, ["_v"], probs).get("_v")
    if not brackets:
        return [None] * len(probs)
    out, left, rounds = [None] * len(probs), dict(enumerate(brackets)), 0
    while left:
        # buckets are stretches of the values, so rows of equal buckets for all targets are as few as the buckets
        names = [f"_b{i}" for i in left]
        at = [F.expr(_bucket_between(lo, hi, rounds >= 2)).alias(n) for n, (lo, hi) in zip(names, left.values())]
        cells = vals.select("_v", *at).groupBy(*names).agg(F.expr("count(1) AS _c"), F.expr("min(_v) AS _min"), F.expr("max(_v) AS _max")).collect()
        if not cells:
            return out
        for k, i in enumerate(list(left)):
            buckets: dict = {}
            for r in cells:
                _, c, least, most = buckets.get(r[k], (0, 0, r["_min"], r["_max"]))
                buckets[r[k]] = (r[k], c + r["_c"], min(least, r["_min"]), max(most, r["_max"]))
            x, y, frac, left[i] = _order_statistics([buckets[b] for b in sorted(buckets)], probs[i])
            if y is not None:
                # the interpolation that Spark's percentile and DuckDB use
                out[i] = x if frac == 0 else (1 - frac) * x + frac * y
                del left[i]
        rounds += 1
    return out


def _long(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keys, cols, "column", "_v")


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float], by: list[str] | None = None,
                     accuracy: int | None = None) -> DataFrame:
    """Quantiles of several columns at once, long form ``(by..., column, q0, q1, ...)``.

    The columns are unpivoted into (group, column, value) so all of them share
    the same selection.
    """
    keys = list(by or [])
    return quantiles(_long(df, cols, keys), "_v", probs, [*keys, "column"], accuracy)
