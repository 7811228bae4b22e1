"""Scalar column expressions (F3-F13, F20-F24). All JVM-side, codegen friendly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perfengine.schema import AGE_EDGES, AGE_LABELS, GAUGE_EDGES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(n, d) -> Column:
    """Unguarded ratio; a zero divisor gives NULL instead of +-inf (ANSI-safe)."""
    return F.try_divide(_c(n), _c(d))


def guarded_ratio(n, d, otherwise=0.0) -> Column:
    """``n / d`` when ``d > 0`` else ``otherwise`` (a NULL divisor also falls through)."""
    other = _c(otherwise) if isinstance(otherwise, (str, Column)) else F.lit(otherwise)
    return F.when(_c(d) > 0, F.try_divide(_c(n), _c(d))).otherwise(other)


def removal_fraction(inlet, outlet) -> Column:
    """Share of particles removed, ``(in - out) / in``."""
    return F.try_divide(_c(inlet) - _c(outlet), _c(inlet))


def removal_pct(inlet, outlet) -> Column:
    """Removal efficiency in percent."""
    return removal_fraction(inlet, outlet) * 100


def scale_pct(x) -> Column:
    return _c(x) * 100


def performance_index(eff, removal, load, pressure) -> Column:
    """efficiency x removal x (1 - load) / pressure."""
    return F.try_divide(_c(eff) * _c(removal) * (1 - _c(load)), _c(pressure))


def interaction(a, b) -> Column:
    return _c(a) * _c(b)


def nonzero(x, replacement=1.0) -> Column:
    """Replace an exact 0 by ``replacement`` (divisor guard of the simplified forecast)."""
    return F.when(_c(x) == 0, F.lit(replacement)).otherwise(_c(x))


def age_band(age, edges=AGE_EDGES, labels=AGE_LABELS) -> Column:
    """Right-closed bands ``(e0, e1] ... (e_{n-1}, e_n]``; values at or below e0 give NULL."""
    a = _c(age)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (a > lo) & (a <= hi)
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr


def gauge_band(v, edges=GAUGE_EDGES) -> Column:
    """Band of a KPI on the gauge: below the first step, between steps, above."""
    x = _c(v)
    return (F.when(x < edges[0], "low").when(x < edges[1], "medium")
            .when(x.isNotNull(), "high"))


def date_label(d, fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(_c(d), fmt)


def days_between(later, earlier) -> Column:
    return F.datediff(F.to_date(_c(later)), F.to_date(_c(earlier)))


def title_label(s) -> Column:
    """``snake_case`` name to a title label (``pressure_drop_pa`` -> ``Pressure Drop Pa``)."""
    return F.initcap(F.regexp_replace(_c(s), "_", " "))
