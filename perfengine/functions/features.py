"""Feature columns: time parts (F1, F2), the feature-set variants (F25) and the
derived metric sets (F11, F26)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfengine.functions.columns import (guarded_ratio, interaction, performance_index, ratio,
                                          removal_fraction)
from perfengine.operators.clean import winsorise
from perfengine.schema import AGE, EFF, IN10, IN25, LOAD, OUT10, OUT25, PRESSURE, TS


def with_time_parts(df: DataFrame, ts: str = TS) -> DataFrame:
    """hour, day of week (Monday = 0) and month."""
    t = F.col(ts)
    return df.withColumns({"hour": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t)})


def with_weekend(df: DataFrame, ts: str = TS) -> DataFrame:
    """1 on Saturday and Sunday."""
    return df.withColumn("is_weekend", F.weekday(F.col(ts)).isin(5, 6).cast("int"))


#: what each derived feature is made from
MADE_FROM = {
    "hour": [TS], "day_of_week": [TS], "month": [TS], "is_weekend": [TS],
    "pm_ratio": [IN25, IN10], "pressure_efficiency_ratio": [EFF, PRESSURE], "pressure_efficiency": [EFF, PRESSURE],
    "load_age_ratio": [LOAD, AGE], "pressure_load_interaction": [PRESSURE, LOAD], "age_load_interaction": [AGE, LOAD],
    "pm25_removal_efficiency": [IN25, OUT25], "pm10_removal_efficiency": [IN10, OUT10],
}


def uses(feature: str, column: str, made_from: dict[str, list[str]] = MADE_FROM) -> bool:
    """Whether ``feature`` is ``column`` or is made from it, directly or through other features."""
    return feature == column or any(uses(c, column, made_from) for c in made_from.get(feature, []))


def leak_free(features: list[str], y: str, made_from: dict[str, list[str]] = MADE_FROM) -> list[str]:
    """The features a model of ``y`` may use: neither ``y`` nor anything that shares a source with it.

    A feature is dropped if it uses ``y``, or if ``y`` is itself derived and the feature is one of its sources or uses one.
    """
    sources = [y, *[c for c in [*made_from, *{s for v in made_from.values() for s in v}] if c != y and uses(y, c, made_from)]]
    return [f for f in features if not any(uses(f, c, made_from) for c in sources)]


GUARDED_CLIPPED = ["pm_ratio", "pressure_efficiency_ratio", "load_age_ratio"]


def with_features(df: DataFrame, variant: str = "guarded", ts: str = TS, accuracy: int | None = None) -> DataFrame:
    """build one of the reference's feature sets with a single ``withColumns``.

    * ``guarded``: time parts, guarded ratios clipped to their global 1 %/99 % quantiles
    * ``guarded_weekend``: the same plus ``is_weekend``
    * ``interaction``: time parts, weekend flag, interactions and unguarded ratios
    * ``removal``: unguarded ratios plus removal fractions (and the weekend flag)
    * ``simplified``: time parts plus the three unguarded ratios
    * ``plain``: time parts plus the unguarded PM ratio
    * ``basic``: the hour only
    """
    d = with_time_parts(df, ts)
    if variant in ("guarded", "guarded_weekend"):
        d = d.withColumns({
            "pm_ratio": guarded_ratio(IN25, IN10, 0.0),
            "pressure_efficiency_ratio": guarded_ratio(EFF, PRESSURE, 0.0),
            "load_age_ratio": guarded_ratio(LOAD, AGE, LOAD),
        })
        d = winsorise(d, GUARDED_CLIPPED, 0.01, 0.99, accuracy)
        return with_weekend(d, ts) if variant == "guarded_weekend" else d
    if variant == "interaction":
        d = with_weekend(d, ts)
        return d.withColumns({
            "pressure_load_interaction": interaction(PRESSURE, LOAD),
            "age_load_interaction": interaction(AGE, LOAD),
            "pm_ratio": ratio(IN25, IN10),
            "pressure_efficiency": ratio(EFF, PRESSURE),
        })
    if variant in ("removal", "simplified"):
        d = d.withColumns({
            "pm_ratio": ratio(IN25, IN10),
            "pressure_efficiency_ratio": ratio(EFF, PRESSURE),
            "load_age_ratio": ratio(LOAD, AGE),
        })
        if variant == "simplified":
            return d
        d = with_weekend(d, ts)
        return d.withColumns({"pm25_removal_efficiency": removal_fraction(IN25, OUT25),
                              "pm10_removal_efficiency": removal_fraction(IN10, OUT10)})
    if variant == "plain":
        return d.withColumn("pm_ratio", ratio(IN25, IN10))
    if variant == "basic":
        return df.withColumn("hour", F.hour(F.col(ts)))
    raise ValueError(f"unknown feature variant {variant!r}")


def with_parallel_metrics(df: DataFrame) -> DataFrame:
    """efficiency per pressure, PM removal ratio, efficiency x (1 - load)."""
    return df.withColumns({
        "efficiency_to_pressure": ratio(EFF, PRESSURE),
        "pm_removal_ratio": removal_fraction(IN25, OUT25),
        "load_efficiency": F.col(EFF) * (1 - F.col(LOAD)),
    })


def with_row_metrics(df: DataFrame) -> DataFrame:
    """Row-local part of F26 (F7-F10): ratios, removal rates, decay, performance index."""
    d = df.withColumns({
        "pressure_efficiency": ratio(EFF, PRESSURE),
        "pm25_removal_rate": removal_fraction(IN25, OUT25),
        "pm10_removal_rate": removal_fraction(IN10, OUT10),
        "load_rate": ratio(LOAD, AGE),
        "efficiency_decay": ratio(EFF, AGE),
    })
    return d.withColumns({
        "overall_pm_removal": (F.col("pm25_removal_rate") + F.col("pm10_removal_rate")) / 2,
        "performance_index": performance_index(EFF, "pm25_removal_rate", LOAD, PRESSURE),
    })
