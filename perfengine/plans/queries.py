"""Registered queries: one per operator of the inventory, each over the driver tables.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLE[name]`` is the
same question restated in SQL for DuckDB. Output doubles are rounded to 6
decimals on both sides and integer columns widened to BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfengine.functions import columns as C
from perfengine.functions.features import with_time_parts
from perfengine.operators import aggregates as A
from perfengine.operators import clean as P
from perfengine.operators import scaling as S
from perfengine.operators.joins import compare_classes, compare_tables
from perfengine.plans import inputs as I
from perfengine.plans.class_report import class_report
from perfengine.plans.oracle import R, with_clean, with_raw
from perfengine.schema import AGE, CLASS, EFF, IN10, IN25, LOAD, NUMERIC_COLS, OUT10, OUT25, PRESSURE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

EV_ORDER = ["ts", "event_id"]


def register(name: str, sql: str | None = None, digits: int = 6):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir, _f=fn: I.normalize(_f(spark, sf_dir), digits)
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _cols_sql(cols, alias_prefix=""):
    return ", ".join(R(f"{alias_prefix}{c}", c) for c in cols)


COST_VALUES = ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in I.DRIVER_COSTS.items())
COST_CTE = f", costs(filter_class, cost) AS (VALUES {COST_VALUES})"

# ----------------------------------------------------------------------------- sources / cleaning


@register("readings_view", with_raw(f"SELECT filter_class, location, timestamp, {_cols_sql(NUMERIC_COLS)} FROM raw"))
def q_readings_view(spark, d):
    return I.readings(spark, d)


@register("clean_rows", with_clean(f"SELECT filter_class, location, timestamp, {_cols_sql(NUMERIC_COLS)} FROM clean"))
def q_clean_rows(spark, d):
    return I.cleaned(spark, d)


@register("cleaning_summary", with_clean(
    "SELECT (SELECT count(*) FROM raw) AS rows_original, (SELECT count(*) FROM clean) AS rows_cleaned, "
    "(SELECT count(*) FROM raw) - (SELECT count(*) FROM clean) AS rows_removed, CAST(11 AS BIGINT) AS columns"))
def q_cleaning_summary(spark, d):
    return P.cleaning_summary(I.readings(spark, d), I.cleaned(spark, d))


_DESCRIBE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count({c}) AS DOUBLE) AS count, {R(f'avg({c})', 'mean')}, "
    f"{R(f'stddev_samp({c})', 'std')}, {R(f'min({c})', 'min')}, {R(f'quantile_cont({c}, 0.25)', 'p25')}, "
    f"{R(f'quantile_cont({c}, 0.5)', 'p50')}, {R(f'quantile_cont({c}, 0.75)', 'p75')}, {R(f'max({c})', 'max')} "
    f"FROM clean" for c in NUMERIC_COLS)


@register("describe_clean", with_clean(_DESCRIBE_SQL))
def q_describe(spark, d):
    return P.describe_exact(I.cleaned(spark, d), NUMERIC_COLS)


_PROFILE_COLS = [("filter_class", "string"), ("location", "string"), ("timestamp", "timestamp_ntz")] + \
    [(c, "double") for c in NUMERIC_COLS]


@register("profile_raw", with_raw(" UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column, '{t}' AS dtype, count({c}) AS non_null FROM raw"
    for i, (c, t) in enumerate(_PROFILE_COLS))))
def q_profile(spark, d):
    return P.profile(I.readings(spark, d))


@register("compare_raw_clean", with_clean(
    "SELECT filter_class, " + ", ".join(
        f"{R(f'avg(CASE WHEN t = {chr(39)}{tag}{chr(39)} THEN {c} END)', f'{c}_mean_{tag}')}, "
        f"{R(f'stddev_samp(CASE WHEN t = {chr(39)}{tag}{chr(39)} THEN {c} END)', f'{c}_std_{tag}')}"
        for tag in ("raw", "clean") for c in NUMERIC_COLS) +
    " FROM (SELECT *, 'raw' AS t FROM raw UNION ALL SELECT *, 'clean' AS t FROM clean) GROUP BY filter_class"))
def q_compare_raw_clean(spark, d):
    return compare_tables(I.readings(spark, d), I.cleaned(spark, d), NUMERIC_COLS, CLASS)


@register("one_class_rows", with_clean(
    f"SELECT filter_class, timestamp, {_cols_sql([AGE, EFF, PRESSURE])} FROM clean WHERE filter_class = 'PROMO'"))
def q_one_class(spark, d):
    return I.cleaned(spark, d).where(F.col(CLASS) == "PROMO").select(CLASS, "timestamp", AGE, EFF, PRESSURE)


@register("selected_classes", with_clean(
    f"SELECT filter_class, count(*) AS n, {R('avg(efficiency)', 'efficiency_mean')} FROM clean "
    "WHERE filter_class IN ('ECONOMY', 'SMALL') GROUP BY filter_class"))
def q_selected(spark, d):
    return (P.select_classes(I.cleaned(spark, d), ["ECONOMY", "SMALL"]).groupBy(CLASS)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(EFF).alias("efficiency_mean")))


@register("numeric_profile", with_clean(" UNION ALL ".join(
    f"SELECT '{c}' AS column, {R(f'avg({c})', 'mean')} FROM clean" for c in NUMERIC_COLS)))
def q_numeric_profile(spark, d):
    df = I.cleaned(spark, d)
    cols = P.numeric_columns(df)
    return df.agg(*[F.avg(c).alias(c) for c in cols]).unpivot([], cols, "column", "mean")


# ----------------------------------------------------------------------------- aggregates

def _rm_sql(inlet, outlet):
    return f"(({inlet} - {outlet}) / {inlet} * 100)"


@register("performance_stats", with_clean(
    "SELECT filter_class, "
    f"{R('round(avg(efficiency), 2)', 'efficiency_mean')}, {R('round(stddev_samp(efficiency), 2)', 'efficiency_std')}, "
    f"{R('round(avg(pressure_drop_pa), 2)', 'pressure_drop_pa_mean')}, "
    f"{R('round(stddev_samp(pressure_drop_pa), 2)', 'pressure_drop_pa_std')}, "
    f"{R(f'round(avg({_rm_sql(IN25, OUT25)}), 2)', 'pm25_removal_efficiency_mean')}, "
    f"{R(f'round(avg({_rm_sql(IN10, OUT10)}), 2)', 'pm10_removal_efficiency_mean')}, "
    f"{R('round(avg(filter_age_days), 2)', 'filter_age_days_mean')} FROM clean GROUP BY filter_class"))
def q_performance_stats(spark, d):
    return A.performance_stats(I.cleaned(spark, d))


def _adv_sql():
    parts = []
    for c, names in [(EFF, ["mean", "std", "min", "max"]), (PRESSURE, ["mean", "std", "min", "max"]),
                     ("performance_ratio", ["mean", "std"]), (AGE, ["mean", "std"])]:
        for s in names:
            fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}[s]
            parts.append(R(f"round({fn}({c}), 3)", f"{c}_{s}"))
    return ("SELECT filter_class, " + ", ".join(parts) +
            " FROM (SELECT *, efficiency / pressure_drop_pa AS performance_ratio FROM clean) GROUP BY filter_class")


@register("advanced_stats", with_clean(_adv_sql()))
def q_advanced_stats(spark, d):
    return A.advanced_stats(I.cleaned(spark, d))


@register("class_mean", with_clean(
    f"SELECT filter_class, {R('round(avg(efficiency), 3)', 'efficiency_mean')} FROM clean GROUP BY filter_class"))
def q_class_mean(spark, d):
    return A.class_stats(I.cleaned(spark, d), {EFF: ["mean"]}, CLASS, 3)


@register("removal_mean_of_ratios", with_clean(
    f"SELECT filter_class, {R(f'avg({_rm_sql(IN25, OUT25)})', 'pm25_removal')}, "
    f"{R(f'avg({_rm_sql(IN10, OUT10)})', 'pm10_removal')} FROM clean GROUP BY filter_class"))
def q_removal_mor(spark, d):
    return A.removal_mean_of_ratios(I.cleaned(spark, d))


@register("removal_ratio_of_means", with_clean(
    f"SELECT filter_class, {R('avg(inlet_pm25 - outlet_pm25) / avg(inlet_pm25) * 100', 'pm25_removal')}, "
    f"{R('avg(inlet_pm10 - outlet_pm10) / avg(inlet_pm10) * 100', 'pm10_removal')} FROM clean GROUP BY filter_class"))
def q_removal_rom(spark, d):
    return A.removal_ratio_of_means(I.cleaned(spark, d))


@register("efficiency_days", with_clean(
    f"SELECT filter_class, {R('sum(m)', 'efficiency_days')}, {R('avg(m)', 'mean_daily_efficiency')} FROM "
    "(SELECT filter_class, filter_age_days, avg(efficiency) AS m FROM clean GROUP BY 1, 2) GROUP BY filter_class"))
def q_efficiency_days(spark, d):
    return A.efficiency_days(I.cleaned(spark, d))


@register("monthly_pivot", with_clean(
    "SELECT filter_class, " + ", ".join(
        R(f"avg(CASE WHEN month(timestamp) = {m} THEN efficiency END)", f'"{m}"') for m in range(1, 13)) +
    " FROM clean GROUP BY filter_class"))
def q_monthly_pivot(spark, d):
    df = with_time_parts(I.cleaned(spark, d))
    return A.pivot_mean(df, CLASS, "month", EFF, list(range(1, 13)))


_EV_TYPES = ["click", "error", "purchase", "signup", "view"]


@register("hourly_pivot", "SELECT CAST(hour(ts) AS BIGINT) AS hour, " + ", ".join(
    R(f"avg(CASE WHEN event_type = '{t}' THEN value END)", t) for t in _EV_TYPES) + " FROM events GROUP BY 1")
def q_hourly_pivot(spark, d):
    ev = with_time_parts(I.event_rows(spark, d), "ts")
    return A.pivot_mean(ev, "hour", "event_type", "value", _EV_TYPES)


@register("degradation_trend", with_clean(
    f"SELECT filter_class, {R('regr_slope(efficiency, filter_age_days)', 'slope')}, "
    f"{R('regr_intercept(efficiency, filter_age_days)', 'intercept')}, "
    f"{R('regr_slope(efficiency, filter_age_days) * 100', 'slope_pct')} FROM clean GROUP BY filter_class"))
def q_trend(spark, d):
    return A.trend(I.cleaned(spark, d))


_REPL_SQL = with_clean(
    f"SELECT s.filter_class, {R('max_efficiency', 'max_efficiency')}, {R('threshold', 'threshold')}, "
    f"{R('coalesce(first_below, max_age)', 'replacement_age')} FROM "
    "(SELECT filter_class, max(efficiency) AS max_efficiency, max(filter_age_days) AS max_age, "
    " max(efficiency) * 0.95 AS threshold FROM clean GROUP BY 1) s LEFT JOIN "
    "(SELECT c.filter_class, min(CASE WHEN c.efficiency < t.thr THEN c.filter_age_days END) AS first_below FROM clean c "
    " JOIN (SELECT filter_class, max(efficiency) * 0.95 AS thr FROM clean GROUP BY 1) t USING (filter_class) GROUP BY 1) b "
    "USING (filter_class)")


@register("replacement_age", _REPL_SQL)
def q_replacement(spark, d):
    return A.replacement_age(I.cleaned(spark, d))


@register("cost_per_daily_efficiency", with_clean(
    f"SELECT r.filter_class, {R('cost', 'cost')}, {R('ed', 'efficiency_days')}, "
    f"{R('cost / rep', 'cost_per_day')}, {R('cost / rep / mde', 'cost_per_efficiency')} FROM "
    "(SELECT c.filter_class, coalesce(min(CASE WHEN c.efficiency < t.thr THEN c.filter_age_days END), max(c.filter_age_days)) AS rep "
    " FROM clean c JOIN (SELECT filter_class, max(efficiency) * 0.95 AS thr FROM clean GROUP BY 1) t USING (filter_class) GROUP BY 1) r "
    "JOIN (SELECT filter_class, sum(m) AS ed, avg(m) AS mde FROM (SELECT filter_class, filter_age_days, avg(efficiency) AS m "
    " FROM clean GROUP BY 1, 2) GROUP BY 1) e USING (filter_class) LEFT JOIN costs USING (filter_class)", COST_CTE))
def q_cost_daily(spark, d):
    df = I.cleaned(spark, d)
    rep = A.replacement_age(df).select(CLASS, F.col("replacement_age").alias("optimal_replacement_age"))
    days = A.efficiency_days(df)
    out = A.cost_effectiveness(rep.join(days, CLASS), I.costs(spark), CLASS, eff_col="mean_daily_efficiency")
    return out.select(CLASS, "cost", "efficiency_days", "cost_per_day", "cost_per_efficiency")


@register("performance_patterns", with_clean(
    f"SELECT filter_class, {R('avg(efficiency)', 'avg_efficiency')}, {R('stddev_samp(efficiency)', 'std_efficiency')}, "
    f"{R('avg(pressure_drop_pa)', 'avg_pressure_drop')}, "
    f"{R('avg(inlet_pm25 - outlet_pm25) / avg(inlet_pm25) * 100', 'pm25_removal')}, "
    f"{R('avg(inlet_pm10 - outlet_pm10) / avg(inlet_pm10) * 100', 'pm10_removal')} FROM clean GROUP BY filter_class"))
def q_patterns(spark, d):
    return A.performance_patterns(I.cleaned(spark, d))


CLASS_REPORT_SQL = with_clean(
    "SELECT st.filter_class, " + ", ".join([
        R("decline_rate", "decline_rate"), R("coalesce(first_below, max_age)", "optimal_replacement_age"),
        R("max_efficiency", "max_efficiency"), R("threshold", "threshold"), R("avg_efficiency", "avg_efficiency"),
        R("std_efficiency", "std_efficiency"), R("avg_pressure_drop", "avg_pressure_drop"),
        R("pm25_removal", "pm25_removal"), R("pm10_removal", "pm10_removal"), R("cost", "cost"),
        R("cost / coalesce(first_below, max_age)", "cost_per_day"),
        R("cost / coalesce(first_below, max_age) / avg_efficiency", "cost_per_efficiency")]) +
    " FROM st LEFT JOIN bl USING (filter_class) LEFT JOIN costs USING (filter_class)",
    COST_CTE + ", st AS (SELECT filter_class, regr_slope(efficiency, filter_age_days) * 100 AS decline_rate, "
    "max(efficiency) AS max_efficiency, max(filter_age_days) AS max_age, avg(efficiency) AS avg_efficiency, "
    "stddev_samp(efficiency) AS std_efficiency, avg(pressure_drop_pa) AS avg_pressure_drop, "
    "avg(inlet_pm25 - outlet_pm25) / avg(inlet_pm25) * 100 AS pm25_removal, "
    "avg(inlet_pm10 - outlet_pm10) / avg(inlet_pm10) * 100 AS pm10_removal, max(efficiency) * 0.95 AS threshold "
    "FROM clean GROUP BY filter_class), "
    "bl AS (SELECT c.filter_class, min(CASE WHEN c.efficiency < st.threshold THEN c.filter_age_days END) AS first_below "
    "FROM clean c JOIN st USING (filter_class) GROUP BY c.filter_class)")


@register("class_report", CLASS_REPORT_SQL)
def q_class_report(spark, d):
    return class_report(I.cleaned(spark, d), I.costs(spark))


@register("kpis", with_clean(
    "SELECT count(*) AS samples, " + ", ".join([
        R("avg(efficiency)", "efficiency_mean"), R("stddev_samp(efficiency)", "efficiency_std"),
        R("avg(pressure_drop_pa)", "pressure_mean"), R("stddev_samp(pressure_drop_pa)", "pressure_std"),
        R("avg(load_factor)", "load_mean"), R("stddev_samp(load_factor)", "load_std"),
        R("1 - avg(pressure_drop_pa) / max(pressure_drop_pa)", "pressure_performance"),
        R("avg(efficiency / pressure_drop_pa)", "pressure_efficiency")]) +
    ", CAST(floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000) AS BIGINT) AS date_span_days, "
    "min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM clean"))
def q_kpis(spark, d):
    return A.kpis(I.cleaned(spark, d))


def _band_sql(x):
    return f"CASE WHEN {x} < 0.7 THEN 'low' WHEN {x} < 0.9 THEN 'medium' WHEN {x} IS NOT NULL THEN 'high' END"


_RADAR_INNER = ("SELECT filter_class, avg(efficiency) AS efficiency, avg(load_factor) AS load_handling, "
                "1 - avg(pressure_drop_pa) / max(pressure_drop_pa) AS pressure_management, "
                "1 - avg(outlet_pm25 / inlet_pm25) AS pm25_removal, 1 - avg(outlet_pm10 / inlet_pm10) AS pm10_removal "
                "FROM clean GROUP BY filter_class")


@register("radar", with_clean(
    "SELECT filter_class, " + ", ".join(R(c, c) for c in
                                        ["efficiency", "load_handling", "pressure_management", "pm25_removal",
                                         "pm10_removal"]) + f" FROM ({_RADAR_INNER})"))
def q_radar(spark, d):
    return A.radar(I.cleaned(spark, d))


@register("gauge_bands", with_clean(
    f"SELECT filter_class, {_band_sql('efficiency')} AS efficiency_band, {_band_sql('load_handling')} AS load_band, "
    f"{_band_sql('pressure_management')} AS pressure_band FROM ({_RADAR_INNER})"))
def q_gauge(spark, d):
    r = A.radar(I.cleaned(spark, d))
    return r.select(CLASS, C.gauge_band("efficiency").alias("efficiency_band"),
                    C.gauge_band("load_handling").alias("load_band"),
                    C.gauge_band("pressure_management").alias("pressure_band"))


@register("basic_stats", with_clean(
    f"SELECT filter_class, count(*) AS sample_size, {R('avg(efficiency)', 'mean')}, {R('median(efficiency)', 'median')}, "
    "[round(min(efficiency), 6), round(max(efficiency), 6)] AS range FROM clean GROUP BY filter_class"))
def q_basic(spark, d):
    out = A.basic_stats(I.cleaned(spark, d))
    return out.withColumn("range", F.transform("range", lambda x: F.round(x, 6)))


@register("compare_classes", with_clean(
    "SELECT metric, " + R("max(CASE WHEN filter_class = 'PROMO' THEN v END)", '"PROMO"') + ", " +
    R("max(CASE WHEN filter_class = 'SMALL' THEN v END)", '"SMALL"') + " FROM ("
    + " UNION ALL ".join(f"SELECT filter_class, '{m}' AS metric, {e} AS v FROM clean "
                         "WHERE filter_class IN ('PROMO', 'SMALL') GROUP BY filter_class" for m, e in [
                             ("Mean Efficiency", "avg(efficiency)"), ("Median Efficiency", "median(efficiency)"),
                             ("Std Dev", "stddev_samp(efficiency)"), ("Min", "min(efficiency)"),
                             ("Max", "max(efficiency)")]) + ") GROUP BY metric"))
def q_compare_classes(spark, d):
    return compare_classes(I.cleaned(spark, d), "PROMO", "SMALL")


_QB = ("CASE WHEN efficiency <= q1 THEN 'Low' WHEN efficiency <= q2 THEN 'Medium' "
       "WHEN efficiency <= q3 THEN 'High' ELSE 'Very High' END")
_QB_CTE = (", qs AS (SELECT quantile_cont(efficiency, 0.25) AS q1, quantile_cont(efficiency, 0.5) AS q2, "
           "quantile_cont(efficiency, 0.75) AS q3 FROM clean), "
           f"banded AS (SELECT clean.*, {_QB} AS efficiency_category FROM clean, qs)")


@register("hierarchy_sum", with_clean(
    f"SELECT filter_class, efficiency_category, {R('sum(load_factor)', 'total')} FROM banded "
    "GROUP BY ROLLUP (filter_class, efficiency_category)", _QB_CTE))
def q_hierarchy(spark, d):
    df = S.quartile_band(I.cleaned(spark, d), EFF)
    return A.hierarchy_sum(df, [CLASS, "efficiency_category"], LOAD)


@register("quartile_bands", with_clean(
    "SELECT efficiency_category, count(*) AS n, " + R("min(efficiency)", "lo") + ", " + R("max(efficiency)", "hi") +
    " FROM banded GROUP BY 1", _QB_CTE))
def q_quartile_bands(spark, d):
    df = S.quartile_band(I.cleaned(spark, d), EFF)
    return df.groupBy("efficiency_category").agg(F.count(F.lit(1)).alias("n"), F.min(EFF).alias("lo"),
                                                 F.max(EFF).alias("hi"))
