"""Registered queries, part 2: windows/order, feature columns, statistics, curves, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from perfengine.functions import columns as C
from perfengine.functions.features import (with_features, with_parallel_metrics, with_row_metrics,
                                           with_time_parts)
from perfengine.operators import aggregates as A
from perfengine.operators import correlation as X
from perfengine.operators import curves as CV
from perfengine.operators import scaling as S
from perfengine.operators import smoothing as SM
from perfengine.operators import windows as W
from perfengine.plans import inputs as I
from perfengine.plans.class_report import class_report
from perfengine.plans.oracle import B, R, with_clean
from perfengine.plans.queries import EV_ORDER, register
from perfengine.schema import (AGE, CLASS, EFF, FEATURES_GUARDED, HEATMAP_COLS, IN10, IN25, LOAD, NUMERIC_COLS,
                               OUT10, OUT25, PRESSURE, READINGS_SCHEMA, TS)
from perfengine.sources.sinks import report_json, summary_lines

READING_ORDER = [TS, CLASS, "location"] + NUMERIC_COLS
_RO_SQL = ", ".join(READING_ORDER)

# ----------------------------------------------------------------------------- per-group values and order


@register("stability", with_clean(
    f"SELECT filter_class, {R('efficiency', 'efficiency')}, "
    f"{R('1 - stddev_samp(efficiency) OVER (PARTITION BY filter_class)', 'efficiency_stability')}, "
    f"{R('1 - stddev_samp(pressure_drop_pa) OVER (PARTITION BY filter_class)', 'pressure_stability')} FROM clean"))
def q_stability(spark, d):
    df = W.stability(I.cleaned(spark, d), EFF)
    df = W.stability(df, PRESSURE)
    return df.select(CLASS, EFF, "efficiency_stability", "pressure_stability")


@register("positional_trend_events",
          f"SELECT event_type, {R('regr_slope(value, pos)', 'value_trend')} FROM (SELECT event_type, value, "
          "row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events) GROUP BY 1")
def q_pos_trend_events(spark, d):
    return W.positional_slopes(I.event_rows(spark, d), "value", EV_ORDER, "event_type")


@register("positional_trend_readings", with_clean(
    f"SELECT filter_class, {R('regr_slope(efficiency, pos)', 'efficiency_trend')} FROM (SELECT filter_class, "
    f"efficiency, row_number() OVER (PARTITION BY filter_class ORDER BY {_RO_SQL}) - 1 AS pos FROM clean) GROUP BY 1"))
def q_pos_trend_readings(spark, d):
    return W.positional_slopes(I.cleaned(spark, d), EFF, READING_ORDER, CLASS)


@register("mean_step", f"SELECT {R('avg(d)', 'value_mean_step')} FROM "
                       "(SELECT value - lag(value) OVER (ORDER BY ts, event_id) AS d FROM events)")
def q_mean_step(spark, d):
    return W.mean_step(I.event_rows(spark, d), "value", EV_ORDER)


@register("mean_step_by_class", f"SELECT event_type, {R('avg(d)', 'value_mean_step')} FROM (SELECT event_type, "
                                "value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS d "
                                "FROM events) GROUP BY 1")
def q_mean_step_by(spark, d):
    return W.mean_step(I.event_rows(spark, d), "value", EV_ORDER, "event_type")


@register("peak_performance", with_clean(
    f"SELECT a.filter_class, {R('a.m', 'efficiency_top10_mean')}, {R('b.m', 'pressure_drop_pa_bottom10_mean')} FROM "
    "(SELECT filter_class, avg(efficiency) AS m FROM (SELECT filter_class, efficiency, row_number() OVER "
    " (PARTITION BY filter_class ORDER BY efficiency DESC) AS r FROM clean) WHERE r <= 10 GROUP BY 1) a FULL JOIN "
    "(SELECT filter_class, avg(pressure_drop_pa) AS m FROM (SELECT filter_class, pressure_drop_pa, row_number() OVER "
    " (PARTITION BY filter_class ORDER BY pressure_drop_pa) AS r FROM clean) WHERE r <= 10 GROUP BY 1) b "
    "USING (filter_class)"))
def q_peak(spark, d):
    return W.peak(I.cleaned(spark, d))


@register("cumulative_value", f"SELECT event_id, {R('sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)', 'cumulative_value')} FROM events")
def q_cumulative(spark, d):
    return W.cumulative_share(I.event_rows(spark, d), "value", EV_ORDER).select("event_id", "cumulative_value")


@register("best_so_far", f"SELECT event_id, {R('min(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)', 'best_value')} FROM events")
def q_best_so_far(spark, d):
    return W.best_so_far(I.event_rows(spark, d), "value", EV_ORDER).select("event_id", "best_value")


@register("best_so_far_by_class", "SELECT event_id, event_type, " + R(
    "min(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)", "best_value") +
          " FROM events")
def q_best_so_far_by(spark, d):
    return W.best_so_far(I.event_rows(spark, d), "value", EV_ORDER, ["event_type"]).select(
        "event_id", "event_type", "best_value")


_CURVE_CTE = (", curve AS (SELECT filter_class, filter_age_days AS age, avg(efficiency) AS y FROM clean GROUP BY 1, 2), "
              "init AS (SELECT filter_class, arg_min(y, age) AS y0 FROM curve GROUP BY 1), "
              "rep AS (SELECT c.filter_class, any_value(i.y0) AS y0, "
              "coalesce(min(CASE WHEN c.y < i.y0 * 0.95 THEN c.age END), 60) AS ra "
              "FROM curve c JOIN init i USING (filter_class) GROUP BY 1)")


@register("curve_replacement", with_clean(
    f"SELECT rep.filter_class, {R('y0', 'initial_efficiency')}, {B('ra', 'replacement_age')}, "
    f"{R('curve.y', 'efficiency_at_replacement')} FROM rep LEFT JOIN curve ON curve.filter_class = rep.filter_class "
    "AND curve.age = least(ra, 59)", _CURVE_CTE))
def q_curve_replacement(spark, d):
    curve = I.cleaned(spark, d).groupBy(CLASS, AGE).agg(F.avg(EFF).alias("predicted_efficiency"))
    return W.forecast_replacement(curve, CLASS, AGE)


@register("replacement_date", with_clean(
    f"SELECT filter_class, {R('arg_min(y, date)', 'initial_efficiency')}, "
    "min(CASE WHEN y < 0.95 THEN date END) AS replacement_date, "
    "CAST(date_diff('day', DATE '1995-01-01', min(CASE WHEN y < 0.95 THEN date END)) AS BIGINT) AS days_until_replacement "
    "FROM (SELECT filter_class, CAST(timestamp AS DATE) AS date, avg(efficiency) AS y FROM clean GROUP BY 1, 2) "
    "GROUP BY 1"))
def q_replacement_date(spark, d):
    sched = (I.cleaned(spark, d).groupBy(CLASS, F.to_date(TS).alias("date"))
             .agg(F.avg(EFF).alias("predicted_efficiency")))
    return W.replacement_date(sched, "1995-01-01")


@register("series", with_clean(f"SELECT filter_class, timestamp, {R('efficiency', 'efficiency')}, "
                               f"{R('pressure_drop_pa', 'pressure_drop_pa')}, {R('load_factor', 'load_factor')} FROM clean"))
def q_series(spark, d):
    return W.series(I.cleaned(spark, d), TS, [EFF, PRESSURE, LOAD])


@register("series_long", "SELECT ts AS timestamp, 'value' AS metric, " + R("value", "value") + " FROM events")
def q_series_long(spark, d):
    ev = I.event_rows(spark, d).select(F.col("ts").alias("timestamp"), "value")
    return W.series(ev, "timestamp", ["value"], None, long=True)


@register("daily_frames", with_clean(
    "SELECT filter_class, CAST(timestamp AS DATE) AS date, "
    "CAST(date_diff('day', (SELECT min(CAST(timestamp AS DATE)) FROM clean), CAST(timestamp AS DATE)) AS BIGINT) AS frame, "
    f"{R('efficiency', 'efficiency')}, {R('filter_age_days', 'filter_age_days')} FROM clean"))
def q_daily_frames(spark, d):
    return W.daily_frames(I.cleaned(spark, d), TS, [EFF, AGE])


@register("first_seen", "SELECT event_type, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS first_seen_rank "
                        "FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) "
                        "WHERE r = 1")
def q_first_seen(spark, d):
    return W.first_seen(I.event_rows(spark, d), "event_type", EV_ORDER)


@register("category_codes", with_clean(
    "SELECT filter_class, CAST(row_number() OVER (ORDER BY filter_class) - 1 AS BIGINT) AS code "
    "FROM (SELECT DISTINCT filter_class FROM clean)"))
def q_category_codes(spark, d):
    return S.category_codes(I.cleaned(spark, d), CLASS)


@register("top_classes", with_clean(
    f"SELECT filter_class, {R('avg(efficiency)', 'efficiency_mean')} FROM clean GROUP BY 1 "
    "ORDER BY avg(efficiency) DESC LIMIT 3"))
def q_top_classes(spark, d):
    m = I.cleaned(spark, d).groupBy(CLASS).agg(F.avg(EFF).alias("efficiency_mean"))
    return W.top_k(m, "efficiency_mean", 3)


@register("top_ages_by_class", with_clean(
    f"SELECT filter_class, {R('age', 'filter_age_days')}, {R('m', 'efficiency_mean')}, CAST(r AS BIGINT) AS rank FROM "
    "(SELECT filter_class, filter_age_days AS age, avg(efficiency) AS m, row_number() OVER (PARTITION BY filter_class "
    "ORDER BY avg(efficiency) DESC) AS r FROM clean GROUP BY 1, 2) WHERE r <= 3"))
def q_top_ages(spark, d):
    m = I.cleaned(spark, d).groupBy(CLASS, AGE).agg(F.avg(EFF).alias("efficiency_mean"))
    return W.top_k(m, "efficiency_mean", 3, by=CLASS).select(CLASS, AGE, "efficiency_mean", "rank")


@register("best_class_by_location", with_clean(
    f"SELECT location, arg_max(filter_class, m) AS best_filter_class, {R('max(m)', 'best_efficiency_mean')} FROM "
    "(SELECT location, filter_class, avg(efficiency) AS m FROM clean GROUP BY 1, 2) GROUP BY 1"))
def q_best_class(spark, d):
    m = I.cleaned(spark, d).groupBy("location", CLASS).agg(F.avg(EFF).alias("efficiency_mean"))
    return W.best_by(m, "location", CLASS, "efficiency_mean")


@register("first_value_by_class", f"SELECT event_type, {R('arg_min(value, (ts, event_id))', 'first_value')} FROM events GROUP BY 1")
def q_first_by(spark, d):
    return W.first_by(I.event_rows(spark, d), "event_type", "value", EV_ORDER)


# ----------------------------------------------------------------------------- feature columns


@register("time_parts", "SELECT event_id, CAST(hour(ts) AS BIGINT) AS hour, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week, "
                        "CAST(month(ts) AS BIGINT) AS month, CAST(CASE WHEN isodow(ts) IN (6, 7) THEN 1 ELSE 0 END AS BIGINT) "
                        "AS is_weekend FROM events")
def q_time_parts(spark, d):
    ev = with_time_parts(I.event_rows(spark, d), "ts")
    return ev.withColumn("is_weekend", F.weekday("ts").isin(5, 6).cast("int")).select(
        "event_id", "hour", "day_of_week", "month", "is_weekend")


_GUARD_SQL = ("CASE WHEN inlet_pm10 > 0 THEN inlet_pm25 / inlet_pm10 ELSE 0 END",
              "CASE WHEN pressure_drop_pa > 0 THEN efficiency / pressure_drop_pa ELSE 0 END",
              "CASE WHEN filter_age_days > 0 THEN load_factor / filter_age_days ELSE load_factor END")


@register("guarded_ratios", with_clean(
    "SELECT filter_class, " + ", ".join(R(e, n) for e, n in zip(_GUARD_SQL, ["pm_ratio", "pressure_efficiency_ratio",
                                                                               "load_age_ratio"])) + " FROM clean"))
def q_guarded(spark, d):
    return I.cleaned(spark, d).select(
        CLASS, C.guarded_ratio(IN25, IN10, 0.0).alias("pm_ratio"),
        C.guarded_ratio(EFF, PRESSURE, 0.0).alias("pressure_efficiency_ratio"),
        C.guarded_ratio(LOAD, AGE, LOAD).alias("load_age_ratio"))


@register("unguarded_ratios", with_clean(
    f"SELECT filter_class, {R('efficiency / pressure_drop_pa', 'performance_ratio')}, "
    f"{R('load_factor / filter_age_days', 'load_rate')}, {R('efficiency / filter_age_days', 'efficiency_decay')}, "
    f"{R('inlet_pm25 / inlet_pm10', 'pm_ratio')} FROM clean"))
def q_unguarded(spark, d):
    return I.cleaned(spark, d).select(
        CLASS, C.ratio(EFF, PRESSURE).alias("performance_ratio"), C.ratio(LOAD, AGE).alias("load_rate"),
        C.ratio(EFF, AGE).alias("efficiency_decay"), C.ratio(IN25, IN10).alias("pm_ratio"))


_WIN_CTE = (", g AS (SELECT *, hour(timestamp) AS hour, isodow(timestamp) - 1 AS day_of_week, month(timestamp) AS month, "
            f"{_GUARD_SQL[0]} AS pm_ratio, {_GUARD_SQL[1]} AS pressure_efficiency_ratio, {_GUARD_SQL[2]} AS load_age_ratio "
            "FROM clean), qg AS (SELECT " + ", ".join(
                f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi"
                for c in ["pm_ratio", "pressure_efficiency_ratio", "load_age_ratio"]) + " FROM g)")


@register("features_guarded", with_clean(
    "SELECT filter_class, " + ", ".join(
        [R(c, c) for c in [AGE, LOAD, PRESSURE, IN25, IN10]] +
        [B(c, c) for c in ["hour", "day_of_week", "month"]] +
        [R(f"least(greatest({c}, {c}_lo), {c}_hi)", c) for c in ["pm_ratio", "pressure_efficiency_ratio",
                                                                  "load_age_ratio"]]) + " FROM g, qg", _WIN_CTE))
def q_features_guarded(spark, d):
    return with_features(I.cleaned(spark, d), "guarded").select(CLASS, *FEATURES_GUARDED)


@register("features_interaction", with_clean(
    "SELECT filter_class, CAST(CASE WHEN isodow(timestamp) IN (6, 7) THEN 1 ELSE 0 END AS BIGINT) AS is_weekend, "
    f"{R('pressure_drop_pa * load_factor', 'pressure_load_interaction')}, "
    f"{R('filter_age_days * load_factor', 'age_load_interaction')}, {R('inlet_pm25 / inlet_pm10', 'pm_ratio')}, "
    f"{R('efficiency / pressure_drop_pa', 'pressure_efficiency')} FROM clean"))
def q_features_interaction(spark, d):
    return with_features(I.cleaned(spark, d), "interaction").select(
        CLASS, "is_weekend", "pressure_load_interaction", "age_load_interaction", "pm_ratio", "pressure_efficiency")


@register("removal_metrics", with_clean(
    f"SELECT filter_class, {R('(inlet_pm25 - outlet_pm25) / inlet_pm25 * 100', 'pm25_removal_pct')}, "
    f"{R('(inlet_pm10 - outlet_pm10) / inlet_pm10 * 100', 'pm10_removal_pct')}, "
    f"{R('(inlet_pm25 - outlet_pm25) / inlet_pm25', 'pm25_removal_rate')}, "
    f"{R('(inlet_pm10 - outlet_pm10) / inlet_pm10', 'pm10_removal_rate')}, "
    f"{R('((inlet_pm25 - outlet_pm25) / inlet_pm25 + (inlet_pm10 - outlet_pm10) / inlet_pm10) / 2', 'overall_pm_removal')} "
    "FROM clean"))
def q_removal_metrics(spark, d):
    df = with_row_metrics(I.cleaned(spark, d))
    return df.select(CLASS, C.removal_pct(IN25, OUT25).alias("pm25_removal_pct"),
                     C.removal_pct(IN10, OUT10).alias("pm10_removal_pct"), "pm25_removal_rate", "pm10_removal_rate",
                     "overall_pm_removal")


_ADV_SQL = ("SELECT filter_class, "
            + R("efficiency / pressure_drop_pa", "pressure_efficiency") + ", "
            + R("load_factor / filter_age_days", "load_rate") + ", "
            + R("efficiency / filter_age_days", "efficiency_decay") + ", "
            + R("efficiency * ((inlet_pm25 - outlet_pm25) / inlet_pm25) * (1 - load_factor) / pressure_drop_pa",
                "performance_index") + ", "
            + R("1 - stddev_samp(efficiency) OVER (PARTITION BY filter_class)", "efficiency_stability") + ", "
            + R("1 - stddev_samp(pressure_drop_pa) OVER (PARTITION BY filter_class)", "pressure_stability") + ", "
            + R(f"regr_slope(efficiency, pos) OVER (PARTITION BY filter_class)", "efficiency_trend")
            + f" FROM (SELECT *, row_number() OVER (PARTITION BY filter_class ORDER BY {_RO_SQL}) - 1 AS pos FROM clean)")


@register("advanced_metrics", with_clean(_ADV_SQL))
def q_advanced_metrics(spark, d):
    df = with_row_metrics(I.cleaned(spark, d))
    df = W.stability(df, EFF)
    df = W.stability(df, PRESSURE)
    df = W.with_positional_trend(df, EFF, READING_ORDER)
    return df.select(CLASS, "pressure_efficiency", "load_rate", "efficiency_decay", "performance_index",
                     "efficiency_stability", "pressure_stability", "efficiency_trend")


@register("parallel_metrics", with_clean(
    f"SELECT filter_class, {R('efficiency / pressure_drop_pa', 'efficiency_to_pressure')}, "
    f"{R('(inlet_pm25 - outlet_pm25) / inlet_pm25', 'pm_removal_ratio')}, "
    f"{R('efficiency * (1 - load_factor)', 'load_efficiency')} FROM clean"))
def q_parallel_metrics(spark, d):
    return with_parallel_metrics(I.cleaned(spark, d)).select(
        CLASS, "efficiency_to_pressure", "pm_removal_ratio", "load_efficiency")


_BAND_SQL = ("CASE WHEN filter_age_days > 0 AND filter_age_days <= 7 THEN '0-7 days' "
             "WHEN filter_age_days > 7 AND filter_age_days <= 14 THEN '7-14 days' "
             "WHEN filter_age_days > 14 AND filter_age_days <= 21 THEN '14-21 days' "
             "WHEN filter_age_days > 21 AND filter_age_days <= 28 THEN '21-28 days' "
             "WHEN filter_age_days > 28 THEN '28+ days' END")


@register("age_bands", with_clean(
    f"SELECT filter_class, {_BAND_SQL} AS age_category, count(*) AS n, {R('avg(efficiency)', 'efficiency_mean')} "
    "FROM clean GROUP BY 1, 2"))
def q_age_bands(spark, d):
    df = I.cleaned(spark, d).withColumn("age_category", C.age_band(AGE))
    return df.groupBy(CLASS, "age_category").agg(F.count(F.lit(1)).alias("n"), F.avg(EFF).alias("efficiency_mean"))


@register("minmax_scaled", with_clean(
    "SELECT filter_class, " + ", ".join(
        R(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())", f"{c}_normalized")
        for c in NUMERIC_COLS) + " FROM clean"))
def q_minmax(spark, d):
    df = S.minmax_scale(I.cleaned(spark, d), NUMERIC_COLS)
    return df.select(CLASS, *[f"{c}_normalized" for c in NUMERIC_COLS])


@register("standard_scaled", with_clean(
    "SELECT filter_class, " + ", ".join(
        R(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", c) for c in NUMERIC_COLS) + " FROM clean"))
def q_standard(spark, d):
    return S.standard_scale(I.cleaned(spark, d), NUMERIC_COLS).select(CLASS, *NUMERIC_COLS)


@register("robust_scaled", with_clean(
    "SELECT filter_class, " + ", ".join(
        R(f"({c} - quantile_cont({c}, 0.5) OVER ()) / (quantile_cont({c}, 0.75) OVER () - quantile_cont({c}, 0.25) OVER ())", c)
        for c in NUMERIC_COLS) + " FROM clean"))
def q_robust(spark, d):
    return S.robust_scale(I.cleaned(spark, d), NUMERIC_COLS).select(CLASS, *NUMERIC_COLS)


# ----------------------------------------------------------------------------- statistics


def _corr_sql(cols, by=None, source="clean", rounded=True):
    n = len(cols)
    keys = f"{by}, " if by else ""
    parts = []
    for i in range(n):
        for j in range(n):
            a, b = cols[i], cols[j]
            r = "any_value(1.0)" if i == j else f"covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b}))"
            parts.append(f"SELECT {keys}'{a}' AS a, '{b}' AS b, CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, "
                         f"{R(r, 'r') if rounded else f'CAST({r} AS DOUBLE) AS r'} FROM {source}"
                         + (f" GROUP BY {by}" if by else ""))
    return " UNION ALL ".join(parts)


@register("corr_matrix", with_clean(_corr_sql(NUMERIC_COLS)))
def q_corr(spark, d):
    return X.corr_matrix(I.cleaned(spark, d), NUMERIC_COLS)


@register("corr_by_class", with_clean(_corr_sql(HEATMAP_COLS, CLASS)))
def q_corr_by_class(spark, d):
    return X.corr_matrix(I.cleaned(spark, d), HEATMAP_COLS, CLASS)


@register("strong_pairs", with_clean(f"SELECT * FROM ({_corr_sql(NUMERIC_COLS)}) WHERE i < j AND abs(r) > 0.5"))
def q_strong(spark, d):
    return X.strong_pairs(I.cleaned(spark, d), NUMERIC_COLS, 0.5)


NETWORK_COLS = NUMERIC_COLS + ["pressure_efficiency", "load_rate", "efficiency_decay", "performance_index"]
_NET_SRC = ("(SELECT *, efficiency / pressure_drop_pa AS pressure_efficiency, load_factor / filter_age_days AS load_rate, "
            "efficiency / filter_age_days AS efficiency_decay, efficiency * ((inlet_pm25 - outlet_pm25) / inlet_pm25) "
            "* (1 - load_factor) / pressure_drop_pa AS performance_index FROM clean)")


@register("correlation_network", with_clean(
    f"SELECT a, b, i, j, {R('r', 'r')}, {R('abs(r) * 5', 'weight')} FROM "
    f"({_corr_sql(NETWORK_COLS, source=_NET_SRC, rounded=False)}) WHERE i < j AND abs(r) > 0.3"))
def q_network(spark, d):
    df = with_row_metrics(I.cleaned(spark, d))
    return X.strong_pairs(df, NETWORK_COLS, 0.3, weight=5.0)


_ANOVA_SQL = ("SELECT CAST(k - 1 AS BIGINT) AS df_between, CAST(nn - k AS BIGINT) AS df_within, "
              + R("(ssb / (k - 1)) / (ssw / (nn - k))", "f_statistic") +
              " FROM (SELECT sum(n * (m - grand) * (m - grand)) AS ssb, sum((n - 1) * v) AS ssw, count(*) AS k, "
              "sum(n) AS nn FROM (SELECT count(y) AS n, avg(y) AS m, var_samp(y) AS v FROM src GROUP BY g), "
              "(SELECT avg(y) AS grand FROM src))")


@register("anova_events", f"WITH src AS (SELECT event_type AS g, value AS y FROM events) {_ANOVA_SQL}")
def q_anova_events(spark, d):
    return X.anova(I.event_rows(spark, d), "event_type", "value").drop("p_value")


@register("anova_classes", with_clean(_ANOVA_SQL, ", src AS (SELECT filter_class AS g, efficiency AS y FROM clean)"))
def q_anova_classes(spark, d):
    return X.anova(I.cleaned(spark, d), CLASS, EFF).drop("p_value")


@register("anova_with_p")
def q_anova_p(spark, d):
    return X.anova(I.cleaned(spark, d), CLASS, EFF)


@register("trend_line", with_clean(
    f"SELECT filter_class, CAST(k AS BIGINT) AS k, {R('x', 'x')}, {R('a + b * x', 'y')} FROM (SELECT *, "
    "CASE WHEN k = 99 THEN hi ELSE lo + k * (hi - lo) / 99 END AS x FROM (SELECT filter_class, min(filter_age_days) AS lo, "
    "max(filter_age_days) AS hi, regr_slope(efficiency, filter_age_days) AS b, regr_intercept(efficiency, filter_age_days) "
    "AS a FROM clean GROUP BY 1), range(0, 100) t(k))"))
def q_trend_line(spark, d):
    return CV.trend_line(I.cleaned(spark, d))


def _box_sql(by_expr, src="clean"):
    return (f"SELECT g AS {by_expr[1]}, count(*) AS n, {R('any_value(q1)', 'q1')}, {R('any_value(med)', 'median')}, "
            f"{R('any_value(q3)', 'q3')}, {R('min(CASE WHEN y >= q1 - 1.5 * (q3 - q1) THEN y END)', 'whisker_low')}, "
            f"{R('max(CASE WHEN y <= q3 + 1.5 * (q3 - q1) THEN y END)', 'whisker_high')}, "
            "count(CASE WHEN y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers "
            f"FROM (SELECT {by_expr[0]} AS g, efficiency AS y FROM {src}) s JOIN (SELECT {by_expr[0]} AS g, "
            "quantile_cont(efficiency, 0.25) AS q1, quantile_cont(efficiency, 0.5) AS med, "
            f"quantile_cont(efficiency, 0.75) AS q3 FROM {src} GROUP BY 1) q USING (g) GROUP BY g")


@register("box_stats", with_clean(_box_sql(("filter_class", "filter_class"))))
def q_box(spark, d):
    return CV.box_stats(I.cleaned(spark, d), CLASS, EFF)


@register("box_stats_by_age_band", with_clean(_box_sql((_BAND_SQL, "age_category"))))
def q_box_band(spark, d):
    df = I.cleaned(spark, d).withColumn("age_category", C.age_band(AGE))
    return CV.box_stats(df, "age_category", EFF)


@register("density", with_clean(
    f"SELECT filter_class, CAST(kk AS BIGINT) AS k, {R('any_value(x)', 'x')}, "
    f"{R('sum(c * exp(-0.5 * ((x - y) / h) * ((x - y) / h))) / (any_value(n) * any_value(h) * sqrt(2 * pi()))', 'density')} "
    "FROM (SELECT v.*, p.*, kk, lo + kk * (hi - lo) / 99 AS x FROM (SELECT filter_class, efficiency AS y, count(*) AS c FROM clean "
    "GROUP BY 1, 2) v JOIN (SELECT filter_class AS pc, min(efficiency) AS lo, max(efficiency) AS hi, count(*) AS n, "
    "stddev_samp(efficiency) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h FROM clean GROUP BY 1) p "
    "ON v.filter_class = p.pc, range(0, 100) t(kk)) GROUP BY filter_class, kk"))
def q_density(spark, d):
    return SM.density(I.cleaned(spark, d), EFF, CLASS, 100)


_STAGE_CTE = (", staged AS (SELECT 'raw' AS stage, efficiency AS y FROM raw UNION ALL SELECT 'clean', efficiency FROM clean), "
              "par AS (SELECT stage, min(y) AS lo, max(y) AS hi, count(y) AS n, stddev_samp(y) * pow(CAST(count(y) AS DOUBLE), -0.2) AS h FROM staged GROUP BY 1), "
              "val AS (SELECT stage, y, count(*) AS c FROM staged WHERE y IS NOT NULL GROUP BY 1, 2)")


@register("density_raw_vs_clean", with_clean(
    f"SELECT stage, CAST(k AS BIGINT) AS k, {R('any_value(lo + k * (hi - lo) / 99)', 'x')}, "
    f"{R('sum(c * exp(-0.5 * ((lo + k * (hi - lo) / 99 - y) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi()))', 'density')} "
    "FROM val JOIN par USING (stage), range(0, 100) t(k) GROUP BY stage, k", _STAGE_CTE))
def q_density_stages(spark, d):
    """X9 before and after cleaning: one density a stage over the union of both tables."""
    both = I.readings(spark, d).select(F.lit("raw").alias("stage"), EFF).unionByName(I.cleaned(spark, d).select(F.lit("clean").alias("stage"), EFF))
    return SM.density(both, EFF, "stage", 100)


@register("histogram", with_clean(
    f"SELECT filter_class, CAST(b AS BIGINT) AS bin, count(*) AS count, {R('any_value(lo) + b * any_value(w)', 'bin_start')} "
    "FROM (SELECT filter_class, lo, w, least(floor((efficiency - lo) / w), 19) AS b FROM clean, "
    "(SELECT min(efficiency) AS lo, (max(efficiency) - min(efficiency)) / 20 AS w FROM clean)) GROUP BY filter_class, b"))
def q_histogram(spark, d):
    return CV.histogram(I.cleaned(spark, d), EFF, 20, CLASS)


_GRID_HELD = [LOAD, PRESSURE, IN25, IN10, "pm_ratio", "pressure_efficiency_ratio", "load_age_ratio"]


@register("condition_grid", with_clean(
    "SELECT filter_class, " + ", ".join(R(c, c) for c in _GRID_HELD) +
    f", {R('k', AGE)}, CAST(12 AS BIGINT) AS hour, CAST(3 AS BIGINT) AS day_of_week, CAST(6 AS BIGINT) AS month FROM "
    "(SELECT filter_class, " + ", ".join(f"median(least(greatest({c}, {c}_lo), {c}_hi)) AS {c}"
                                         if c in ("pm_ratio", "pressure_efficiency_ratio", "load_age_ratio")
                                         else f"median({c}) AS {c}" for c in _GRID_HELD) +
    " FROM g, qg GROUP BY 1), range(0, 60) t(k)", _WIN_CTE))
def q_condition_grid(spark, d):
    feats = with_features(I.cleaned(spark, d), "guarded")
    return CV.condition_grid(feats, FEATURES_GUARDED, "median")


@register("surface", with_clean(
    "SELECT filter_class, CAST(least(floor((filter_age_days - 0.0::DOUBLE) / 5.0::DOUBLE), 19) AS BIGINT) AS x_cell, "
    "CAST(least(floor((load_factor - 0.0::DOUBLE) / 0.05::DOUBLE), 19) AS BIGINT) AS y_cell, "
    # 12 digits: means of 2-decimal values over 64 or 128 rows lie on ties at 6
    f"{R('avg(efficiency)', 'efficiency_mean', 12)}, count(*) AS n FROM clean "
    "WHERE filter_age_days BETWEEN 0 AND 100 AND load_factor BETWEEN 0 AND 1 GROUP BY 1, 2, 3"), digits=12)
def q_surface(spark, d):
    return CV.surface(I.cleaned(spark, d))


@register("date_grid", with_clean(
    "SELECT filter_class, CAST(k AS BIGINT) AS day, start + k * INTERVAL 1 DAY AS date FROM "
    "(SELECT filter_class, max(timestamp) AS start FROM clean GROUP BY 1), range(0, 60) t(k)"))
def q_date_grid(spark, d):
    return CV.date_grid(I.cleaned(spark, d), TS, 60)


@register("parallel_table", with_clean(
    "SELECT filter_class, code AS color_value, " + ", ".join(
        R(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())", f"{c}_normalized")
        for c in ["efficiency", "filter_age_days", "load_factor", "pressure_drop_pa", "inlet_pm25", "inlet_pm10",
                  "efficiency_to_pressure", "pm_removal_ratio", "load_efficiency"]) +
    " FROM (SELECT *, efficiency / pressure_drop_pa AS efficiency_to_pressure, (inlet_pm25 - outlet_pm25) / inlet_pm25 "
    "AS pm_removal_ratio, efficiency * (1 - load_factor) AS load_efficiency FROM clean) JOIN "
    "(SELECT filter_class, CAST(row_number() OVER (ORDER BY filter_class) - 1 AS BIGINT) AS code FROM "
    "(SELECT DISTINCT filter_class FROM clean)) USING (filter_class)"))
def q_parallel(spark, d):
    from perfengine.schema import PARALLEL_COLS
    out = CV.parallel_table(I.cleaned(spark, d), CLASS)
    return out.select(CLASS, "color_value", *[f"{c}_normalized" for c in PARALLEL_COLS])


# ----------------------------------------------------------------------------- reports

_LINE_FMT = ("%s: Efficiency Decline Rate: %.3f%% per day; Optimal Replacement Age: %.1f days; "
             "Maximum Efficiency: %.3f; Average Efficiency: %.3f; PM2.5 Removal: %.1f%%; PM10 Removal: %.1f%%; "
             "Cost per Day: %.2f; Cost per Efficiency Unit: %.2f")
_LINE_COLS = ["filter_class", "decline_rate", "optimal_replacement_age", "max_efficiency", "avg_efficiency",
              "pm25_removal", "pm10_removal", "cost_per_day", "cost_per_efficiency"]


def _summary_sql():
    from perfengine.plans.queries import CLASS_REPORT_SQL
    body = CLASS_REPORT_SQL
    inner_select = body[body.rindex("SELECT st.filter_class"):]
    ctes = body[:body.rindex("SELECT st.filter_class")]
    fmt = _LINE_FMT.replace("'", "''")
    return (ctes + "SELECT printf('" + fmt + "', filter_class, decline_rate, optimal_replacement_age, max_efficiency, "
            "avg_efficiency, pm25_removal, pm10_removal, cost_per_day, cost_per_efficiency) AS value FROM ("
            + inner_select.replace("round(CAST(", "(CAST(").replace(" AS DOUBLE), 6)", " AS DOUBLE))") + ")")


@register("summary_lines", _summary_sql())
def q_summary_lines(spark, d):
    rep = class_report(I.cleaned(spark, d), I.costs(spark))
    return summary_lines(rep, _LINE_FMT, _LINE_COLS)


@register("report_json", with_clean(
    "SELECT filter_class, to_json({'Sections': {'Basic Statistics': {'Sample Size': n, 'Mean Efficiency': mean, "
    "'Median Efficiency': median, 'Efficiency Range': [lo, hi]}}}) AS report FROM (SELECT filter_class, count(*) AS n, "
    "round(avg(efficiency), 6) AS mean, round(median(efficiency), 6) AS median, round(min(efficiency), 6) AS lo, "
    "round(max(efficiency), 6) AS hi FROM clean GROUP BY 1)"))
def q_report_json(spark, d):
    b = A.basic_stats(I.cleaned(spark, d)).select(
        CLASS, F.col("sample_size").alias("Sample Size"), F.round("mean", 6).alias("Mean Efficiency"),
        F.round("median", 6).alias("Median Efficiency"),
        F.transform("range", lambda x: F.round(x, 6)).alias("Efficiency Range"))
    return report_json(b, [CLASS], {"Basic Statistics": ["Sample Size", "Mean Efficiency", "Median Efficiency",
                                                         "Efficiency Range"]})


# ----------------------------------------------------------------------------- streaming


@register("streaming_kpis", "SELECT TIMESTAMP '1970-01-01' + CAST(floor(epoch(l_shipdate) / 2592000) * 30 AS INTEGER) "
          "* INTERVAL 1 DAY AS window_start, p_type AS filter_class, count(*) AS n, "
          + ", ".join([R("avg(1 - l_discount)", "efficiency_mean"), R("stddev_samp(1 - l_discount)", "efficiency_std"),
                       R("min(1 - l_discount)", "efficiency_min"), R("max(1 - l_discount)", "efficiency_max"),
                       R("avg(l_extendedprice / 1000)", "pressure_mean"), R("avg(l_tax * 10 + 0.0)", "load_mean")])
          + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def q_streaming_kpis(spark, d):
    from perfengine.streaming.monitor import run_to_table
    return run_to_table(spark, d)


_LOWESS_SQL = (
    "SELECT filter_class, CAST(k AS BIGINT) AS k, " + R("any_value(g)", "x") + ", "
    + R("(sum(w * sy) - (CASE WHEN abs(sum(w * c) * sum(w * c * x * x) - sum(w * c * x) * sum(w * c * x)) > 1e-12 * sum(w * c) * sum(w * c) "
        "THEN (sum(w * c) * sum(w * sy * x) - sum(w * c * x) * sum(w * sy)) / (sum(w * c) * sum(w * c * x * x) - sum(w * c * x) * sum(w * c * x)) ELSE 0 END) "
        "* sum(w * c * x)) / sum(w * c) + (CASE WHEN abs(sum(w * c) * sum(w * c * x * x) - sum(w * c * x) * sum(w * c * x)) > 1e-12 * sum(w * c) * sum(w * c) "
        "THEN (sum(w * c) * sum(w * sy * x) - sum(w * c * x) * sum(w * sy)) / (sum(w * c) * sum(w * c * x * x) - sum(w * c * x) * sum(w * c * x)) ELSE 0 END) * any_value(g)",
        "fitted")
    + " FROM (SELECT e.*, CASE WHEN d / r < 1 THEN pow(1 - pow(d / r, 3), 3) ELSE 0 END AS w FROM e JOIN "
    "(SELECT filter_class, k, min(d) AS r FROM e WHERE cum >= kk GROUP BY 1, 2) USING (filter_class, k)) "
    "GROUP BY filter_class, k")
_LOWESS_CTE = (
    ", v AS (SELECT filter_class, load_factor AS x, count(*) AS c, sum(pressure_drop_pa) AS sy FROM clean GROUP BY 1, 2), "
    "p AS (SELECT filter_class, min(load_factor) AS lo, max(load_factor) AS hi, "
    "CAST(floor(count(*) * (2.0 / 3.0) + 1e-10) AS BIGINT) AS kk FROM clean GROUP BY 1), "
    "gx AS (SELECT v.*, p.lo, p.hi, p.kk, t.k, CASE WHEN t.k = 99 THEN p.hi ELSE p.lo + t.k * ((p.hi - p.lo) / 99) END AS g "
    "FROM v JOIN p USING (filter_class), range(0, 100) t(k)), "
    "e AS (SELECT *, abs(x - g) AS d, sum(c) OVER (PARTITION BY filter_class, k ORDER BY abs(x - g) "
    "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM gx)")


@register("local_fit", with_clean(_LOWESS_SQL, _LOWESS_CTE))
def q_local_fit(spark, d):
    return SM.local_fit(I.cleaned(spark, d), LOAD, PRESSURE, CLASS, 2.0 / 3.0, 100)


def _lowess_of(x: str, y: str) -> str:
    return with_clean(_LOWESS_SQL, _LOWESS_CTE).replace("load_factor AS x", f"{x} AS x").replace("sum(pressure_drop_pa) AS sy", f"sum({y}) AS sy") \
        .replace("min(load_factor) AS lo, max(load_factor) AS hi", f"min({x}) AS lo, max({x}) AS hi").replace("100) t(k)", "20) t(k)") \
        .replace("t.k = 99", "t.k = 19").replace("/ 99)", "/ 19)")


@register("local_fit_pressure", _lowess_of(PRESSURE, EFF))
def q_local_fit_pressure(spark, d):
    """Efficiency over a continuous x."""
    return SM.local_fit(I.cleaned(spark, d), PRESSURE, EFF, CLASS, 2.0 / 3.0, 20)


@register("local_fit_robust")
def q_local_fit_robust(spark, d):
    """Pressure over age with three passes of residual weights."""
    return SM.local_fit(I.cleaned(spark, d), AGE, PRESSURE, CLASS, 2.0 / 3.0, 100, robust=3)


# ----------------------------------------------------------------------------- sinks and read-back


def _scratch(spark, name: str) -> str:
    import uuid

    from perfengine.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("csv_ingest", "SELECT p_type AS filter_class, count(*) FILTER (l_quantity <> 50) AS good_rows, count(*) FILTER (l_quantity = 50) AS bad_rows, "
          + R("avg(l_quantity) FILTER (l_quantity <> 50)", "age_mean") + ", " + R("sum(l_extendedprice / 1000) FILTER (l_quantity <> 50)", "pressure_sum")
          + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def q_csv_ingest(spark, d):
    """Readings written as CSV with the age of every reading of age 50 made unreadable, read back and counted."""
    from perfengine.sources.readers import ingest_report, read_readings_checked
    from perfengine.sources.sinks import write_table
    path = _scratch(spark, "readings-csv")
    names = [f.name for f in READINGS_SCHEMA.fields]
    age = F.when(F.col(AGE) == 50, F.lit("n/a")).otherwise(F.col(AGE).cast("string"))
    write_table(I.readings(spark, d).withColumn(AGE, age).withColumn(TS, F.col(TS).cast("timestamp_ntz")).select(*names), path, "csv")
    return ingest_report(read_readings_checked(spark, path), CLASS, {"age_mean": F.avg(AGE), "pressure_sum": F.sum(PRESSURE)})


@register("class_files_roundtrip", with_clean(
    f"SELECT filter_class, count(*) AS n, {R('avg(efficiency)', 'efficiency_mean')}, "
    f"{R('sum(pressure_drop_pa)', 'pressure_sum')} FROM clean GROUP BY 1"))
def q_class_files(spark, d):
    """Write the cleaned table one folder per class (parquet), read it back, summarise."""
    from perfengine.sources.sinks import write_by_class
    path = _scratch(spark, "by-class")
    write_by_class(I.cleaned(spark, d), path, CLASS, "parquet")
    back = spark.read.parquet(path)
    return back.groupBy(CLASS).agg(F.count(F.lit(1)).alias("n"), F.avg(EFF).alias("efficiency_mean"),
                                   F.sum(PRESSURE).alias("pressure_sum"))


@register("stats_csv_roundtrip", with_clean(
    f"SELECT filter_class, {R('round(avg(efficiency), 3)', 'efficiency_mean')}, "
    f"{R('round(stddev_samp(efficiency), 3)', 'efficiency_std')} FROM clean GROUP BY filter_class"))
def q_stats_csv(spark, d):
    """Write a statistics table as CSV with a header (key kept as a column), read it back."""
    from perfengine.sources.readers import read_table
    from perfengine.sources.sinks import write_table
    path = _scratch(spark, "stats-csv")
    write_table(A.class_stats(I.cleaned(spark, d), {EFF: ["mean", "std"]}, CLASS, 3), path, "csv")
    return read_table(spark, path, "csv", schema="filter_class string, efficiency_mean double, efficiency_std double")
