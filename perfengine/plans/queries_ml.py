"""Registered queries, part 3: splits, metrics and Spark ML operators.

Forests of many trees cannot be restated in SQL; those queries carry no oracle
(rows-only check). Splits, fold sizes, metric formulas, least squares and fits
with a closed answer (a tree grown to its end gives cell means, two standardised
columns have the components 1 +- r) can, and do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from perfengine.functions.features import leak_free, with_features, with_row_metrics
from perfengine.ml import ensembles, evaluation, forecast as FC, gram, models as M, pca, selection, split
from perfengine.ml.metrics import regression_metrics
from perfengine.operators import aggregates as A
from perfengine.operators import correlation as X
from perfengine.operators import windows as W
from perfengine.operators.joins import join_small
from perfengine.plans import inputs as I
from perfengine.plans.oracle import R, with_clean
from perfengine.plans.queries import EV_ORDER, register
from perfengine.schema import (AGE, CLASS, EFF, FEATURES_GUARDED, FEATURES_INTERACTION, LOAD, NUMERIC_COLS, OUT25,
                               PCA_PROJECT_COLS, PRESSURE, TS)

KEY = "reading_key"
# Depth of the forests that the registered queries fit dozens of times; the library itself sets no limit.
QUERY_DEPTH = 10
_HASH_SQL = "('0x' || substr(md5(reading_key), 1, 8))::BIGINT"
_FOLD_SQL = "('0x' || substr(md5('fold:' || reading_key), 1, 8))::BIGINT"


def _keyed_clean_sql():
    # the cleaned CTE chain over a keyed readings view
    from perfengine.plans.oracle import cleaned_ctes
    return cleaned_ctes().replace(
        "l_extendedprice * (1 + l_tax) * l_discount + 0.0 AS outlet_pm10\n",
        "l_extendedprice * (1 + l_tax) * l_discount + 0.0 AS outlet_pm10, "
        "concat_ws('-', l_orderkey, l_partkey, l_linenumber) AS reading_key\n")


def _kc(body: str) -> str:
    return f"{_keyed_clean_sql()}\n{body}"


# ----------------------------------------------------------------------------- SQL-checkable


@register("split_sizes", _kc(
    f"SELECT filter_class, count(CASE WHEN {_HASH_SQL} % 5 >= 1 THEN 1 END) AS n_train, "
    f"count(CASE WHEN {_HASH_SQL} % 5 < 1 THEN 1 END) AS n_test FROM clean GROUP BY 1"))
def q_split_sizes(spark, d):
    df = split.with_split_flag(I.cleaned(spark, d, keyed=True), KEY)
    return df.groupBy(CLASS).agg(F.count(F.when(F.col("is_test") == 0, 1)).alias("n_train"),
                                 F.count(F.when(F.col("is_test") == 1, 1)).alias("n_test"))


@register("hash_fold_sizes", _kc(
    f"SELECT filter_class, CAST({_FOLD_SQL} % 5 AS BIGINT) AS fold, count(*) AS n FROM clean GROUP BY 1, 2"))
def q_hash_folds(spark, d):
    df = split.with_hash_folds(I.cleaned(spark, d, keyed=True), KEY)
    return df.groupBy(CLASS, "fold").agg(F.count(F.lit(1)).alias("n"))


@register("ordered_folds", "SELECT event_id, CAST(ntile(5) OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS fold FROM events")
def q_ordered_folds(spark, d):
    return split.with_ordered_folds(I.event_rows(spark, d), EV_ORDER).select("event_id", "fold")


@register("ordered_folds_by_class", "SELECT event_id, event_type, CAST(ntile(5) OVER (PARTITION BY event_type "
                                    "ORDER BY ts, event_id) - 1 AS BIGINT) AS fold FROM events")
def q_ordered_folds_by(spark, d):
    return split.with_ordered_folds(I.event_rows(spark, d), EV_ORDER, by="event_type").select(
        "event_id", "event_type", "fold")


_TREND_PRED = ("(SELECT c.filter_class, efficiency AS y, a + b * filter_age_days AS p FROM clean c JOIN "
               "(SELECT filter_class, regr_slope(efficiency, filter_age_days) AS b, "
               "regr_intercept(efficiency, filter_age_days) AS a FROM clean GROUP BY 1) USING (filter_class))")


@register("trend_metrics", with_clean(
    "SELECT filter_class, " + ", ".join([
        R("sqrt(avg((y - p) * (y - p)))", "rmse"), R("avg(abs(y - p))", "mae"),
        R("1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y))", "r2"),
        R("avg(abs((y - p) / y)) * 100", "mape"), R("1 - var_pop(y - p) / var_pop(y)", "explained_variance")])
    + f", count(*) AS n FROM {_TREND_PRED} GROUP BY 1"))
def q_trend_metrics(spark, d):
    df = I.cleaned(spark, d)
    t = A.trend(df).select(CLASS, "slope", "intercept")
    pred = join_small(df, t, CLASS).withColumn("prediction", F.col("intercept") + F.col("slope") * F.col(AGE))
    return regression_metrics(pred, EFF, "prediction", CLASS)


@register("linear_one_feature", with_clean(
    f"SELECT filter_class, {R('regr_slope(efficiency, filter_age_days)', 'coefficient')}, "
    f"{R('regr_intercept(efficiency, filter_age_days)', 'intercept')} FROM clean GROUP BY 1"))
def q_linear(spark, d):
    data = M.labelled(I.cleaned(spark, d), EFF)

    def one(cdf, cls):
        m = M.pipeline([AGE], M.linear(), scale=None).fit(cdf).stages[-1]
        return (cls, float(m.coefficients[0]), float(m.intercept))

    rows = list(M.per_class(data, CLASS, one).values())
    return spark.createDataFrame(rows, "filter_class string, coefficient double, intercept double")


# fold models of one feature from sums over the other folds, scored on the rows of the fold
_FOLD_LINE = (f", f AS (SELECT *, CAST({_FOLD_SQL} % 5 AS BIGINT) AS fold, filter_age_days AS x, efficiency AS y FROM clean), "
              "k AS (SELECT DISTINCT filter_class, fold FROM f), "
              "line AS (SELECT k.filter_class, k.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a "
              "FROM k JOIN f ON f.filter_class = k.filter_class AND f.fold <> k.fold GROUP BY 1, 2)")


def _folded(spark, d):
    return split.with_hash_folds(I.cleaned(spark, d, keyed=True), KEY)


@register("linear_cv_metrics", _keyed_clean_sql() + _FOLD_LINE + f"""
SELECT f.filter_class, f.fold, {R('sqrt(avg((y - a - b * x) ** 2))', 'rmse')},
       {R('1 - sum((y - a - b * x) ** 2) / (var_pop(y) * count(*))', 'r2')}
FROM f JOIN line USING (filter_class, fold) GROUP BY 1, 2""")
def q_linear_cv(spark, d):
    return gram.cross_validated(_folded(spark, d), [AGE], EFF, CLASS)[1]


@register("linear_oof_predictions", _keyed_clean_sql() + _FOLD_LINE + f"""
SELECT reading_key, f.fold, {R('a + b * x', 'prediction')} FROM f JOIN line USING (filter_class, fold)""")
def q_linear_oof(spark, d):
    data = _folded(spark, d)
    models, _ = gram.cross_validated(data, [AGE], EFF, CLASS)
    return gram.out_of_fold(data, models, [AGE], CLASS).select(KEY, "fold", "prediction")


_ROW_ORDER = [TS, "location", *NUMERIC_COLS, KEY]


@register("learning_curve_by_class", _keyed_clean_sql() + f"""
, p AS (SELECT filter_class, filter_age_days AS x, efficiency AS y, row_number() OVER w - 1 AS pos, ntile(5) OVER w - 1 AS fold
      FROM clean WINDOW w AS (PARTITION BY filter_class ORDER BY {', '.join(_ROW_ORDER)})),
bound AS (SELECT filter_class, fold, min(pos) AS a, max(pos) + 1 AS b FROM p GROUP BY 1, 2),
most AS (SELECT filter_class, max(b) - max(CASE WHEN fold = 0 THEN b - a END) AS n FROM bound GROUP BY 1),
size AS (SELECT DISTINCT filter_class, greatest(1, n * s // 10) AS m FROM most, range(1, 11) t(s)),
used AS (SELECT p.filter_class, m, bound.fold, x, y, CASE WHEN p.fold = bound.fold THEN 'v' ELSE 't' END AS part
      FROM p JOIN bound USING (filter_class) JOIN size USING (filter_class)
      WHERE p.fold = bound.fold OR CASE WHEN pos < a THEN pos ELSE pos - (b - a) END < m),
line AS (SELECT filter_class, m, fold, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM used WHERE part = 't' GROUP BY 1, 2, 3),
r AS (SELECT filter_class, m, fold, part, 1 - sum((y - i - s * x) ** 2) / (var_pop(y) * count(*)) AS r2
      FROM used JOIN line USING (filter_class, m, fold) GROUP BY 1, 2, 3, 4)
SELECT filter_class, CAST(m AS BIGINT) AS train_size, {R("avg(r2) FILTER (part = 't')", 'training_score')},
       {R("avg(r2) FILTER (part = 'v')", 'validation_score')}, {R("stddev_pop(r2) FILTER (part = 't')", 'training_std')},
       {R("stddev_pop(r2) FILTER (part = 'v')", 'validation_std')} FROM r GROUP BY 1, 2""")
def q_learning_curve_by_class(spark, d):
    data = split.with_ordered_folds(I.cleaned(spark, d, keyed=True), _ROW_ORDER, by=CLASS)
    return gram.learning_curve(data, [AGE], EFF, CLASS)


@register("lasso_one_feature", with_clean(
    "SELECT 'pressure_drop_pa' AS feature, "
    + R("greatest(abs(corr(efficiency, pressure_drop_pa)) * stddev_pop(efficiency) - 0.00001, 0)", "importance", 9)
    + ", abs(corr(efficiency, pressure_drop_pa)) * stddev_pop(efficiency) > 0.00001 AS selected FROM clean"), digits=9)
def q_lasso_one(spark, d):
    """The soft threshold of the covariance with the standardised feature."""
    grams = gram.Grams(I.cleaned(spark, d), ["pressure_drop_pa"], EFF, [])
    b = abs(float(gram.lasso(grams.of[()], 0.00001)[0]))
    return spark.createDataFrame([("pressure_drop_pa", b, b > 0)], "feature string, importance double, selected boolean")


@register("lasso_path_selection")
def q_lasso_path(spark, d):
    return gram.select_lasso(split.with_hash_folds(_interaction_data(spark, d), KEY), FEATURES_INTERACTION)[1]


# one-feature ridge: the least-squares slope over (1 + alpha), the line through the means
def _search_sql(trials: str) -> str:
    return _keyed_clean_sql() + f"""
, f AS (SELECT CAST({_FOLD_SQL} % 5 AS BIGINT) AS fold, filter_age_days AS x, pressure_drop_pa AS y FROM clean),
t AS ({trials}),
k AS (SELECT fold FROM f GROUP BY 1),
line AS (SELECT k.fold, regr_slope(y, x) AS b, avg(x) AS mx, avg(y) AS my FROM k JOIN f ON f.fold <> k.fold GROUP BY 1),
s AS (SELECT trial, alpha, f.fold, avg((y - my - b / (1 + alpha) * (x - mx)) ** 2) AS mse FROM f JOIN line USING (fold), t GROUP BY 1, 2, 3),
m AS (SELECT arg_min(trial, mse) AS best FROM (SELECT trial, avg(mse) AS mse FROM s GROUP BY 1))
SELECT CAST(trial AS BIGINT) AS trial, {R('alpha', 'alpha')}, fold, {R('mse', 'mse')}, trial = best AS best FROM s, m"""


_GRID = [0.0, 0.001, 0.01, 0.1, 1.0, 10.0]


@register("ridge_grid_search", _search_sql("SELECT i AS trial, CASE i " + " ".join(f"WHEN {i} THEN {a}::DOUBLE" for i, a in enumerate(_GRID)) + f" END AS alpha FROM range(0, {len(_GRID)}) r(i)"))
def q_ridge_grid(spark, d):
    return gram.search(_folded(spark, d), [AGE], PRESSURE, _GRID)[0]


@register("ridge_random_search", _search_sql("SELECT i AS trial, 0.0001::DOUBLE * pow(100000::DOUBLE, ('0x' || substr(md5('42:' || i), 1, 8))::BIGINT / 4294967296::DOUBLE) AS alpha FROM range(0, 20) r(i)"))
def q_ridge_random(spark, d):
    return gram.search(_folded(spark, d), [AGE], PRESSURE, gram.drawn(1e-4, 10.0, 20))[0]


_TARGETS = [EFF, PRESSURE, LOAD]
_TARGET_EXPR = {"is_weekend": "CAST(isodow(timestamp) IN (6, 7) AS INTEGER)", "hour": "hour(timestamp)", "day_of_week": "isodow(timestamp) - 1", "month": "month(timestamp)",
                "pressure_load_interaction": "pressure_drop_pa * load_factor", "age_load_interaction": "filter_age_days * load_factor",
                "pm_ratio": "inlet_pm25 / inlet_pm10", "pressure_efficiency": "efficiency / pressure_drop_pa"}
# stated apart from the code: what of the feature set each target rules out
_TARGET_DROPS = {EFF: ["pressure_efficiency"], PRESSURE: ["pressure_load_interaction", "pressure_efficiency"],
                 LOAD: ["pressure_load_interaction", "age_load_interaction"]}
_TARGET_PAIRS = [(t, f) for t in _TARGETS for f in [*FEATURES_INTERACTION, EFF] if f != t]


def _pair_sql(t: str, f: str) -> str:
    e = _TARGET_EXPR.get(f, f)
    return (f"SELECT '{t}' AS target, '{f}' AS feature, {str(f not in _TARGET_DROPS[t]).upper()} AS kept, "
            + R(f"CASE WHEN min({e}) < max({e}) THEN corr({t}, {e}) ** 2 END", "r2") + " FROM clean")


@register("target_choice", with_clean(" UNION ALL ".join(_pair_sql(t, f) for t, f in _TARGET_PAIRS)))
def q_target_choice(spark, d):
    """What a model of each target may use, with what each feature alone explains; what is made from the target stands out."""
    df = with_features(I.cleaned(spark, d), "interaction")
    candidates = [*FEATURES_INTERACTION, EFF]
    return gram.explained(df, _TARGETS, candidates, lambda f, t: f in leak_free(candidates, t))


@register("target_cv")
def q_target_cv(spark, d):
    """Linear cross-validation with pressure and load as y, on the features that are not made from them."""
    data = split.with_hash_folds(with_features(I.cleaned(spark, d, keyed=True), "interaction"), KEY)
    parts = [gram.cross_validated(data, leak_free([*FEATURES_INTERACTION, EFF], y), y, CLASS)[1].withColumn("target", F.lit(y)) for y in (PRESSURE, LOAD)]
    return parts[0].unionByName(parts[1])


@register("maintenance_advice", with_clean(
    "SELECT filter_class, CAST(ra AS BIGINT) AS replace_at_age, CAST(ra - 5 AS BIGINT) AS check_at_age, "
    f"{R('y0', 'warning_efficiency')} FROM rep",
    ", curve AS (SELECT filter_class, filter_age_days AS age, avg(efficiency) AS y FROM clean GROUP BY 1, 2), "
    "init AS (SELECT filter_class, arg_min(y, age) AS y0 FROM curve GROUP BY 1), "
    "rep AS (SELECT c.filter_class, any_value(i.y0) AS y0, coalesce(min(CASE WHEN c.y < i.y0 * 0.95 THEN c.age END), 60) "
    "AS ra FROM curve c JOIN init i USING (filter_class) GROUP BY 1)"))
def q_advice(spark, d):
    curve = I.cleaned(spark, d).groupBy(CLASS, AGE).agg(F.avg(EFF).alias("predicted_efficiency"))
    return FC.advice(W.forecast_replacement(curve, CLASS, AGE))


# ----------------------------------------------------------------------------- model fits (rows-only)

_FORECAST_CACHE: dict = {}


def _forecast(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _FORECAST_CACHE:
        _FORECAST_CACHE[key] = FC.forecast(I.cleaned(spark, d, keyed=True), KEY)
    return _FORECAST_CACHE[key]


@register("forest_forecast")
def q_forest_forecast(spark, d):
    return _forecast(spark, d)["predictions"]


@register("forest_replacement")
def q_forest_replacement(spark, d):
    return _forecast(spark, d)["replacement"]


@register("forest_importances")
def q_forest_importances(spark, d):
    return _forecast(spark, d)["importances"]


@register("forest_test_metrics")
def q_forest_metrics(spark, d):
    return _forecast(spark, d)["metrics"]


@register("model_summary")
def q_model_summary(spark, d):
    m = _forecast(spark, d)["metrics"].withColumn("model", F.lit("Random Forest"))
    return A.model_summary(m)


def _cv_data(spark, d):
    feats = M.labelled(with_features(I.cleaned(spark, d, keyed=True), "guarded"), EFF)
    return split.with_hash_folds(feats, KEY)


_CV_CACHE: dict = {}


@register("cv_metrics")
def q_cv(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _CV_CACHE:
        _CV_CACHE[key] = _cv(spark, d).persist()
    return _CV_CACHE[key]


def _cv(spark, d):
    data = _cv_data(spark, d)

    def one(cdf, cls):
        metrics, _ = evaluation.cross_validate(cdf, lambda: M.pipeline(FEATURES_GUARDED, M.forest(100, QUERY_DEPTH), "robust"),
                                               threads=5)
        return metrics.withColumn(CLASS, F.lit(cls))

    parts = list(M.per_class(data, CLASS, one, threads=6).values())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(CLASS, "fold", "rmse", "mae", "r2", "mape", "explained_variance")


@register("cv_summary")
def q_cv_summary(spark, d):
    return A.cv_summary(q_cv(spark, d), ["r2", "rmse", "mae", "mape", "explained_variance"], [CLASS])


@register("oof_predictions")
def q_oof(spark, d):
    data = _cv_data(spark, d)
    return evaluation.oof_predict(data, lambda: M.pipeline(FEATURES_GUARDED + [], M.forest(50, QUERY_DEPTH), "robust"),
                                  keep=[CLASS, KEY])


def _interaction_data(spark, d):
    return M.labelled(with_features(I.cleaned(spark, d, keyed=True), "interaction"), EFF)


@register("learning_curve")
def q_learning_curve(spark, d):
    data = split.with_ordered_folds(_interaction_data(spark, d), [TS, CLASS, "location", *NUMERIC_COLS, KEY])
    data = M.assembled(data.na.drop(subset=FEATURES_INTERACTION), FEATURES_INTERACTION, ["_pos", "fold"])
    return evaluation.learning_curve(data, lambda: M.forest(50, QUERY_DEPTH), threads=10)


@register("model_comparison")
def q_model_comparison(spark, d):
    return FC.compare_models(with_features(I.cleaned(spark, d, keyed=True), "interaction"), KEY,
                             FEATURES_INTERACTION, with_linear=True, max_depth=QUERY_DEPTH)


@register("best_model_by_class")
def q_best_model(spark, d):
    cmp = FC.compare_models(with_features(I.cleaned(spark, d, keyed=True), "guarded_weekend"), KEY,
                            FEATURES_GUARDED + ["is_weekend"], by=CLASS, num_trees=100, max_depth=QUERY_DEPTH)
    return W.best_by(cmp, CLASS, "model", "r2")


@register("lasso_selection")
def q_lasso(spark, d):
    data = split.with_hash_folds(_interaction_data(spark, d), KEY)
    _, table = selection.select_lasso(data, FEATURES_INTERACTION)
    return table


@register("rfe_selection")
def q_rfe(spark, d):
    _, table = selection.select_rfe(_interaction_data(spark, d), FEATURES_INTERACTION, keep=8, num_trees=100, max_depth=QUERY_DEPTH)
    return table


@register("permutation_importance")
def q_perm(spark, d):
    data = _interaction_data(spark, d)
    model = M.pipeline(FEATURES_INTERACTION, M.forest(50, QUERY_DEPTH), "standard").fit(data)
    return selection.permutation_importance(model, data, FEATURES_INTERACTION, [KEY])


@register("voting_ensemble")
def q_voting(spark, d):
    data = _interaction_data(spark, d)
    train, test = split.hash_split(data, KEY)
    makers = {"rf": lambda: M.pipeline(FEATURES_INTERACTION, M.forest(50, QUERY_DEPTH), "standard"),
              "gbt": lambda: M.pipeline(FEATURES_INTERACTION, M.gbt(50), "standard")}
    model = ensembles.fit_voting(train, makers)
    return regression_metrics(model.transform(test), "label", "prediction")


@register("stacking_ensemble")
def q_stacking(spark, d):
    data = split.with_hash_folds(_interaction_data(spark, d), KEY)
    data = M.assembled(data.na.drop(subset=FEATURES_INTERACTION), FEATURES_INTERACTION, ["fold", KEY])
    train, test = split.hash_split(data, KEY)
    model = ensembles.fit_stacking(train, {"rf": lambda: M.forest(50, QUERY_DEPTH), "gbt": lambda: M.gbt(50)})
    return regression_metrics(model.transform(test), "label", "prediction")


@register("maintenance_schedule")
def q_schedule(spark, d):
    return FC.maintenance_schedule(I.cleaned(spark, d, keyed=True), KEY, "2002-01-01")["replacement"]


@register("pca_variance")
def q_pca(spark, d):
    return pca.pca(I.cleaned(spark, d), NUMERIC_COLS)


@register("pca_projection")
def q_pca_project(spark, d):
    df = with_row_metrics(I.cleaned(spark, d))
    return pca.pca_project(df, PCA_PROJECT_COLS, 3, [CLASS])


@register("sample_points", _kc(
    f"SELECT reading_key, {R('filter_age_days', 'filter_age_days')}, {R('efficiency', 'efficiency')} FROM clean "
    f"WHERE {_HASH_SQL} % 1000 < 100"))
def q_sample_points(spark, d):
    from perfengine.operators.curves import sample_points
    return sample_points(I.cleaned(spark, d, keyed=True), [AGE, EFF], KEY, 0.1)


_MEAN_HELD = ["load_factor", "pressure_drop_pa", "inlet_pm25", "inlet_pm10"]


@register("condition_grid_mean", with_clean(
    "SELECT filter_class, " + ", ".join(R(c, c) for c in _MEAN_HELD) + f", {R('k', AGE)}, "
    "CAST(12 AS BIGINT) AS hour, CAST(3 AS BIGINT) AS day_of_week, CAST(6 AS BIGINT) AS month, "
    f"{R('inlet_pm25 / inlet_pm10', 'pm_ratio')}, {R('0.9 / pressure_drop_pa', 'pressure_efficiency_ratio')}, "
    f"{R('load_factor / (CASE WHEN k = 0 THEN 1 ELSE k END)', 'load_age_ratio')} FROM "
    "(SELECT filter_class, " + ", ".join(f"avg({c}) AS {c}" for c in _MEAN_HELD) + " FROM clean GROUP BY 1), "
    "range(0, 60) t(k)"))
def q_condition_grid_mean(spark, d):
    from perfengine.functions.columns import nonzero
    from perfengine.operators.curves import condition_grid
    derived = {"pm_ratio": F.col("inlet_pm25") / F.col("inlet_pm10"),
               "pressure_efficiency_ratio": F.lit(0.9) / F.col("pressure_drop_pa"),
               "load_age_ratio": F.col("load_factor") / nonzero(AGE)}
    return condition_grid(I.cleaned(spark, d), [AGE] + _MEAN_HELD, "mean", derived=derived)


# ----------------------------------------------------------------------------- fits with a closed answer

_CELL_METRICS = (f"count(*) AS n, {R('sqrt(avg((efficiency - m) ** 2))', 'rmse')}, {R('avg(abs(efficiency - m))', 'mae')}, "
                 f"{R('1 - sum((efficiency - m) ** 2) / (var_pop(efficiency) * count(*))', 'r2')}")


@register("tree_to_the_end", with_clean(
    f"SELECT {R('load_factor', LOAD)}, {_CELL_METRICS} FROM (SELECT load_factor, efficiency, "
    "avg(efficiency) OVER (PARTITION BY load_factor, filter_age_days) AS m FROM clean) GROUP BY 1"))
def q_tree_to_the_end(spark, d):
    """M2: one tree without a limit of depth ends in the (load, age) cells, whose means it predicts."""
    data = M.assembled(M.labelled(I.cleaned(spark, d), EFF), [LOAD, AGE], [LOAD])
    model = M.forest(1, max_bins=64, bootstrap=False).fit(data)
    return regression_metrics(model.transform(data), by=LOAD).select(LOAD, "n", "rmse", "mae", "r2")


@register("boosted_group_means", with_clean(
    f"SELECT {R('load_factor', LOAD)}, {R('avg(efficiency)', 'prediction')} FROM clean GROUP BY 1"))
def q_boosted_group_means(spark, d):
    """M3: the first round's tree gives the mean of every load, so later rounds find nothing left."""
    data = M.assembled(M.labelled(I.cleaned(spark, d), EFF), [LOAD], [LOAD])
    model = M.gbt(3, 8).fit(data)
    return model.transform(data).groupBy(LOAD).agg(F.max("prediction").alias("prediction"))


@register("voting_linear", _kc(
    f", s AS (SELECT *, {_HASH_SQL} % 5 < 1 AS test FROM clean), "
    "a AS (SELECT regr_slope(efficiency, filter_age_days) AS b, regr_intercept(efficiency, filter_age_days) AS c FROM s WHERE NOT test), "
    "l AS (SELECT regr_slope(efficiency, load_factor) AS b, regr_intercept(efficiency, load_factor) AS c FROM s WHERE NOT test), "
    "p AS (SELECT efficiency, (a.c + a.b * filter_age_days + l.c + l.b * load_factor) / 2 AS m FROM s, a, l WHERE test) "
    f"SELECT {_CELL_METRICS} FROM p"))
def q_voting_linear(spark, d):
    """The mean of two one-feature lines."""
    train, test = split.hash_split(M.labelled(I.cleaned(spark, d, keyed=True), EFF), KEY)
    model = ensembles.fit_voting(train, {c: lambda c=c: M.pipeline([c], M.linear(), scale=None) for c in (AGE, LOAD)})
    return regression_metrics(model.transform(test)).select("n", "rmse", "mae", "r2")


@register("cv_summary_linear", _keyed_clean_sql() + _FOLD_LINE + f"""
, m AS (SELECT f.filter_class, f.fold, sqrt(avg((y - a - b * x) ** 2)) AS rmse, 1 - sum((y - a - b * x) ** 2) / (var_pop(y) * count(*)) AS r2
      FROM f JOIN line USING (filter_class, fold) GROUP BY 1, 2)
SELECT filter_class, {R('avg(rmse)', 'rmse_mean')}, {R('stddev_samp(rmse)', 'rmse_std')}, {R('avg(r2)', 'r2_mean')}, {R('stddev_samp(r2)', 'r2_std')}
FROM m GROUP BY 1""")
def q_cv_summary_linear(spark, d):
    """Mean and std over hashed folds."""
    return A.cv_summary(gram.cross_validated(_folded(spark, d), [AGE], EFF, CLASS)[1], ["rmse", "r2"], [CLASS])


@register("cv_unshuffled_two_sigma", _keyed_clean_sql() + f"""
, f AS (SELECT filter_class, filter_age_days AS x, efficiency AS y, ntile(5) OVER (PARTITION BY filter_class ORDER BY {', '.join(_ROW_ORDER)}) - 1 AS fold FROM clean),
k AS (SELECT DISTINCT filter_class, fold FROM f),
line AS (SELECT k.filter_class, k.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a
         FROM k JOIN f ON f.filter_class = k.filter_class AND f.fold <> k.fold GROUP BY 1, 2),
m AS (SELECT f.filter_class, f.fold, 1 - sum((y - a - b * x) ** 2) / (var_pop(y) * count(*)) AS r2 FROM f JOIN line USING (filter_class, fold) GROUP BY 1, 2)
SELECT filter_class, {R('avg(r2)', 'r2_mean')}, {R('2 * stddev_pop(r2)', 'r2_std')} FROM m GROUP BY 1""")
def q_cv_unshuffled(spark, d):
    """Folds are stretches of the row order; mean and two standard deviations of R^2."""
    data = split.with_ordered_folds(I.cleaned(spark, d, keyed=True), _ROW_ORDER, by=CLASS)
    return A.cv_summary(gram.cross_validated(data, [AGE], EFF, CLASS)[1], ["r2"], [CLASS], two_sigma=True)


@register("pca_two_columns", with_clean(
    "SELECT CAST(1 AS BIGINT) AS component, " + R("(1 + abs(r)) / 2", "explained_variance_ratio") + f", {R('(1 + abs(r)) / 2', 'cumulative')} FROM c "
    "UNION ALL SELECT 2, " + R("(1 - abs(r)) / 2", "explained_variance_ratio") + ", 1.0 FROM c",
    ", c AS (SELECT corr(pressure_drop_pa, outlet_pm25) AS r FROM clean)"))
def q_pca_two(spark, d):
    """The eigenvalues of two standardised columns are 1 +- r."""
    return pca.pca(I.cleaned(spark, d), [PRESSURE, OUT25])


@register("pca_two_projected", with_clean(
    f"SELECT filter_class, {R('avg((z1 * z1 + z2 * z2 + 2 * sign(r) * z1 * z2) / 2)', 'pc1_spread')}, "
    f"{R('avg((z1 * z1 + z2 * z2 - 2 * sign(r) * z1 * z2) / 2)', 'pc2_spread')} FROM z GROUP BY 1",
    ", c AS (SELECT corr(pressure_drop_pa, outlet_pm25) AS r, avg(pressure_drop_pa) AS m1, stddev_pop(pressure_drop_pa) AS s1, "
    "avg(outlet_pm25) AS m2, stddev_pop(outlet_pm25) AS s2 FROM clean), "
    "z AS (SELECT filter_class, r, (pressure_drop_pa - m1) / s1 AS z1, (outlet_pm25 - m2) / s2 AS z2 FROM clean, c)"))
def q_pca_two_projected(spark, d):
    """Mean squared place of each class's rows on both components (the sign of a component is free)."""
    pcs = pca.pca_project(I.cleaned(spark, d), [PRESSURE, OUT25], 2, [CLASS])
    return pcs.groupBy(CLASS).agg(*[F.avg(F.col(c) * F.col(c)).alias(f"{c.lower()}_spread") for c in ("PC1", "PC2")])


@register("anova_three_groups", with_clean(
    f"SELECT {R('f', 'f_statistic')}, {R('power(1 + 2 * f / d2, -d2 / 2.0)', 'p_value')} FROM (SELECT d2, (sb / 2) / (sw / d2) AS f FROM "
    "(SELECT sum(n) - 3 AS d2, sum(n * (m - g) ** 2) AS sb, sum((n - 1) * v) AS sw FROM (SELECT count(*) AS n, avg(efficiency) AS m, "
    "var_samp(efficiency) AS v FROM clean GROUP BY location), (SELECT avg(efficiency) AS g FROM clean)))"))
def q_anova_three(spark, d):
    """With three groups the tail of F has a closed form."""
    return X.anova(I.cleaned(spark, d), "location", EFF).select("f_statistic", "p_value")
