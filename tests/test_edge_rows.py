"""Hand-written edge rows (FIXTURES section 4) against the cleaning, feature and statistics operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from conftest import readings_rows
from perfengine.functions import columns as C
from perfengine.functions.features import with_features, with_time_parts, with_weekend
from perfengine.operators import aggregates as A
from perfengine.operators import clean as P
from perfengine.operators import correlation as X
from perfengine.operators import scaling as S
from perfengine.operators import windows as W
from perfengine.operators.joins import cost_table
from perfengine.plans.class_report import class_report
from perfengine.sources.readers import read_readings


def test_nan_becomes_null_and_incomplete_rows_drop(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text(
        "timestamp,filter_class,location,filter_age_days,load_factor,pressure_drop_pa,efficiency,"
        "inlet_pm25,outlet_pm25,inlet_pm10,outlet_pm10\n"
        "2024-01-01 10:00:00,HEPA,L1,1.5,0.2,100,0.95,10,1,20,2\n"
        "2024-01-01 11:00:00,HEPA,L1,NaN,0.2,100,0.95,10,1,20,2\n"
        "2024-01-01 12:00:00,HEPA,L1,2.0,,100,0.95,10,1,20,2\n")
    df = read_readings(spark, str(p))
    assert df.where(F.col("filter_age_days").isNull()).count() == 1  # NaN -> NULL
    assert P.drop_incomplete(df).count() == 1
    assert df.schema["timestamp"].dataType.typeName() == "timestamp_ntz"


def test_guarded_and_unguarded_ratios(spark):
    df = readings_rows(spark, [{"inlet_pm10": 0.0, "pressure_drop_pa": 0.0, "filter_age_days": 0.0}])
    r = df.select(C.guarded_ratio("inlet_pm25", "inlet_pm10").alias("g1"),
                  C.guarded_ratio("efficiency", "pressure_drop_pa").alias("g2"),
                  C.guarded_ratio("load_factor", "filter_age_days", "load_factor").alias("g3"),
                  C.ratio("efficiency", "pressure_drop_pa").alias("u"),
                  C.ratio("load_factor", "filter_age_days").alias("load_rate"),
                  C.age_band("filter_age_days").alias("band")).first()
    assert r["g1"] == 0 and r["g2"] == 0 and r["g3"] == 0.5
    assert r["u"] is None and r["load_rate"] is None and r["band"] is None


def test_age_bands_are_right_closed(spark):
    df = readings_rows(spark, [{"filter_age_days": a} for a in [7.0, 14.0, 21.0, 28.0, 28.5, 0.5]])
    got = [r[0] for r in df.select(C.age_band("filter_age_days")).collect()]
    assert got == ["0-7 days", "7-14 days", "14-21 days", "21-28 days", "28+ days", "0-7 days"]


def test_iqr_bound_is_inclusive_and_sequential(spark):
    # quartiles 2 / 4 -> fences -1 / 7: the 7.0 row sits exactly on the upper bound and stays
    vals = [2.0] * 4 + [4.0] * 4 + [7.0]
    df = readings_rows(spark, [{"filter_age_days": v} for v in vals])
    kept = P.iqr_filter(df, ["filter_age_days"]).count()
    assert kept == len(vals)
    # an outlier in column 1 shifts the fence of column 2 only in the sequential form
    rows = [{"filter_age_days": 1.0, "load_factor": 0.10}, {"filter_age_days": 1.0, "load_factor": 0.11},
            {"filter_age_days": 1.0, "load_factor": 0.12}, {"filter_age_days": 1.0, "load_factor": 0.13},
            {"filter_age_days": 100.0, "load_factor": 5.0}, {"filter_age_days": 1.0, "load_factor": 0.30}]
    df = readings_rows(spark, rows)
    seq = P.iqr_filter(df, ["filter_age_days", "load_factor"]).count()
    bounds = [P.iqr_bounds(df, [c])[0] for c in ["filter_age_days", "load_factor"]]
    independent = P.apply_bounds(df, bounds).count()
    assert (seq, independent) == (4, 5)


def test_constant_column_degenerates_to_null(spark):
    df = readings_rows(spark, [{"efficiency": 0.9, "filter_age_days": 3.0, "load_factor": x} for x in (0.1, 0.2, 0.3)])
    assert P.iqr_filter(df, ["efficiency"]).count() == 3  # IQR 0 keeps equal values
    r = A.trend(df, None, "filter_age_days", "efficiency").first()
    assert r["slope"] is None
    corr = X.corr_matrix(df, ["efficiency", "load_factor"]).where("i != j").first()
    assert corr["r"] is None
    mm = S.minmax_scale(df, ["efficiency"]).first()["efficiency_normalized"]
    assert mm is None
    st = df.agg(F.stddev_samp("efficiency")).first()[0]
    assert st == 0


def test_replacement_age_falls_back_to_max_age(spark):
    rows = [{"filter_class": "A", "filter_age_days": a, "efficiency": 0.95} for a in (1.0, 2.0, 9.0)]
    rows += [{"filter_class": "B", "filter_age_days": a, "efficiency": e} for a, e in [(1.0, 0.99), (5.0, 0.80), (3.0, 0.90)]]
    rep = {r["filter_class"]: r for r in A.replacement_age(readings_rows(spark, rows)).collect()}
    assert rep["A"]["replacement_age"] == 9.0
    assert rep["B"]["replacement_age"] == 3.0  # 0.90 < 0.95 * 0.99


def test_class_report_keeps_class_without_cost_and_one_row_class(spark):
    rows = [{"filter_class": "X", "filter_age_days": 2.0}, {"filter_class": "HEPA", "filter_age_days": 1.0},
            {"filter_class": "HEPA", "filter_age_days": 2.0, "efficiency": 0.8}]
    rep = {r["filter_class"]: r for r in class_report(readings_rows(spark, rows), cost_table(spark)).collect()}
    assert set(rep) == {"X", "HEPA"}
    assert rep["X"]["cost"] is None and rep["X"]["std_efficiency"] is None and rep["X"]["decline_rate"] is None
    assert rep["HEPA"]["cost_per_day"] == 100.0 / 2.0


def test_quartile_band_ties_share_a_band(spark):
    vals = [0.1, 0.2, 0.2, 0.2, 0.2, 0.3, 0.9, 1.0]
    df = readings_rows(spark, [{"efficiency": v} for v in vals])
    bands = S.quartile_band(df, "efficiency").groupBy("efficiency").agg(F.countDistinct("efficiency_category"))
    assert all(r[1] == 1 for r in bands.collect())


def test_weekday_and_weekend(spark):
    days = [dt.datetime(2024, 1, 6, 9), dt.datetime(2024, 1, 7, 9), dt.datetime(2024, 1, 8, 9)]
    df = with_weekend(with_time_parts(readings_rows(spark, [{"timestamp": d} for d in days])))
    got = [(r["day_of_week"], r["is_weekend"]) for r in df.orderBy("timestamp").collect()]
    assert got == [(5, 1), (6, 1), (0, 0)]


def test_planted_slope_is_recovered(spark):
    rows = [{"filter_age_days": float(a), "efficiency": 0.95 - 0.001 * a} for a in range(50)]
    r = A.trend(readings_rows(spark, rows), None).first()
    assert abs(r["slope"] + 0.001) < 1e-12 and abs(r["intercept"] - 0.95) < 1e-12


def test_forecast_never_below_threshold(spark):
    pred = spark.createDataFrame([("A", a, 0.9) for a in range(60)], "filter_class string, age long, predicted_efficiency double")
    r = W.forecast_replacement(pred).first()
    assert r["replacement_age"] == 60 and r["efficiency_at_replacement"] == 0.9


def test_winsorise_keeps_null(spark):
    df = readings_rows(spark, [{"load_factor": v} for v in [0.1, 0.2, 0.3, 10.0]] + [{"load_factor": None}])
    out = P.winsorise(df, ["load_factor"], 0.01, 0.99)
    assert out.where(F.col("load_factor").isNull()).count() == 1
    assert out.agg(F.max("load_factor")).first()[0] < 10.0


def test_guarded_feature_set_columns(spark):
    df = readings_rows(spark, [{"filter_age_days": float(a)} for a in range(5)])
    out = with_features(df, "guarded")
    for c in ["hour", "day_of_week", "month", "pm_ratio", "pressure_efficiency_ratio", "load_age_ratio"]:
        assert c in out.columns


def test_anova_p_value_closed_form():
    # for d1 = 2 the F survival function is (1 + d1 F / d2) ** (-d2 / 2)
    assert math.isclose(X.f_sf(3.5, 2, 10), (1 + 2 * 3.5 / 10) ** -5, rel_tol=1e-10)
    assert math.isclose(X.f_sf(1.0, 4, 4), 0.5, rel_tol=1e-10)


@pytest.mark.parametrize("f,d2", [(1.0, 6e9), (0.5, 6e11), (40.0, 6e11), (300.0, 1e4), (1e-6, 50.0), (3.0, 1.0)])
def test_f_tail_with_two_degrees_has_the_closed_form(f, d2):
    assert math.isclose(X.f_sf(f, 2, d2), math.exp(-d2 / 2 * math.log1p(2 * f / d2)), rel_tol=1e-10)
