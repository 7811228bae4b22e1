"""Schemas, column lists and fixed values of the readings data model."""

from __future__ import annotations

from pyspark.sql import types as T

CLASS = "filter_class"
LOCATION = "location"
TS = "timestamp"
AGE = "filter_age_days"
LOAD = "load_factor"
PRESSURE = "pressure_drop_pa"
EFF = "efficiency"
IN25, OUT25, IN10, OUT10 = "inlet_pm25", "outlet_pm25", "inlet_pm10", "outlet_pm10"

READINGS_SCHEMA = T.StructType(
    [
        T.StructField(TS, T.TimestampNTZType(), True),
        T.StructField(CLASS, T.StringType(), True),
        T.StructField(LOCATION, T.StringType(), True),
        T.StructField(AGE, T.DoubleType(), True),
        T.StructField(LOAD, T.DoubleType(), True),
        T.StructField(PRESSURE, T.DoubleType(), True),
        T.StructField(EFF, T.DoubleType(), True),
        T.StructField(IN25, T.DoubleType(), True),
        T.StructField(OUT25, T.DoubleType(), True),
        T.StructField(IN10, T.DoubleType(), True),
        T.StructField(OUT10, T.DoubleType(), True),
    ]
)

# --- Fixed values (must equal the reference's for equal results) -------------
# Columns fenced by the sequential IQR cleaning, in this order.
NUMERIC_COLS = [AGE, LOAD, PRESSURE, EFF, IN25, OUT25, IN10, OUT10]
# Columns of the six-column correlation heatmap / matrix.
HEATMAP_COLS = [EFF, AGE, LOAD, PRESSURE, IN25, IN10]
# Relative filter cost per replacement.
FILTER_COSTS = {"HEPA": 100.0, "Activated Carbon": 80.0, "Electrostatic": 70.0, "Pre-Filter": 30.0}
# Age bands (right-closed edges) and their labels.
AGE_EDGES = [0.0, 7.0, 14.0, 21.0, 28.0, float("inf")]
AGE_LABELS = ["0-7 days", "7-14 days", "14-21 days", "21-28 days", "28+ days"]
# Quartile band labels.
QUARTILE_LABELS = ["Low", "Medium", "High", "Very High"]
# Gauge steps.
GAUGE_EDGES = [0.7, 0.9]
# Reference conditions for the forecast grid.
GRID_AGES = 60
GRID_HOUR, GRID_WEEKDAY, GRID_MONTH = 12, 3, 6
REPLACE_FRACTION = 0.95
# Feature lists of the model variants.
FEATURES_GUARDED = [AGE, LOAD, PRESSURE, IN25, IN10, "hour", "day_of_week", "month",
                    "pm_ratio", "pressure_efficiency_ratio", "load_age_ratio"]
FEATURES_GUARDED_WEEKEND = FEATURES_GUARDED + ["is_weekend"]
FEATURES_INTERACTION = [AGE, LOAD, PRESSURE, IN25, IN10, "hour", "day_of_week", "month",
                        "is_weekend", "pressure_load_interaction", "age_load_interaction",
                        "pm_ratio", "pressure_efficiency"]
FEATURES_PLAIN = [AGE, LOAD, PRESSURE, IN25, IN10, "hour", "day_of_week", "month", "pm_ratio"]
FEATURES_BASIC = [AGE, LOAD, PRESSURE, IN25, IN10, "hour"]
FEATURES_REMOVAL = [AGE, LOAD, PRESSURE, IN25, IN10, "hour", "day_of_week", "month",
                    "pm_ratio", "pressure_efficiency_ratio", "load_age_ratio",
                    "pm25_removal_efficiency", "pm10_removal_efficiency"]
PARALLEL_COLS = [EFF, AGE, LOAD, PRESSURE, IN25, IN10,
                 "efficiency_to_pressure", "pm_removal_ratio", "load_efficiency"]
PCA_PROJECT_COLS = [EFF, PRESSURE, LOAD, IN25, IN10, "pm25_removal_rate",
                    "pm10_removal_rate", "performance_index"]
