"""Regression metrics as plain aggregates over (y, prediction) (M11, M12), group-able."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(pred: DataFrame, y: str = "label", yhat: str = "prediction",
                       by: list[str] | str | None = None) -> DataFrame:
    """RMSE, MAE, R^2, MAPE (%) and explained variance ``1 - var_pop(res) / var_pop(y)``
    in ONE aggregate; ``by`` groups (class, model, fold ...)."""
    keys = [by] if isinstance(by, str) else list(by or [])
    res = F.col(y) - F.col(yhat)
    g = pred.groupBy(*keys) if keys else pred.groupBy()
    return g.agg(
        F.sqrt(F.avg(res * res)).alias("rmse"),
        F.avg(F.abs(res)).alias("mae"),
        (1 - F.try_divide(F.sum(res * res), F.var_pop(y) * F.count(y))).alias("r2"),
        (F.avg(F.abs(F.try_divide(res, F.col(y)))) * 100).alias("mape"),
        (1 - F.try_divide(F.var_pop(res), F.var_pop(y))).alias("explained_variance"),
        F.count(F.lit(1)).alias("n"),
    )
