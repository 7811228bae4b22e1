"""Building blocks of the DuckDB oracle SQL (independent re-statement of each query).

The SQL runs on the driver's pre-registered views (lineitem, part, events ...).
"""

from __future__ import annotations

from perfengine.schema import NUMERIC_COLS

READINGS_SQL = """SELECT p_type AS filter_class, l_returnflag AS location, l_shipdate AS timestamp,
       l_quantity AS filter_age_days, l_tax * 10 + 0.0 AS load_factor,
       l_extendedprice / 1000 AS pressure_drop_pa, 1 - l_discount AS efficiency,
       l_extendedprice AS inlet_pm25, l_extendedprice * l_discount + 0.0 AS outlet_pm25,
       l_extendedprice * (1 + l_tax) AS inlet_pm10,
       l_extendedprice * (1 + l_tax) * l_discount + 0.0 AS outlet_pm10
FROM lineitem JOIN part ON l_partkey = p_partkey"""


def cleaned_ctes(k: float = 1.5) -> str:
    """``WITH`` list ending in ``clean``: NULL drop, then the eight dependent IQR fences."""
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in
                           ["filter_class", "location", "timestamp"] + NUMERIC_COLS)
    parts = [f"raw AS ({READINGS_SQL})", f"r0 AS (SELECT * FROM raw WHERE {notnull})"]
    for i, c in enumerate(NUMERIC_COLS, 1):
        parts.append(f"b{i} AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM r{i - 1})")
        parts.append(f"r{i} AS (SELECT r{i - 1}.* FROM r{i - 1}, b{i} "
                     f"WHERE {c} >= q1 - {k} * (q3 - q1) AND {c} <= q3 + {k} * (q3 - q1))")
    parts.append(f"clean AS (SELECT * FROM r{len(NUMERIC_COLS)})")
    return "WITH " + ",\n".join(parts)


def R(expr: str, alias: str, digits: int = 6) -> str:
    """Rounded double output column (same rounding as the Spark side)."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) AS {alias}"


def B(expr: str, alias: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {alias}"


def with_clean(body: str, extra: str = "") -> str:
    """SQL over the cleaned readings; ``extra`` adds further CTEs (starting with a comma)."""
    return f"{cleaned_ctes()}{extra}\n{body}"


def with_raw(body: str, extra: str = "") -> str:
    return f"WITH raw AS ({READINGS_SQL}){extra}\n{body}"
