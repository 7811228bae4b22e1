"""Every registered query with an oracle agrees with DuckDB on sf0.001 (numeric tolerance)."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _key(v):
    if isinstance(v, float):
        return f"{round(v, 6) + 0.0:.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_key(x) for x in v) + "]"
    return str(v)


def _same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is None and b is None
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(_same(x, y) for x, y in zip(a, b))
    if isinstance(a, dt.datetime) and isinstance(b, dt.datetime):
        return a.replace(tzinfo=None) == b.replace(tzinfo=None)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    res = con.sql(ORACLE[name])
    dcols = res.columns
    drows = res.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    order = sorted(range(len(scols)), key=lambda i: scols[i])
    dorder = [dcols.index(scols[i]) for i in order]
    s = sorted(([r[i] for i in order] for r in srows), key=lambda r: [_key(v) for v in r])
    d = sorted(([r[i] for i in dorder] for r in drows), key=lambda r: [_key(v) for v in r])
    bad = [(x, y) for x, y in zip(s, d) if not all(_same(p, q) for p, q in zip(x, y))]
    assert not bad, bad[:3]
