import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from perfengine.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8, app="perfengine-tests")
    yield s
    s.stop()


def readings_rows(spark, rows, cols=None):
    """Small hand-written readings table (FIXTURES section 4)."""
    from perfengine.schema import READINGS_SCHEMA
    import datetime as dt
    default = {"timestamp": dt.datetime(2024, 1, 1, 12), "filter_class": "A", "location": "L1",
               "filter_age_days": 1.0, "load_factor": 0.5, "pressure_drop_pa": 50.0, "efficiency": 0.9,
               "inlet_pm25": 10.0, "outlet_pm25": 1.0, "inlet_pm10": 20.0, "outlet_pm10": 2.0}
    data = []
    for r in rows:
        d = dict(default)
        d.update(r)
        data.append(tuple(d[f.name] for f in READINGS_SCHEMA.fields))
    return spark.createDataFrame(data, READINGS_SCHEMA)
