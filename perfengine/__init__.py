"""perfengine: equipment-performance analytics as Spark DataFrame operators.

Entry points:

* ``perfengine.sources.readers`` - read readings (CSV / parquet, declared schema)
* ``perfengine.operators.clean.clean`` - NULL drop + sequential exact IQR filter
* ``perfengine.plans.class_report.class_report`` - the per-class report
* ``perfengine.operators`` / ``perfengine.functions`` - statistics, windows, curves, features
* ``perfengine.ml`` - Spark ML models, evaluation, selection, ensembles, forecasts
* ``perfengine.streaming.monitor`` - streaming KPIs
* ``perfengine.plans.catalog`` - the registered queries and their SQL oracles
"""

__version__ = "0.1.0"
