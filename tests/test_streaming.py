"""The streaming KPI table equals the batch aggregate over the same rows."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from perfengine.streaming.monitor import class_window_kpis, readings_stream, run_to_table


def test_stream_matches_batch(spark, tmp_path):
    streamed = run_to_table(spark, SF_SMALL, str(tmp_path / "kpi"))
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    part = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    batch_rows = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("p_type").alias("filter_class"), F.col("l_shipdate").alias("timestamp"),
        (F.col("l_tax") * 10 + 0.0).alias("load_factor"), (F.col("l_extendedprice") / 1000).alias("pressure_drop_pa"),
        (1 - F.col("l_discount")).alias("efficiency"))
    batch = class_window_kpis(batch_rows).select(F.col("w.start").alias("ws"), "filter_class", "n", "efficiency_mean")
    s = {(r["window_start"], r["filter_class"]): (r["n"], r["efficiency_mean"]) for r in streamed.collect()}
    b = {(r["ws"].replace(tzinfo=None), r["filter_class"]): (r["n"], r["efficiency_mean"]) for r in batch.collect()}
    assert s.keys() == b.keys()
    assert all(s[k][0] == b[k][0] and abs(s[k][1] - b[k][1]) < 1e-12 for k in s)
    assert readings_stream(spark, SF_SMALL).isStreaming
