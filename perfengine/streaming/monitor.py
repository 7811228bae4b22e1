"""Structured Streaming form of the dashboard KPIs (the "real-time monitoring" view).

New reading files arriving in a folder are aggregated incrementally: per event-time
window and class, count and mean / std / min / max of efficiency, mean pressure and
load. The same aggregate functions as the batch operators, so a stream over a
folder gives the batch answer once all files are processed. State is bounded by
the watermark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from perfengine.schema import CLASS, EFF, LOAD, PRESSURE, TS
from perfengine.session import ensure_checkpoint_dir


def class_window_kpis(readings: DataFrame, window: str = "30 days", watermark: str = "30 days",
                      by: str = CLASS, ts: str = TS) -> DataFrame:
    """Windowed per-class KPIs; works on a batch or a streaming DataFrame.

    The state is one partial aggregate per (window, class); the watermark lets
    Spark drop windows older than ``watermark`` behind the latest event.
    """
    d = readings.withColumn("_et", F.col(ts).cast(T.TimestampType()))
    if d.isStreaming:
        d = d.withWatermark("_et", watermark)
    return d.groupBy(F.window("_et", window).alias("w"), by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(EFF).alias("efficiency_mean"),
        F.stddev_samp(EFF).alias("efficiency_std"), F.min(EFF).alias("efficiency_min"),
        F.max(EFF).alias("efficiency_max"), F.avg(PRESSURE).alias("pressure_mean"),
        F.avg(LOAD).alias("load_mean"))


def start(spark: SparkSession, stream: DataFrame, table_path: str, mode: str = "complete",
          checkpoint: str | None = None) -> StreamingQuery:
    """Run the KPI stream; each trigger overwrites the KPI table at ``table_path`` (parquet).

    ``foreachBatch`` writes from the executors; nothing is kept on the driver.
    """
    cp = checkpoint or f"{table_path}_checkpoint"

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(table_path)

    return (class_window_kpis(stream).writeStream.outputMode(mode).foreachBatch(write)
            .option("checkpointLocation", cp).trigger(availableNow=True).start())


def readings_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as a stream: new line-item files of the folder, joined to the (static) part table."""
    li_schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    li = (spark.readStream.schema(li_schema).option("pathGlobFilter", "lineitem*.parquet")
          .option("maxFilesPerTrigger", 1).parquet(sf_dir))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type")
    price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("p_type").alias(CLASS), F.col("l_shipdate").alias(TS), (tax * 10 + 0.0).alias(LOAD),
        (price / 1000).alias(PRESSURE), (1 - disc).alias(EFF))


def run_to_table(spark: SparkSession, sf_dir: str, table_path: str | None = None) -> DataFrame:
    """Process every available file, then read back the maintained KPI table."""
    path = table_path or f"{ensure_checkpoint_dir(spark)}/kpi-{uuid.uuid4().hex}"
    q = start(spark, readings_stream(spark, sf_dir), path)
    q.awaitTermination()
    return (spark.read.parquet(path)
            .select(F.col("w.start").cast(T.TimestampNTZType()).alias("window_start"), "*").drop("w"))
