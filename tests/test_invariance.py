"""Positional and running operators give the same answer for any partitioning."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from perfengine.ml.split import with_ordered_folds
from perfengine.operators import windows as W
from perfengine.operators.ordering import running, with_position

ORDER = ["ts", "event_id"]


def _events(spark, parts):
    return spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(parts)


def _run(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        ev = _events(spark, parts)
        pos = {r.event_id: r.pos for r in with_position(ev, ORDER, ["event_type"]).collect()}
        best = {r.event_id: r.running_min for r in running(ev, "value", ORDER, "min").collect()}
        step = W.mean_step(ev, "value", ORDER).first()[0]
        slope = {r[0]: r[1] for r in W.positional_slopes(ev, "value", ORDER, "event_type").collect()}
        folds = {r.event_id: r.fold for r in with_ordered_folds(ev, ORDER).collect()}
        return pos, best, step, slope, folds
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_same_answer_for_1_and_16_partitions(spark):
    a, b = _run(spark, 1), _run(spark, 16)
    assert a[0] == b[0] and a[1] == b[1] and a[4] == b[4]
    assert abs(a[2] - b[2]) < 1e-9
    assert all(abs(a[3][k] - b[3][k]) < 1e-12 for k in a[3])


def test_positions_match_row_number(spark):
    ev = _events(spark, 4)
    from pyspark.sql import Window
    ref = ev.withColumn("rn", F.row_number().over(Window.partitionBy("event_type").orderBy(*ORDER)) - 1)
    got = with_position(ev, ORDER, ["event_type"]).join(ref.select("event_id", "rn"), "event_id")
    assert got.where(F.col("pos") != F.col("rn")).count() == 0


def test_top_n_matches_plain_sort(spark):
    ev = _events(spark, 4)
    top = W.top_k(ev, "value", 5, by="event_type")
    from pyspark.sql import Window
    ref = ev.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value")))) \
        .where("r <= 5")
    a = sorted((r.event_type, r.value) for r in top.collect())
    b = sorted((r.event_type, r.value) for r in ref.collect())
    assert a == b
