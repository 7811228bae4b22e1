"""CSV ingest with bad lines, and the writer's handling of a hot class."""

import glob

import pytest
from pyspark.sql import functions as F

from perfengine.schema import READINGS_SCHEMA
from perfengine.sources import readers as RD
from perfengine.sources import sinks as SK

HEAD = ",".join(f.name for f in READINGS_SCHEMA.fields)
GOOD = "2024-01-01 12:00:00,A,L1,1.0,0.5,50.0,0.9,10.0,1.0,20.0,2.0"


def test_bad_lines_are_kept_and_counted(spark, tmp_path):
    lines = [HEAD, GOOD, GOOD.replace("50.0", "fifty"), "2024-01-01,A", GOOD + ",more", GOOD.replace(",A,", ",B,"), GOOD.replace("2024-01-01 12:00:00", "2024-01-01"),
             GOOD.replace("1.0,0.5", ",0.5"), "yesterday" + GOOD[19:]]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text(HEAD + "\n" + GOOD + "\n")
    checked = RD.read_readings_checked(spark, str(tmp_path))
    bad = sorted(r[0] for r in checked.select(RD.BAD, "efficiency").where(F.col(RD.BAD).isNotNull()).collect())
    assert bad == sorted([lines[2], lines[3], lines[4], lines[8]])
    got = {r.filter_class: (r.good_rows, r.bad_rows, r.m) for r in RD.ingest_report(checked, "filter_class", {"m": F.avg("pressure_drop_pa")}).collect()}
    assert got == {"A": (4, 4, 50.0), "B": (1, 0, 50.0)}
    assert RD.good_rows(checked).count() == 5 and RD.BAD not in RD.good_rows(checked).columns
    # an empty field is missing, not bad; a line is judged by all its fields even where one column is read
    assert checked.select("location", RD.BAD).where(F.col(RD.BAD).isNotNull()).count() == 4
    assert RD.good_rows(checked).where(F.col("filter_age_days").isNull()).count() == 1


def test_hot_class_goes_through_many_tasks(spark, tmp_path):
    df = spark.range(200_000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("c"), F.col("id") % 7)).otherwise("hot").alias("filter_class"),
                                     F.md5(F.col("id").cast("string")).alias("v")).repartition(8)
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        SK.write_by_class(df, str(tmp_path / "o"), fmt="parquet")
    finally:
        if old is None:
            spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        else:
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(glob.glob(str(tmp_path / "o" / "filter_class=hot" / "*.parquet"))) >= 4
    back = spark.read.parquet(str(tmp_path / "o"))
    assert back.count() == 200_000 and back.select("v").distinct().count() == 200_000


def test_rows_of_a_file_are_bounded(spark, tmp_path):
    df = spark.range(1000).select(F.lit("a").alias("filter_class"), "id").coalesce(1)
    SK.write_by_class(df, str(tmp_path / "o"), fmt="parquet", max_rows=100)
    assert len(glob.glob(str(tmp_path / "o" / "filter_class=a" / "*.parquet"))) >= 10


def test_many_parts_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Beyond the bound the same rows come from one shuffled join, written once; repeated and null keys are kept as by the plain join."""
    import datetime as dt
    from perfengine.sources import readers

    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(i, i % 7 if i % 5 else None, i % 3, 1.0 * i, 10.0 + i, 0.1, 0.05, "A", at) for i in range(60)],
                          "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i % 6 if i < 8 else None, f"T{i}") for i in range(10)],
                          "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    plain = sorted(readers.readings_from_tables(spark, str(tmp_path), True).collect())
    monkeypatch.setattr(readers, "BROADCAST_PARTS", 3)
    for _ in range(2):
        df = readers.readings_from_tables(spark, str(tmp_path), True)
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(df.collect()) == plain and len(plain) > 40


@pytest.mark.parametrize("name", ["density", "linear_cv_metrics"])
def test_readings_queries_send_no_part_table(spark, tmp_path, monkeypatch, name):
    """Beyond the bound no pass over the cleaned readings broadcasts the parts, and the query's rows stay the same."""
    import datetime as dt
    from perfengine.plans import catalog, inputs
    from perfengine.sources import readers

    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(i, i % 6, i % 3, 1.0 * (i * 7 % 31), 10.0 + i * 11 % 17, (i * 5 % 13) / 100, 0.01 * (i % 4 + 1), "A", at) for i in range(240)],
                          "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"T{i % 2}") for i in range(6)], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")

    def rows():
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in catalog.all_queries()[name](spark, str(tmp_path)).collect())

    def plan():
        return inputs.cleaned(spark, str(tmp_path), keyed=True)._jdf.queryExecution().executedPlan().toString()

    joined = rows()
    assert "Broadcast" in plan() and len(joined) >= 10
    monkeypatch.setattr(readers, "BROADCAST_PARTS", 3)
    assert "Broadcast" not in plan() and rows() == joined
