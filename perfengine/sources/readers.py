"""Sources: readings files with an explicit schema, and the readings view over the driver tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfengine.schema import READINGS_SCHEMA
from perfengine.session import ensure_checkpoint_dir

#: Parts (of about 55 bytes in a hash table) up to this many are broadcast; with more the join shuffles.
BROADCAST_PARTS = 500_000


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Turn NaN into NULL in floating columns, once, at ingest (pandas treats both as missing)."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = [c for c in (cols or df.columns) if c in floats]
    if not targets:
        return df
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(T.DoubleType())) for c in targets})


def read_readings(spark: SparkSession, path: str, fmt: str = "csv",
                  schema: T.StructType = READINGS_SCHEMA) -> DataFrame:
    """Read a readings table with a declared schema (no inference pass over the data).

    CSV timestamps are parsed by the schema; parquet is read as stored and
    projected onto the schema's columns.
    """
    if fmt == "csv":
        df = (spark.read.schema(schema).option("header", True)
              .option("timestampNTZFormat", "yyyy-MM-dd[ HH:mm:ss[.SSSSSS]]")
              .option("mode", "PERMISSIVE").csv(path))
    elif fmt == "parquet":
        df = spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    else:
        df = spark.read.format(fmt).schema(schema).load(path)
    return nan_to_null(df)


BAD = "_bad_line"


def read_readings_checked(spark: SparkSession, path: str, schema: T.StructType = READINGS_SCHEMA) -> DataFrame:
    """CSV readings with one more column ``_bad_line``: the whole line where a field can't be read as its type or the
    line has more or fewer fields than the schema, else NULL (S1).

    Fields of a bad line that can be read keep their values. Lines are parsed whole whatever is selected later (the
    file reader would only parse, and judge, the selected columns). Lines that are the schema's names, the header of each
    file, and empty lines are skipped; any other header is a bad line.
    """
    wide = T.StructType([*schema.fields, T.StructField(BAD, T.StringType(), True)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "timestampNTZFormat": "yyyy-MM-dd['T'][ ][HH:mm:ss[.SSSSSS][.SSS]]"}
    lines = spark.read.text(path).where(~F.col("value").isin(",".join(f.name for f in schema.fields), ""))
    return nan_to_null(lines.select(F.from_csv("value", wide.simpleString()[len("struct<"):-1].replace(":", " "), options).alias("_r")).select("_r.*"))


def good_rows(checked: DataFrame) -> DataFrame:
    """The rows read whole, without the ``_bad_line`` column."""
    return checked.where(F.col(BAD).isNull()).drop(BAD)


def ingest_report(checked: DataFrame, by: str, aggs: dict | None = None) -> DataFrame:
    """Good and bad lines per ``by`` (NULL where a bad line has none), and ``aggs`` over the good rows, in one pass."""
    good = F.col(BAD).isNull()
    kept = checked.select(by, BAD, *[F.when(good, F.col(c)).alias(c) for c in checked.columns if c not in (by, BAD)])
    return kept.groupBy(by).agg(F.count(F.when(good, 1)).alias("good_rows"), F.count(F.when(~good, 1)).alias("bad_rows"),
                                *[e.alias(n) for n, e in (aggs or {}).items()])


def read_table(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None) -> DataFrame:
    """Read back any result table written by a sink (S3)."""
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", True)
    return reader.format(fmt).load(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stamp(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    return path, status.getModificationTime(), status.getLen()


def _typed(spark: SparkSession, sf_dir: str, li: DataFrame, part: DataFrame) -> DataFrame:
    """Line items with the type of their part."""
    on = li.l_partkey == part.p_partkey
    if part.count() <= BROADCAST_PARTS:
        return li.join(part, on)
    stamp = (spark.sparkContext.applicationId, *[_stamp(spark, f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part")])
    folder = f"{ensure_checkpoint_dir(spark)}/readings-{hashlib.md5(repr(stamp).encode()).hexdigest()}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        li.join(part.hint("shuffle_hash"), on).drop("p_partkey").write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def readings_from_tables(spark: SparkSession, sf_dir: str, with_key: bool = False) -> DataFrame:
    """Readings view over the driver's lineitem and part tables.

    One reading per line item; the class is the part type and the location
    the return flag. ``+ 0.0`` folds negative zeros. ``with_key`` adds a
    text key from integer columns (order, part, line number) for hash splits. Part is pruned to two columns;
    up to ``BROADCAST_PARTS`` rows the join is left to Catalyst/AQE. Beyond it nothing is broadcast: the join
    shuffles once, and its rows are written next to the checkpoints for all later passes.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    key = [F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("reading_key")] if with_key else []
    rows = _typed(spark, sf_dir, li, part)
    return rows.select(
        F.col("p_type").alias("filter_class"),
        F.col("l_returnflag").alias("location"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_quantity").alias("filter_age_days"),
        (tax * 10 + 0.0).alias("load_factor"),
        (price / 1000).alias("pressure_drop_pa"),
        (1 - disc).alias("efficiency"),
        price.alias("inlet_pm25"),
        (price * disc + 0.0).alias("outlet_pm25"),
        (price * (1 + tax)).alias("inlet_pm10"),
        (price * (1 + tax) * disc + 0.0).alias("outlet_pm10"),
        *key,
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second input: time-of-day and row-order queries use ``events`` (class = event_type)."""
    return table(spark, sf_dir, "events")
