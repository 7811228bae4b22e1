"""Sinks: tables, per-class files, text summaries and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write a table (S4/S5/S9); keys stay ordinary columns, CSV gets a header."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def write_by_class(df: DataFrame, path: str, by: str = "filter_class", fmt: str = "csv",
                   mode: str = "overwrite", max_rows: int = 0) -> None:
    """One folder per class (S6): ``partitionBy`` instead of a driver loop.

    Rows are rebalanced by the class: small classes share tasks, and a class above the advisory partition size
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``) is split over as many tasks as it needs, so a hot
    class is never one task. ``max_rows`` bounds the rows of a file (0: no bound).
    """
    w = df.hint("rebalance", F.col(by)).write.mode(mode).partitionBy(by).format(fmt).option("maxRecordsPerFile", max_rows)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def summary_lines(df: DataFrame, template: str, cols: list[str], order: list[str] | None = None) -> DataFrame:
    """Format each result row into one text line (S7): ``format_string`` on the executors."""
    out = df.select(F.format_string(template, *[F.col(c) for c in cols]).alias("value"), *(order or []))
    return out.orderBy(*order).select("value") if order else out


def write_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a one-column string table as text lines (one part file per task)."""
    df.write.mode(mode).text(path)


def report_json(df: DataFrame, key_cols: list[str], sections: dict[str, list[str]]) -> DataFrame:
    """Nested JSON report per key (S8): one struct per chosen section, ``to_json`` per row."""
    structs = [F.struct(*[F.col(c) for c in cols]).alias(name) for name, cols in sections.items()]
    return df.select(*key_cols, F.to_json(F.struct(F.struct(*structs).alias("Sections"))).alias("report"))
