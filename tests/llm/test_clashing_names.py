"""Extra columns named like the operators' own come through the stages unchanged."""

from pyspark.sql import functions as F

from perfengine.llm import common, op1_mixing, op8_neardup

TEXT = " ".join(f"word{i}" for i in range(60))
ROWS = [(0, TEXT, "a"), (1, TEXT, "a"), (2, TEXT[::-1], "b"), (2, TEXT[::-1], "b"), (None, None, None), (5, "", "b")]


def table(spark, names):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.withColumns({n: F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id"), F.lit(-1))) for n in names})


def kept(df, names):
    rows = df.collect()
    assert all(r[n] == f"{n}:{-1 if r.doc_id is None else r.doc_id}" for r in rows for n in names)
    return sorted((-1 if r.doc_id is None else r.doc_id) for r in rows)


def test_mixing(spark):
    names = [*sorted(op1_mixing.NAMES), "_Rate_in", "rate"]
    plain, extra = (op1_mixing.mix_stage(spark, table(spark, n), "") for n in ([], names))
    assert extra.columns == ["doc_id", "text", "source", *names] and kept(extra, names) == kept(plain, [])
    out = op1_mixing.mix(table(spark, ["_rate", "_COPY"]))
    assert {"_rate", "_rate_in", "_copy", "_COPY_in"} <= set(out.columns)


def test_near_duplicates(spark):
    names = ["_id", "_row", "_Digest", "_of", "_root", "root", "component_id"]
    plain, extra = (op8_neardup.dedup_stage(spark, table(spark, n), "") for n in ([], names))
    assert extra.columns == ["doc_id", "text", "source", *names]
    assert kept(extra, names) == kept(plain, []) == [-1, 0, 2, 5]


def test_names_are_restored(spark):
    df = table(spark, ["_id", "_id_in", "_ID_in_"][:2])
    apart, own = common.set_aside(df, {"_ID"})
    assert "_id" not in apart.columns and apart.select(*own).columns == df.columns
