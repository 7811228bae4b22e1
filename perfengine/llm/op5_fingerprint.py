"""Document fingerprints by one-permutation MinHash (operator 5), built of SQL functions alone.

Each five-word shingle (A-Z and other capitals lowered, words split at white space) is hashed once; its
top bits name one of ``BINS`` bins, and a bin keeps its smallest hash. An empty bin i takes the value of
the first bin with one along its own probe sequence (a_i * t + b_i) mod BINS, t = 0, 1, ... (optimal
densification: an odd a_i visits every bin once, so the search ends). Of each bin the ``BITS`` lowest
bits of a hash of (value, bin) are stored, so that chance agrees in each bin anew, in short texts too. Two fingerprints agree by chance in 2^-BITS of the bins; likeness corrects for that:
(agreement - 2^-BITS) / (1 - 2^-BITS), held within 0 and 1.

A text of fewer than five words is one shingle; a null or empty text, or one of white space only, has
the fingerprint '' with likeness 1 to another such and 0 to all else. Repeated rows are neighbours of
each other. The neighbour of a document is taken from range buckets of (doc_id, hash of the text), so
only one row a bucket travels twice; null ids come after the smallest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfengine.llm.common import table

WORDS, BINS, BITS = 5, 128, 4
_LOG = BINS.bit_length() - 1
_PER_LONG = 64 // BITS
#: Range buckets for each shuffle partition.
BUCKETS = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _bin(h: Column) -> Column:
    return (F.shiftright(h, 64 - _LOG) + BINS // 2).cast("int")


def _shingles(words: Column) -> Column:
    def of(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WORDS)]))
        return F.when(n >= WORDS, runs).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _densified(values: Column) -> Column:
    """values: BINS entries, null where a bin is empty, one of them not null."""
    def probe(i: Column, begin: int, end: int) -> Column:
        k = (i + 1).cast("bigint")
        a, b = F.shiftright(k * 0x9E3779B1, 7) * 2 + 1, F.shiftright(k * 0x85EBCA6B, 9)
        seen = F.transform(F.sequence(F.lit(begin), F.lit(end - 1)), lambda t: F.get(values, (a * t + b).bitwiseAND(BINS - 1).cast("int")))
        return F.get(F.filter(seen, lambda v: v.isNotNull()), 0)
    return F.transform(values, lambda v, i: F.coalesce(v, probe(i, 0, 8), probe(i, 8, 64), probe(i, 64, BINS)))


def fingerprint(text: Column) -> Column:
    """Packed bits as an array of longs; null for a text without words."""
    blank = " \t\n\x0b\f\r"
    words = F.split(F.lower(F.btrim(text, F.lit(blank))), "[ \\t\\n\\x0B\\f\\r]+")
    words = F.filter(words, lambda w: w != "")
    least = let(_shingles(words), lambda h: let(F.sort_array(h), lambda s: F.filter(
        s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))))

    def gap(before: Column, after: Column) -> Column:
        return F.array_repeat(F.lit(None).cast("bigint"), after - before - 1)

    def pack(m: Column) -> Column:
        # the bins in order, with nulls between those that have a hash
        values = F.flatten(F.transform(m, lambda x, i: F.concat(
            gap(F.coalesce(_bin(F.get(m, i - 1)), F.lit(-1)), _bin(x)), F.array(x))))
        values = F.concat(values, gap(_bin(F.get(m, F.size(m) - 1)), F.lit(BINS)))
        full = F.transform(let(values, _densified), lambda v, i: F.xxhash64(v, i).bitwiseAND((1 << BITS) - 1))
        longs = let(full, lambda v: F.transform(F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1)), lambda k: F.aggregate(
            F.slice(v, k * _PER_LONG + 1, _PER_LONG), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, BITS).bitwiseOR(x))))
        return F.when(F.size(m) > 0, longs)
    return let(least, pack)


def as_text(packed: Column) -> Column:
    return F.coalesce(F.lower(F.array_join(F.transform(packed, lambda p: F.lpad(F.hex(p), 16, "0")), "")), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    def differ(x: Column, y: Column) -> Column:
        bits = x.bitwiseXOR(y)
        any_bit = bits
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(bits, k))
        return F.bit_count(any_bit.bitwiseAND(int("1" * _PER_LONG, 1 << BITS) if BITS == 4 else sum(1 << (BITS * k) for k in range(_PER_LONG))))
    off = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - off / F.lit(BINS) - chance) / (1 - chance)))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(near)


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` (doc_id, _tie, ...) with ``_next_<column>`` of the next row in descending order; the first follows the last.

    Buckets are ranges of (doc_id, _tie): null ids, and an id that fills a range of its own, are cut by ``_tie``.
    """
    spark = rows.sparkSession
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    probabilities = F.lit([k / n for k in range(1, n)])
    bounds = rows.agg(F.percentile_approx("doc_id", probabilities, 100 * n)).first()[0] or []
    often = sorted({x for x, y in zip(bounds, bounds[1:]) if x == y})
    bounds = sorted(set(bounds))
    powers = [1 << k for k in reversed(range(max(1, len(bounds)).bit_length()))]
    limit, hot = (F.lit(x) if x else F.array().cast("array<bigint>") for x in (bounds, often))
    below = F.aggregate(F.lit(powers), F.lit(0), lambda pos, p: F.when(F.get(limit, pos + p - 1) < F.col("doc_id"), pos + p).otherwise(pos))
    # a frequent id is the upper end of its range, so its parts come after the range's other ids
    place = F.when(F.col("doc_id").isNull(), -1).otherwise(below).cast("int") * 128
    part = F.when(F.col("doc_id").isNull() | F.array_contains(hot, F.col("doc_id")), F.shiftright("_tie", 58).cast("int") + 33).otherwise(0)
    place = place + part
    keys = rows.select("doc_id", "_tie").withColumn("_bucket", place)
    heads = sorted(tuple(r) for r in keys.groupBy("_bucket").agg(F.max(F.struct("doc_id", "_tie")).alias("h")).select("_bucket", "h.doc_id", "h._tie").collect())
    after = [heads[(i + 1) % len(heads)][0] for i in range(len(heads))]
    schema = T.StructType([T.StructField("_b", T.IntegerType()), T.StructField("_id", T.LongType()), T.StructField("_t", T.LongType()), T.StructField("_to", T.IntegerType())])
    small = F.broadcast(spark.createDataFrame([(*h, to) for h, to in zip(heads, after)], schema))  # a row for each bucket
    rows = rows.withColumn("_bucket", place).join(small, F.col("_bucket") == F.col("_b"), "left")
    head = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_t"))
    here = F.struct(F.col("_bucket").alias("_at"), F.lit(False).alias("_ghost"))
    there = F.struct(F.col("_to").alias("_at"), F.lit(True).alias("_ghost"))
    rows = rows.withColumn("_row", F.explode(F.when(head, F.array(here, there)).otherwise(F.array(here)))).drop("_bucket", "_b", "_id", "_t", "_to")
    rows = rows.select("*", "_row.*").drop("_row")
    order = Window.partitionBy("_at").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), F.col("_tie").desc())
    rows = rows.withColumns({f"_next_{c}": F.lead(c).over(order) for c in columns})  # one window, one shuffle
    return rows.where("not _ghost").drop("_at", "_ghost")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = docs.withColumn("_tie", F.xxhash64("text")).withColumn("fp", fingerprint(F.col("text")))
    rows = with_next(rows, ["text", "fp"])
    n = F.length("text")
    part = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - part), F.substring(F.col("_next_text"), F.lit(1), part))
    rows = rows.select("doc_id", "fp", "_next_fp", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fp", "_next_fp", fingerprint(F.col("edited")).alias("edited_fp"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("_next_fp")).alias("near_next"))
