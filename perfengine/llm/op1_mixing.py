"""Mixing sources to target weights by Poisson replication (operator 1).

Source s gets the rate weight(s) * budget / size(s), its mean number of repetitions. Each document's
count is a Poisson variable of that mean, inverted from a uniform number that a hash of (seed, doc_id,
text) gives: the count is the number of values of the distribution function that do not exceed it. The
document is repeated that many times and all copies are dealt out by a hash of (seed, document, copy),
so that the result is shuffled globally and comes out alike at any partitioning.

Default weights are sizes (in characters) to the power ``ALPHA``, and the budget is the size of the whole.
Rates are rounded to 9 decimals. Nulls: a null source is a source of its own; a null text has size 0
(an all-empty source has size 0 and rate 1). Given weights need not sum to 1; a source without one gets
rate 0. Repeated rows draw the same count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfengine.llm.common import saved, set_aside, small_side, table

ALPHA, SEED = 0.5, "mix-1"


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """(source, size, rate, base, cdf): one row per source."""
    size = F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("double")
    each = docs.groupBy("source").agg(size.alias("size"))
    if weights is None:
        each = each.withColumn("weight", F.pow("size", F.lit(alpha)))
    else:
        given = docs.sparkSession.createDataFrame(sorted(weights.items(), key=str), "name string, weight double")
        each = each.join(given, F.col("source").cast("string").eqNullSafe(F.col("name")), "left").drop("name").fillna(0.0, ["weight"])
    each = saved(each, "sizes")
    whole = each.agg(F.sum("size").alias("all"), F.sum("weight").alias("w")).first()
    total, weight = float(whole["all"] or 0), float(whole["w"] or 0)
    rate = F.col("weight") / F.lit(weight or 1.0) * F.lit(float(total if budget is None else budget)) / F.col("size")
    rate = F.when(F.col("size") > 0, F.round(rate, 9)).otherwise(F.lit(1.0))
    # the distribution function from ``base`` on: outside, probabilities are under 1e-18
    spread = F.ceil(12 * F.sqrt("rate") + 30)
    base = F.greatest(F.lit(0), F.floor("rate") - spread).cast("int")
    steps = F.sequence(F.lit(0), (F.floor("rate") + spread).cast("int") - F.col("base"))
    # log k! by Stirling's series, exact to a double from 10 on; below by product
    def log_factorial(k: Column) -> Column:
        k = k.cast("double")
        small = F.lit([math.lgamma(i + 1) for i in range(11)])
        series = ((k + 0.5) * F.log(k) - k + 0.5 * math.log(2 * math.pi) + 1 / (12 * k) - 1 / (360 * k * k * k) + 1 / (1260 * F.pow(k, F.lit(5))))
        return F.when(k <= 10, F.get(small, F.least(k, F.lit(10)).cast("int"))).otherwise(series)

    def pmf(k: Column) -> Column:
        return F.exp(k * F.log("rate") - F.col("rate") - log_factorial(k))

    start = F.struct(F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("all"))
    cdf = F.aggregate(steps, start, lambda s, i: F.struct(
        (s["c"] + pmf(F.col("base") + i)).alias("c"), F.concat(s["all"], F.array(s["c"] + pmf(F.col("base") + i))).alias("all")))["all"]
    each = each.withColumn("rate", rate).withColumn("base", base)
    return each.withColumn("cdf", F.when(F.col("rate") > 0, cdf)).select("source", "size", "rate", "base", "cdf")


#: columns that the operator adds, of which the first four stay
NAMES = {"_rate", "_copies", "_copy", "_key", "_source", "_base", "_cdf", "_name"}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None,
        alpha: float = ALPHA, seed: str = SEED) -> DataFrame:
    """All copies with the columns of ``docs`` and _rate, _copies, _copy, _key, in the order of _key.

    A column of ``docs`` named like one that the operator adds (``NAMES``) comes out as ``<name>_in``.
    """
    docs, _ = set_aside(docs, NAMES)
    table_ = saved(rates(docs, weights, budget, alpha), "rates").select(
        F.col("source").alias("_source"), F.col("rate").alias("_rate"), F.col("base").alias("_base"), F.col("cdf").alias("_cdf"))
    out = docs.join(small_side(table_, 4096), F.col("source").eqNullSafe(F.col("_source")))
    name = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    out = out.withColumn("_name", name)
    # the number is bound once; inside the filter it would be drawn anew for every step of the function
    count = F.get(F.transform(F.array(unit(F.col("_name"))), lambda u: F.col("_base") + F.size(F.filter("_cdf", lambda c: c <= u))), 0)
    out = out.withColumn("_copies", F.when(F.col("_rate") > 0, count).otherwise(0).cast("long"))
    out = out.drop("_source", "_base", "_cdf").where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.withColumn("_key", F.md5(F.concat_ws("|", "_name", F.col("_copy").cast("string")))).drop("_name").orderBy("_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", "lang", "source", "n_chars", F.col("_rate").alias("rate"), F.col("_copies").alias("n_copies"),
        F.col("_copy").alias("copy"), F.col("_key").alias("shuffle_key"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents repeated to the target weights, in shuffled order."""
    apart, own = set_aside(docs, NAMES)
    return mix(apart).select(*own)


ORACLE_SQL = r"""
WITH e AS (SELECT source, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS size FROM documents GROUP BY source),
t AS (SELECT sum(size) AS whole, sum(sqrt(size)) AS w FROM e),
r AS (SELECT source, CASE WHEN size > 0 THEN round(sqrt(size) / w * whole / size, 9) ELSE 1.0 END AS rate FROM e, t),
p AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
      FROM r, (SELECT unnest(generate_series(0, 400)) AS k)),
c AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
l AS (SELECT source, any_value(rate) AS rate, list(c ORDER BY k) AS cdf FROM c GROUP BY source),
d AS (SELECT documents.*, rate, 'mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) AS name, cdf
      FROM documents JOIN l ON documents.source IS NOT DISTINCT FROM l.source),
n AS (SELECT * EXCLUDE (cdf), len(list_filter(cdf, lambda x: x <= CAST('0x' || md5(name)[:13] AS BIGINT) / 4503599627370496.0)) AS n_copies FROM d)
SELECT doc_id, text, lang, source, n_chars, rate, CAST(n_copies AS BIGINT) AS n_copies, CAST(copy AS BIGINT) AS copy,
       md5(name || '|' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM (SELECT *, unnest(generate_series(1, n_copies)) AS copy FROM n)
"""
