"""The language stage: learnt prose of any length stays, letters drawn at random go."""

import random

from pyspark.sql import functions as F

from perfengine.llm import op6_language

SF_SMALL = "/root/testdata/sf0.001"


def test_random_letters_go_and_prose_stays(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(2)
    noise = [(10**6 + i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(60)), None) for i in range(20)]
    noise += [(2 * 10**6, "12 34 !", None), (2 * 10**6 + 1, None, None), (2 * 10**6 + 2, "", None)]
    short = docs.where("lang is not null").select((F.col("doc_id") + 3 * 10**6).alias("doc_id"), F.substring_index("text", " ", 12).alias("text"), F.lit(None).cast("string").alias("lang"))
    every = docs.unionByName(spark.createDataFrame(noise, docs.schema)).unionByName(short)
    left = {r.doc_id for r in op6_language.language_stage(spark, every, "").select("doc_id").collect()}
    assert not left & {n[0] for n in noise}
    lettered = {r.doc_id for r in every.where(~F.col("doc_id").isin([n[0] for n in noise])).where(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    lost = lettered - left
    assert not [d for d in lost if d < 10**6] and len(lost) <= len(lettered) * 0.01, sorted(lost)
