"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, binary output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perfengine.llm.common import saved, table
from perfengine.llm.op1_mixing import mix_stage
from perfengine.llm.op2_decontaminate import decontaminate_stage
from perfengine.llm.op6_language import language_stage
from perfengine.llm.op8_neardup import dedup_stage
from perfengine.llm.op9_records import token_stage

#: (name, function (spark, docs, sf_dir) -> DataFrame); each works on all that the one before kept.
STAGES = [
    ("language", language_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mix_stage),
    ("records", token_stage),
]

#: The rank profiles, sketches and token ids can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
