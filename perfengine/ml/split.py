"""Deterministic, partition-independent splits and folds (M1, M8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfengine.operators.ordering import with_position


def key_hash(key: str, purpose: str = "") -> Column:
    """Integer from the first 8 hex digits of the MD5 of ``purpose`` and a key string (same value in SQL engines)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(purpose), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint")


def hash_split(df: DataFrame, key: str, test_buckets: int = 1, buckets: int = 5) -> tuple[DataFrame, DataFrame]:
    """M1: train/test split by key hash (``test_buckets / buckets`` of the keys in test).

    Unlike ``randomSplit`` it does not depend on partitioning, so a retried
    task or a different cluster gives the same split.
    """
    b = F.pmod(key_hash(key), F.lit(buckets))
    return df.where(b >= test_buckets), df.where(b < test_buckets)


def with_split_flag(df: DataFrame, key: str, test_buckets: int = 1, buckets: int = 5, name: str = "is_test") -> DataFrame:
    return df.withColumn(name, (F.pmod(key_hash(key), F.lit(buckets)) < test_buckets).cast("int"))


def with_hash_folds(df: DataFrame, key: str, k: int = 5, name: str = "fold") -> DataFrame:
    """M8 shuffled folds: fold = hash(key) mod k, by a hash of its own, so that the training rows of
    ``hash_split`` fall into all k folds."""
    return df.withColumn(name, F.pmod(key_hash(key, "fold:"), F.lit(k)).cast("int"))


def with_ordered_folds(df: DataFrame, order: list[str], k: int = 5, by: str | None = None, name: str = "fold") -> DataFrame:
    """M8 unshuffled folds: consecutive blocks in ``order``; the first n mod k folds get one extra row
    (the ``KFold(shuffle=False)`` / ``ntile`` sizes)."""
    keys = [by] if by else []
    pos = with_position(df, order, keys, name="_pos")
    counts = (pos.groupBy(*keys) if keys else pos.groupBy()).agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        from perfengine.operators.joins import join_small
        pos = join_small(pos, counts, keys)
    else:
        pos = pos.withColumn("_n", F.lit(counts.first()["_n"]))
    q = F.floor(F.col("_n") / k)
    r = F.col("_n") - q * k
    big = r * (q + 1)
    fold = F.when(F.col("_pos") < big, F.floor(F.col("_pos") / (q + 1))).otherwise(
        r + F.floor((F.col("_pos") - big) / F.greatest(q, F.lit(1))))
    return pos.withColumn(name, fold.cast("int")).drop("_n")
