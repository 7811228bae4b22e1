"""Operator 5 against a plain version of its bins, densified values, likeness and neighbours."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from perfengine.llm import op5_fingerprint as op

BLANK = " \t\n\x0b\f\r"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(values, seed=42, size=8):
    for v in values:
        seed = xxhash.xxh64((v % (1 << 8 * size)).to_bytes(size, "little"), seed=seed).intdigest()
    return signed(seed)


def bits(text):
    words = [w for w in text.lower().translate({ord(c): " " for c in BLANK}).split(" ") if w]
    h = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in words]
    if not h:
        return None
    shingles = [chained(h[i:i + op.WORDS]) for i in range(len(h) - op.WORDS + 1)] or [chained(h)]
    bins = [None] * op.BINS
    for x in sorted(shingles, reverse=True):
        bins[(x >> 57) + 64] = x
    out = []
    for i in range(op.BINS):
        a, b = (((i + 1) * 0x9E3779B1) >> 7) * 2 + 1, ((i + 1) * 0x85EBCA6B) >> 9
        v = bins[i] if bins[i] is not None else next(bins[(a * t + b) % op.BINS] for t in range(op.BINS) if bins[(a * t + b) % op.BINS] is not None)
        out.append(xxhash.xxh64(i.to_bytes(4, "little"), seed=chained([v]) % (1 << 64)).intdigest() % 16)
    return out


def text_of(b):
    return "" if b is None else "".join(f"{x:x}" for x in b)


def like(a, b):
    if a is None or b is None:
        return float(a is b)
    same = sum(x == y for x, y in zip(a, b)) / op.BINS
    return min(1.0, max(0.0, (same - 1 / 16) / (1 - 1 / 16)))


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


DOCS = [(1, words(1, 300)), (2, words(1, 300).upper()), (3, words(2, 9)), (4, "one"), (5, "other"), (6, None), (7, ""), (8, " \n\t"), (9, "\xa0 é É word"),
        (10, words(3, 20000)), (None, words(4, 40)), (None, "x y"), (None, None), (12, words(5, 6)), (12, words(6, 7)), (-5, words(7, 3))]


def expected(docs):
    rows = [(i, t or "") for i, t in docs]
    tie = lambda t: signed(xxhash.xxh64(t.encode(), seed=42).intdigest())
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])), reverse=True)
    out = []
    for k, (i, t) in enumerate(rows):
        follow = rows[(k + 1) % len(rows)][1]
        part = len(t) // 3
        edited = t[:len(t) - part] + follow[:part]
        a, b, c = bits(t), bits(edited), bits(follow)
        out.append((str(i), len(t), text_of(a), text_of(b), round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 8])
def test_against_plain_version(spark, tmp_path, partitions):
    df = spark.createDataFrame([(i, t, "z", True) for i, t in DOCS], "doc_id long, text string, _at string, fp boolean")
    df.repartition(partitions).write.parquet(f"{tmp_path}/documents.parquet")
    got = op.query(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == expected(DOCS)


def test_short_disjoint_texts_are_not_alike(spark):
    pairs = [(f"left{i} alone", f"right{i} other") for i in range(60)]
    got = spark.createDataFrame(pairs, "a string, b string").select(op.likeness(op.fingerprint(F.col("a")), op.fingerprint(F.col("b"))).alias("x")).collect()
    assert max(r.x for r in got) < 0.15


def test_hot_ids_are_cut(spark):
    """Null ids and one id on most rows are spread over many buckets, and every row follows another."""
    rows = [(None, f"n{i} a b") for i in range(300)] + [(7, f"t{i} c d") for i in range(500)] + [(i, f"u{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_tie", F.xxhash64("text"))
    out = op.with_next(df, ["text"])
    assert sorted(r._next_text for r in out.select("_next_text").collect()) == sorted(t for _, t in rows)
    sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 700
