"""Benchmark decontamination by size-partitioned MinHash containment search (operator 2).

An item counts as contained in a document if the document has ``CONTAINED`` or more of the item's
distinct five-word shingles. Items are partitioned by their number of shingles: class U holds sizes
in (U/2, U], U a power of two. For each class a document is cut into windows of 2U shingles that
begin every U, so that a whole item lies in one window however long the document is, and its Jaccard
similarity with that window is 0.19 or more. A window whose MinHash agrees with an item's in one of
``HASHES`` places makes the item a candidate (chance of a miss under 1e-5); candidates are verified on
the exact shingles of the whole document.

Items reach the workers in blocks of bounded bytes; every block is held against all documents. Hot
sources or copies need no care: documents are never grouped.

Nulls: a null text is empty; an empty item (or one without words) is in no document. Fewer than five
words are one shingle. Repeated items and documents give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfengine.llm import shingles as S
from perfengine.llm.common import bounded_batches, table, tidy

WORDS, CONTAINED, HASHES = 5, 0.8, 64
#: Bytes of item texts in one block.
BLOCK_BYTES = 4 << 20
_FACTORS = S.multipliers(HASHES, 2)
PAIRS = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"


def exact_shingles(text: str | None, n: int = WORDS) -> set[bytes]:
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class Index:
    """Signatures of one block of items, by size class."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.sets = [i for i, _ in items], [exact_shingles(t) for _, t in items]
        texts = pa.array([t for _, t in items], pa.string())
        sig = np.zeros((len(items), HASHES), np.uint64)
        for i, raw, at in S.chunks(texts):
            sets, so = S.distinct(*S.shingle_hashes(*S.word_hashes(raw, at), WORDS))
            for k in np.flatnonzero(np.diff(so)):
                own = sets[so[k] : so[k + 1]]
                sig[i + k] = [(own * a).min() for a in _FACTORS]
        size = np.array([len(s) for s in self.sets])
        self.classes = []
        for u in sorted({1 << int(n - 1).bit_length() for n in size if n}):
            who = np.flatnonzero((size > u // 2) & (size <= u))
            order = np.argsort(sig[who], axis=0, kind="stable")
            self.classes.append((u, [(np.take(sig[who, h], order[:, h]), who[order[:, h]]) for h in range(HASHES)]))

    def candidates(self, texts: pa.Array) -> Iterator[tuple[int, int]]:
        """(text number, item number) of all candidates."""
        for base, raw, at in S.chunks(texts):
            sh, so = S.shingle_hashes(*S.word_hashes(raw, at), WORDS)
            if not len(sh):
                continue
            n = np.diff(so)
            cuts, found = [], set()
            for u, _ in self.classes:
                blocks = -(-n // u)
                doc = np.repeat(np.arange(len(n)), blocks)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                pair = np.append(doc[1:] == doc[:-1], False)
                cuts.append((so[doc] + nth * u, doc, pair))
            t = np.empty_like(sh)
            for h, a in enumerate(_FACTORS):
                np.multiply(sh, a, out=t)
                for (u, items), (start, doc, pair) in zip(self.classes, cuts):
                    low = np.minimum.reduceat(t, start)
                    low = np.where(pair, np.minimum(low, np.append(low[1:], low[-1])), low)
                    values, who = items[h]
                    left, right = np.searchsorted(values, low, "left"), np.searchsorted(values, low, "right")
                    for w in np.flatnonzero(right > left):
                        found.update((base + int(doc[w]), int(i)) for i in who[left[w] : right[w]])
            yield from sorted(found)

    def pairs(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(text number, item id, item's shingles, shared shingles) of verified pairs."""
        last, own = -1, set()
        for k, i in self.candidates(texts):
            if k != last:
                last, own = k, exact_shingles(texts[k].as_py())
            shared = len(self.sets[i] & own)
            if shared >= CONTAINED * len(self.sets[i]):
                yield k, self.ids[i], len(self.sets[i]), shared


def indexes(items: DataFrame) -> Iterator[Index]:
    """The items in blocks of about ``BLOCK_BYTES`` of text."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        if rows:
            yield Index([(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1]))])


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and item of which it holds ``CONTAINED`` or more."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], PAIRS)
    for index in indexes(items):
        held = spark.sparkContext.broadcast(index)

        def run(batches, held=held):
            for batch in batches:
                rows = list(held.value.pairs(batch.column("text")))
                k, item, n, shared = (np.array(x) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 4
                ids = [None if r[1] is None else r[1] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(k, pa.int64())), pa.array(ids, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(shared, pa.int64()), pa.array(shared / np.maximum(n, 1), pa.float64())],
                    ["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

        out = out.union(docs.mapInArrow(tidy(run), PAIRS))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go; all others stay as they are."""
    bounded_batches(spark)
    for index in indexes(table(spark, sf_dir, "benchmark")):
        held = spark.sparkContext.broadcast(index)

        def run(batches, held=held):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for k, *_ in held.value.pairs(batch.column("text").cast(pa.string())):
                    keep[k] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs


ORACLE_SQL = r"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
           UNION ALL SELECT 'i', item_id, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark),
s AS (SELECT DISTINCT side, id, array_to_string(w[i : i + 4], ' ') AS shingle
      FROM (SELECT side, id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE side = 'i' GROUP BY id),
c AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS k FROM s d JOIN s i USING (shingle)
      WHERE d.side = 'd' AND i.side = 'i' GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, CAST(k AS BIGINT) AS n_shared, k / n AS containment
FROM c JOIN n ON n.id = c.item_id WHERE k >= 0.8 * n
"""
