"""Ranked lexical search by dense blocked products (operator 13).

Terms are maximal runs of characters that are neither ASCII punctuation, blanks nor controls, A-Z lower-cased. One
pass over the documents counts every text's terms and keeps those that some item holds (the postings). A term's
weight and a document's impact are integers, so a score is a product of an item tile (items x its compact
vocabulary, weights) and a document tile (vocabulary x documents, impacts). The tiles are float64 and the vocabulary
is cut where the weights times the largest impact would reach 2^53, so that every partial sum is an exact integer;
the partial sums are added in 64-bit integers. Each task keeps the best ``k`` documents of an item, equal scores by
ascending doc_id, and a ranking in two steps, first in ``SALTS`` parts of an item, joins the tasks.

The items' vocabulary is broadcast up to ``VOCABULARY_BYTES``; beyond that the documents' terms are joined with it by
a shuffle. Item tiles are broadcast in groups of at most ``GROUP_BYTES`` (or one item), one pass over the postings each.

Nulls: a null text has no terms. Rows of one item_id (null ids too) are one item with the terms of all of them.
Every document row is a document of its own: repeated rows are ranked one after another, null doc_ids last of equal
scores. Without documents or items the result is empty. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfengine.llm.common import bounded_batches, saved, table, tidy

TOP = 50
VOCABULARY_BYTES = 16 << 20
GROUP_BYTES = 8 << 20
#: Items, and terms unless one item alone has more, of a tile; cells of a document tile.
TILE_ITEMS, TILE_TERMS, TILE_CELLS = 256, 8192, 1 << 21
SALTS = 32
#: No impact reaches this, so weights summing up to EXACT give sums under 2^53.
IMPACT = 1_000_000
EXACT = (1 << 53) // IMPACT - 1
#: A-Z to a-z, every other ASCII byte outside of a term to a blank; bytes of longer characters stay.
_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c
               for c in range(256))


def split(raw: bytes | None) -> list[bytes]:
    return raw.translate(_TERMS).split() if raw else []


def _bytes(column: pa.Array) -> list:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _item_terms(batches):
    for batch in batches:
        for item, raw in zip(batch.column("item_id").to_pylist(), _bytes(batch.column("text"))):
            terms = list({t.decode() for t in split(raw)})
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(terms), pa.int64()), pa.array(terms, pa.string())], ["item_id", "term"])


def _known(ids):
    """Documents with their number of terms and, of the terms in ``ids``, id and count."""
    def run(batches):
        number = {t.encode(): i for i, t in enumerate(ids.value)}
        for batch in batches:
            n, terms, counts = [], [], []
            for raw in _bytes(batch.column("text")):
                found = split(raw)
                n.append(len(found))
                tf = Counter([i for i in map(number.get, found) if i is not None])
                terms.append(list(tf))
                counts.append(list(tf.values()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), _lists(terms, pa.int32()), _lists(counts, pa.int64())],
                                             ["doc_id", "n", "ids", "tfs"])
    return run


def _all_terms(batches):
    for batch in batches:
        rows = zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), _bytes(batch.column("text")))
        for row, doc, raw in rows:
            tf = Counter(split(raw))
            k = len(tf)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row] * (k + 1), pa.int64()), pa.array([doc] * (k + 1), pa.int64()),
                 pa.array([None, *(t.decode() for t in tf)], pa.string()), pa.array([sum(tf.values()), *tf.values()], pa.int64())], ["row", "doc_id", "term", "tf"])


def postings(docs: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, ids, tfs) of every document; ``vocabulary`` has (term, id) with ids from 0, ``size`` bytes in all."""
    spark = docs.sparkSession
    if size <= VOCABULARY_BYTES:
        ids = spark.sparkContext.broadcast([r.term for r in vocabulary.orderBy("id").collect()])
        return docs.mapInArrow(tidy(_known(ids)), "doc_id long, n long, ids array<int>, tfs array<long>")
    rows = saved(docs.withColumn("row", F.monotonically_increasing_id()), "texts")
    terms = rows.mapInArrow(tidy(_all_terms), "row long, doc_id long, term string, tf long")
    pair = F.struct(F.col("id"), F.col("tf"))
    per = (terms.join(vocabulary, "term", "left").where("term is null or id is not null").groupBy("row")
           .agg(F.max("doc_id").alias("doc_id"), F.max(F.when(F.col("term").isNull(), F.col("tf"))).alias("n"),
                F.collect_list(F.when(F.col("id").isNotNull(), pair)).alias("_p")))
    return per.select("doc_id", "n", F.col("_p.id").cast("array<int>").alias("ids"), F.col("_p.tf").alias("tfs"))


def tiles(items: list[tuple]) -> list[tuple[list, np.ndarray, np.ndarray, list[int]]]:
    """(item ids, term ids ascending, weights as terms x items, ends of the exact vocabulary cuts) of each tile."""
    out, at = [], 0
    while at < len(items):
        end, seen = at, set()
        while end < len(items) and end - at < TILE_ITEMS and (end == at or len(seen | set(items[end][1])) <= TILE_TERMS):
            seen |= set(items[end][1])
            end += 1
        terms = np.array(sorted(seen), np.int64)
        weights = np.zeros((len(terms), end - at))
        for column, (_, ids, ws) in enumerate(items[at:end]):
            weights[np.searchsorted(terms, np.array(ids, np.int64)), column] = ws
        cuts, total = [], 0
        for i, w in enumerate(weights.max(1, initial=0)):
            if total + w > EXACT:
                cuts.append(i)
                total = 0
            total += w
        out.append(([x[0] for x in items[at:end]], terms, weights, [*cuts, len(terms)]))
        at = end
    return out


def impacts(n: list[int], tfs: np.ndarray, doc: np.ndarray, whole: int, total: int) -> np.ndarray:
    m = np.array([50 + 50 * x * whole // total for x in n], np.int64)
    return (1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc])


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best ``k`` of each item: highest score, then smallest doc_id, null ones last."""
    order = np.lexsort((doc, none, -score, item))
    ranked = item[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    return order[np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)])) < k]


def _rank(group, k: int, whole: int, total: int):
    def run(batches):
        parts = tiles(group.value)
        best = [(np.empty(0, np.int64),) * 3 + (np.empty(0, bool),) for _ in parts]
        least = [np.ones(len(names), np.int64) for names, *_ in parts]
        for batch in batches:
            doc = batch.column("doc_id")
            ids, tfs = (batch.column(c) for c in ("ids", "tfs"))
            lengths = np.diff(ids.offsets.to_numpy())
            row = np.repeat(np.arange(len(lengths)), lengths)
            term = ids.flatten().to_numpy().astype(np.int64)
            impact = impacts(batch.column("n").to_pylist(), tfs.flatten().to_numpy(), row, whole, total).astype(np.float64)
            none = doc.is_null().to_numpy(zero_copy_only=False)
            number = doc.fill_null(0).to_numpy()
            for p, (names, terms, weights, cuts) in enumerate(parts):
                place = np.searchsorted(terms, term)
                place[place == len(terms)] = 0
                here = np.flatnonzero(terms[place] == term)
                step = max(1, TILE_CELLS // len(terms))
                for a in range(0, len(lengths), step):
                    size = min(step, len(lengths) - a)
                    own = here[np.searchsorted(row[here], a):np.searchsorted(row[here], a + size)]
                    tile = np.zeros((size, len(terms)))
                    tile[row[own] - a, place[own]] = impact[own]
                    scores, start = np.zeros((size, len(names)), np.int64), 0
                    for end in cuts:
                        scores += (tile[:, start:end] @ weights[start:end]).astype(np.int64)
                        start = end
                    d, i = np.nonzero(scores >= least[p])
                    if len(d):
                        item, score, docs, nulls = (np.concatenate(x) for x in zip(best[p], (i, scores[d, i], number[a + d], none[a + d])))
                        keep = _best(item, score, docs, nulls, k)
                        best[p] = item, score, docs, nulls = item[keep], score[keep], docs[keep], nulls[keep]
                        full = np.flatnonzero(np.bincount(item, minlength=len(names)) == k)
                        lowest = np.full(len(names), np.iinfo(np.int64).max)
                        np.minimum.at(lowest, item, score)
                        least[p][full] = lowest[full]
        for (names, *_), (item, score, docs, nulls) in zip(parts, best):
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in item], pa.int64()), pa.array(docs, pa.int64(), mask=nulls), pa.array(score)], ["item_id", "doc_id", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs, items = docs.select(F.col("doc_id").cast("long"), "text"), items.select(F.col("item_id").cast("long"), "text")
    held = saved(items.mapInArrow(tidy(_item_terms), "item_id long, term string").distinct(), "item-terms")
    words = held.select("term").distinct()
    size = words.agg(F.sum(F.octet_length("term") + 40)).first()[0] or 0
    # ids by rank of the term's hash: dense, and each part is numbered on its own
    part = F.pmod(F.xxhash64("term"), F.lit(64))
    counts = {r.p: r["count"] for r in words.groupBy(part.alias("p")).count().collect()}
    start = {p: sum(v for q, v in counts.items() if q < p) for p in counts}
    offsets = F.create_map(*[F.lit(x) for p, s in sorted(start.items()) for x in (p, s)]) if start else F.create_map(F.lit(0), F.lit(0))
    vocabulary = saved(words.withColumn("_p", part).withColumn("id", F.row_number().over(Window.partitionBy("_p").orderBy("term")) - 1 + offsets[F.col("_p").cast("int")])
                       .drop("_p"), "vocabulary")
    held = held.join(vocabulary, "term")
    found = saved(postings(docs, vocabulary, size), "postings")
    whole, total = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    schema = "item_id long, doc_id long, score long"
    if not whole or not size:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    df = found.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df"))
    weighted = saved(held.join(df, "id"), "weights")  # a term that no document holds scores nothing
    count = weighted.count()
    groups = max(1, math.ceil(count * 24 / GROUP_BYTES))
    out = None
    for g in range(groups):
        rows = weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).groupBy("item_id").agg(F.collect_list(F.struct("id", "df")).alias("terms")).collect()
        group = [(r.item_id, [t.id for t in r.terms], [math.floor(1000 * math.log((2 * whole + 2) / (2 * t.df + 1))) for t in r.terms])
                 for r in sorted(rows, key=lambda r: (r.item_id is None, r.item_id))]
        if group:
            part = found.where(F.size("ids") > 0).mapInArrow(tidy(_rank(spark.sparkContext.broadcast(group), k, whole, total)), schema)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    out = out.withColumn("_s", salt).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "_s").orderBy(*best))).where(F.col("rank") <= k)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best))).where(F.col("rank") <= k)
    return out.select("item_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op13_lexical``: the 50 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
word AS (SELECT r, unnest(ts) AS t FROM doc),
size AS (SELECT r, count(*) AS n FROM word GROUP BY r),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM size),
item AS (
  SELECT DISTINCT item_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
tf AS (SELECT r, t, count(*) AS tf FROM word WHERE t IN (SELECT t FROM item) GROUP BY r, t),
weight AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), corpus),
impact AS (
  SELECT tf.r, tf.t, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // len)) AS imp
  FROM tf JOIN size ON tf.r = size.r, corpus),
scored AS (
  SELECT item.item_id, impact.r, CAST(sum(w * imp) AS BIGINT) AS score
  FROM item JOIN impact ON item.t = impact.t JOIN weight ON weight.t = item.t
  GROUP BY item.item_id, impact.r),
ranked AS (
  SELECT s.item_id, d.doc_id, s.score,
         CAST(row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, d.doc_id) AS INTEGER) AS rank
  FROM scored s JOIN doc d ON d.r = s.r WHERE s.score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
