"""Language identification by rank-order n-gram profiles (operator 6).

A profile is the list of a language's ``TOP`` most frequent letter n-grams (1 to 3 letters, words padded
with one blank on either side, lower case) by falling count. A document's own profile is compared with
each language's by out-of-place distance: every n-gram of the document adds the difference of its two
ranks, or ``TOP`` where the language's profile lacks it. The nearest language wins; ties go to the first
in the alphabet. The score is 1 - distance / (largest possible distance).

Profiles are learnt from a sample of about ``FIT_DOCS`` documents a language (all if there are fewer),
taken by a hash of the doc_id; scoring reads whole texts. There is no limit of letters; those that no
profile has count as one unknown letter.

Nulls: a null text, an empty one or one without letters (marks alone are none) gives ``und`` with score 0. Rows without lang or
doc_id are never learnt from. Without any labelled row all predictions are ``und``. Repeated rows are
learnt from and scored each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perfengine.llm.common import bounded_batches, table, tidy

TOP, ORDERS = 300, 3
FIT_DOCS = 1500
#: Bits of a letter's number: Unicode has fewer letters and marks than 2^18, and three of them leave room in 64
#: bits for the length and the number of a text in a run of ``RUN_TEXTS``.
BITS, RUN_TEXTS = 18, 128
UNKNOWN = (1 << BITS) - 1
#: A document under this score is in no learnt language. The lowest of the 10,000 and 51,000 rows of two tables score
#: 0.38 and 0.36 (one in a thousand: 0.44 to 0.49), letters drawn at random 0.17 to 0.27.
REJECT = 0.3
CHUNK = 1 << 19


def _letters() -> np.ndarray:
    """2 for a letter, 1 for a mark, else 0."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kinds[c] = {"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0)
    return kinds


_IS_LETTER: list[np.ndarray] = []


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each followed by a blank; 0 stands for a non-letter. And text numbers."""
    if not _IS_LETTER:
        _IS_LETTER.append(_letters())
    low = [" " + (t or "").lower() + " " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
    kinds = _IS_LETTER[0][points]
    lettered = np.zeros(len(low), bool)
    lettered[owner[kinds == 2]] = True
    points = np.where((kinds > 0) & lettered[owner], points, 0)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0) | (owner[1:] != owner[:-1])
    return points[keep], owner[keep]


def ngrams(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-gram, text) of all n-grams; ``codes`` are letter numbers, 0 the blank."""
    grams, owners = [], []
    packed = np.zeros(len(codes), np.int64)
    for n in range(1, ORDERS + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        packed = (packed[:m] << BITS) | codes[n - 1 :]
        # no blank inside, and not blanks only; codes of different lengths differ by the leading marker
        ok = owner[:m] == owner[n - 1 :]
        if n == 1:
            ok &= codes != 0
        elif n == 2:
            ok &= (codes[:-1] != 0) | (codes[1:] != 0)
        else:
            ok &= codes[1 : m + 1] != 0
        grams.append(packed[ok] | (n << (BITS * ORDERS)))
        owners.append(owner[:m][ok])
    return (np.concatenate(grams), np.concatenate(owners)) if grams else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def profiles(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, rank) of each text's ``TOP`` n-grams, ties by the n-gram's code."""
    grams, owners = ngrams(codes, owner)
    width = BITS * ORDERS + 2
    key = np.sort((owners.astype(np.int64) << width) | grams)
    if not len(key):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count, key = np.diff(np.append(first, len(key))), key[first]
    doc = key >> width
    order = np.lexsort((-count, doc)) if len(key) < 1 << 12 else np.argsort((doc << 32) - count, kind="stable")
    doc, key = doc[order], key[order]
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    rank = np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))
    top = rank < TOP
    return doc[top], key[top] & ((1 << width) - 1), rank[top]


class Model:
    """Rank profiles: languages, the letters' numbers, sorted n-grams and their rank in each language."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        """rows: (language, n-gram, rank from 0)."""
        self.languages = sorted({r[0] for r in rows})
        letters = sorted({c for _, g, _ in rows for c in g if c != " "})
        self.points = np.array([ord(c) for c in letters], np.uint32)
        code = {c: i + 1 for i, c in enumerate(letters)} | {" ": 0}
        packed = {}
        for lang, g, r in rows:
            k = len(g) << (BITS * ORDERS)
            for i, c in enumerate(g):
                k |= code[c] << (BITS * (len(g) - 1 - i))
            packed.setdefault(k, {})[lang] = r
        self.grams = np.array(sorted(packed), np.int64)
        self.ranks = np.full((len(packed), len(self.languages)), -1, np.int32)
        for i, k in enumerate(self.grams):
            for j, lang in enumerate(self.languages):
                self.ranks[i, j] = packed[int(k)].get(lang, -1)

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if len(texts) > RUN_TEXTS:
            parts = [self.score(texts[i : i + RUN_TEXTS]) for i in range(0, len(texts), RUN_TEXTS)]
            return [x for lang, _ in parts for x in lang], np.concatenate([score for _, score in parts])
        points, owner = code_points(texts)
        if len(self.points):
            at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
            codes = np.where(points == 0, 0, np.where(self.points[at] == points, at + 1, UNKNOWN)).astype(np.int64)
            doc, gram, rank = profiles(codes, owner)
        if not len(self.points) or not len(doc):
            return ["und"] * len(texts), np.zeros(len(texts))
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = self.grams[at] == gram
        far = np.full((len(gram), len(self.languages)), TOP, np.int64)
        ranks = self.ranks[at[known]]
        far[known] = np.where(ranks >= 0, np.abs(ranks - rank[known, None]), TOP)
        begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        total = np.add.reduceat(far, begin, axis=0)
        best, size = total.argmin(1), np.diff(np.append(begin, len(doc)))
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        score[doc[begin]] = np.clip(1 - total.min(1) / (size * TOP), 0, 1)
        for d, b in zip(doc[begin], best):
            lang[d] = self.languages[b]
        return lang, score


def grouped(texts: list[str | None], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` characters."""
    i, n = 0, 0
    for j, t in enumerate(texts):
        if n and n + len(t or "") > size:
            yield i, j
            i, n = j, 0
        n += len(t or "") + 1
    if i < len(texts):
        yield i, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams (as text) a language and run of texts."""
    for batch in batches:
        langs, texts = np.array(batch.column("lang").to_pylist(), object), batch.column("text").to_pylist()
        groups = [(lang, own[i:j]) for lang in sorted(set(langs)) for own in [[texts[k] for k in np.flatnonzero(langs == lang)]] for i, j in grouped(own)]
        for lang, own in groups:
            points, owner = code_points(own)
            letters = np.unique(points)
            letters = np.append(0, letters[letters > 0])
            grams, _ = ngrams(np.searchsorted(letters, points).astype(np.int64), owner)
            key, n = np.unique(grams, return_counts=True)
            out, counts = [], []
            for k, c in zip(key.tolist(), n.tolist()):
                size = k >> (BITS * ORDERS)
                cs = [(k >> (BITS * (size - 1 - i))) & ((1 << BITS) - 1) for i in range(size)]
                out.append("".join(chr(letters[c]) if c else " " for c in cs))
                counts.append(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(out), pa.string()), pa.array(out, pa.string()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Learn from ``docs`` (doc_id, text, lang): a hash sample of about ``fit_docs`` documents a language."""
    bounded_batches(docs.sparkSession)
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        "doc_id is not null and text is not null and lang is not null")
    share = labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(fit_docs)) / F.count("*")).alias("share"))
    hashed = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.join(F.broadcast(share), "lang").where(hashed < F.col("share")).select("lang", "text")
    counts = sample.mapInArrow(tidy(_count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("r", rank - 1).where(F.col("r") < TOP).collect()
    return Model([(r["lang"], r["gram"], r["r"]) for r in rows])


def learnt(docs: DataFrame) -> Model:
    """The contract's split: documents whose crc32(doc_id as text) mod 3 is not 1."""
    return fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = spark.sparkContext.broadcast(learnt(docs))

    def run(batches):
        for batch in batches:
            texts, langs, scores = batch.column("text").to_pylist(), [], []
            for i, j in grouped(texts):
                lang, score = held.value.score(texts[i:j])
                langs += lang
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows without letters, or in none of the learnt languages (score under ``REJECT``), go.

    Where no row has a language to learn, only rows without letters go.
    """
    model = learnt(docs)
    held = spark.sparkContext.broadcast(model)
    if not model.languages:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))

    def run(batches):
        for batch in batches:
            texts, keep = batch.column("text").cast(pa.string()).to_pylist(), []
            for i, j in grouped(texts):
                lang, score = held.value.score(texts[i:j])
                keep += [x != "und" and s >= REJECT for x, s in zip(lang, score)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
