"""Toxicity by compression distance (operator 7).

Two zstandard dictionaries are trained apart, one on windows of ordinary texts, one on windows of toxic
texts; copies of a text (by digest) teach once. A text is cut into windows of about ``WINDOWS`` bytes (narrow
and wide ones) at spaces; each window is compressed with the ordinary dictionary and with the toxic dictionary laid before the
ordinary one, so that the two lengths differ by what toxic text adds to ordinary text. No words are chosen:
the trainer takes the segments that occur in most windows, and what ordinary text has too cancels out, for
which the ordinary dictionary must be the larger. The differences of all windows of each width give a text's
features (largest, mean, mean of gains, number of windows); a logistic model, weighted to the classes' true shares
and fitted on labelled rows that the dictionaries in use have not seen (``FOLDS`` folds, each measured
with those of the others), calibrates them to a probability, and the threshold is 0.3.

Training windows have ``TRAIN_WINDOW`` bytes; of a text with more than ``TEXT_WINDOWS`` (of an ordinary, of
a toxic text) that many are drawn by hash from its whole length. A dictionary (ordinary, toxic) has at
most one byte for ``BYTES_FOR_ONE`` of its training text, so that a few toxic texts do not become it whole.

Dictionaries and calibration are fitted on a hash sample of about ``FIT_DOCS`` labelled documents of each
label (all if there are fewer), one row a doc_id (that of the smallest digest). The executors cut its
texts to training windows and measure whole texts for the calibration; the driver gets windows and features
alone. Scoring reads whole texts.

Nulls: a null or empty text scores as one empty window. Rows without label or doc_id are never learnt
from; several labels of one document count as its largest. Without both labels every score is the share
of toxic labels (0 without labels). Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfengine.llm.common import bounded_batches, saved, small_side, table, tidy

WINDOWS, ORDINARY_BYTES, TOXIC_BYTES = (64, 256), 112640, 12288
TRAIN_WINDOW, TEXT_WINDOWS, BYTES_FOR_ONE = 64, (12, 256), (2, 64)
#: Segment and match lengths of the dictionary trainer.
SEGMENT, MATCH = 10, 8
FIT_DOCS, FOLDS = 4000, 4
#: Features of a text: the constant, and seven of each width.
FEATURES = 1 + 7 * len(WINDOWS)
THRESHOLD = 0.3
#: Match finder: tables that hold both dictionaries whole, and attempts (as a power of 2) a position.
WINDOW_LOG, HASH, CHAIN, SEARCH = 19, 17, 17, 3


def windows(text: str | None, size: int) -> list[bytes]:
    raw, out, i = (text or "").encode("utf-8", "replace").lower(), [], 0
    while i < len(raw):
        j = i + size
        if j < len(raw):
            k = raw.rfind(b" ", i + size // 2, j)
            j = k if k > 0 else j
        out.append(raw[i:j])
        i = j
    return out or [b""]


def digest(text: str | None) -> bytes:
    return blake2b((text or "").encode("utf-8", "replace"), digest_size=16).digest()


def drawn(text: str | None, most: int) -> list[bytes]:
    """At most ``most`` training windows of a text, by a hash of their places, in the text's order."""
    ws = windows(text, TRAIN_WINDOW)
    if len(ws) <= most:
        return ws
    own = digest(text)
    return [ws[i] for i in sorted(sorted(range(len(ws)), key=lambda i: blake2b(b"%d" % i, key=own, digest_size=8).digest())[:most])]


def _dictionary(samples: list[bytes], size: int, bytes_for_one: int) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    size = min(size, max(512, sum(map(len, samples)) // bytes_for_one))
    try:
        return zs.train_dictionary(size, samples, k=SEGMENT, d=MATCH).as_bytes()
    except (zs.ZstdError, ValueError, MemoryError):
        return b"".join(samples)[-size:]


class Scorer:
    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray | None = None):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights
        self._pair = None

    def __getstate__(self):
        return self.ordinary, self.toxic, self.weights

    def __setstate__(self, state):
        self.ordinary, self.toxic, self.weights = state
        self._pair = None

    def _compressors(self):
        if self._pair is None:
            how = zs.ZstdCompressionParameters(
                window_log=WINDOW_LOG, hash_log=HASH, chain_log=CHAIN, search_log=SEARCH, min_match=4, target_length=32, strategy=zs.STRATEGY_LAZY2,
                write_content_size=False, write_checksum=False, write_dict_id=False, format=zs.FORMAT_ZSTD1_MAGICLESS)
            pair = []
            for content in (self.ordinary, self.toxic + self.ordinary):
                d = None
                if len(content) >= 8:
                    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
                    d.precompute_compress(compression_params=how)
                pair.append(zs.ZstdCompressor(dict_data=d, compression_params=how).compress)
            self._pair = pair
        return self._pair

    def features(self, text: str | None) -> list[float]:
        a, b = self._compressors()
        out = [1.0]
        for size in WINDOWS:
            ws = windows(text, size)
            d = np.array([len(a(w)) - len(b(w)) for w in ws], float)
            gain = np.clip(d, 0, None)
            top = np.sort(d)[::-1][:4]
            out += [d.max(), top.mean(), d.mean(), gain.mean(), (d >= 4).mean(), np.log1p((d >= 4).sum()), np.log(len(ws))]
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method."""
    mean, dev = x.mean(0), x.std(0)
    mean[0], dev = 0.0, np.where(dev > 0, dev, 1.0)
    dev[0] = 1.0
    z, b = (x - mean) / dev, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        hess = (z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge * np.eye(len(b))
        step = np.linalg.solve(hess, z.T @ (w * (y - p)) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    out = b / dev
    out[0] = b[0] - (b[1:] * mean[1:] / dev[1:]).sum()
    return out


def trained(rows: Iterable[tuple[bytes, list[bytes], int]]) -> Scorer:
    """The two dictionaries of (digest, training windows, label) rows; without weights."""
    samples, seen = ([], []), set()
    for own, ws, y in rows:
        if (own, y) not in seen:
            seen.add((own, y))
            samples[y].extend(ws)
    return Scorer(_dictionary(samples[0], ORDINARY_BYTES, BYTES_FOR_ONE[0]), _dictionary(samples[1], TOXIC_BYTES, BYTES_FOR_ONE[1]))


def dictionaries(rows: list[tuple[str, int]]) -> Scorer:
    """The two dictionaries of (text, label) rows; without weights."""
    return trained((digest(text), drawn(text, TEXT_WINDOWS[y]), y) for text, y in rows)


def folded(rows: list[tuple[bytes, list[bytes], int]]) -> list[Scorer]:
    """For each fold the dictionaries of the other folds, then those of all rows."""
    out = []
    for k in range(FOLDS):
        others = [r for i, r in enumerate(rows) if i % FOLDS != k]
        out.append(trained(others if len({y for *_, y in others}) == 2 else rows))
    return [*out, trained(rows)]


def calibrated(scorer: Scorer, x: list[list[float]], y: list[int], share: float) -> Scorer:
    x, y = np.array(x), np.array(y, float)
    weight = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    scorer.weights = logistic(x, y, weight)
    return scorer


def train(rows: list[tuple[str, int]], share: float) -> Scorer:
    """rows: (text, label), both labels present; share: the toxic share of all labelled rows.

    For the calibration each fold is measured with the dictionaries of the other folds; those of all rows score.
    """
    scorers = folded([(digest(t), drawn(t, TEXT_WINDOWS[y]), y) for t, y in rows])
    return calibrated(scorers[-1], [scorers[i % FOLDS].features(t) for i, (t, _) in enumerate(rows)], [y for _, y in rows], share)


def windows_of(docs: DataFrame, sample: DataFrame) -> list:
    """Rows (doc_id, toxic, h, own = digest, ws = training windows) of the sample, one a doc_id, in the order of h."""
    def cut(batches):
        least: dict[int, bytes] = {}
        for batch in batches:
            out = []
            for i, y, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "h", "text"))):
                own = digest(text)
                if own < least.get(i, b"\xff" * 17):
                    least[i] = own
                    out.append((i, y, h, own, drawn(text, TEXT_WINDOWS[y])))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
            columns = zip(*out) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "toxic", "h", "own", "ws"])

    found = sampled(docs, sample).mapInArrow(tidy(cut), "doc_id long, toxic int, h long, own binary, ws array<binary>")
    found = found.groupBy("doc_id", "toxic", "h").agg(F.min(F.struct("own", "ws")).alias("least")).select("doc_id", "toxic", "h", "least.*")
    return sorted(found.collect(), key=lambda r: (r["h"], r["doc_id"]))


def measured(docs: DataFrame, sample: DataFrame, rows: list, scorers: list[Scorer]) -> list[list[float]]:
    """The features of each row's whole text, by the dictionaries of the folds it is not in."""
    held = docs.sparkSession.sparkContext.broadcast(({r["doc_id"]: (i % FOLDS, bytes(r["own"])) for i, r in enumerate(rows)}, scorers[:FOLDS]))

    def run(batches):
        (turns, by_fold), done = held.value, set()
        for batch in batches:
            ids, out = [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if i not in done and digest(text) == turns[i][1]:
                    done.add(i)
                    ids.append(i)
                    out.append(by_fold[turns[i][0]].features(text))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "x"])

    found = sampled(docs, sample).select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, x array<double>")
    x = {r["doc_id"]: r["x"] for r in found.groupBy("doc_id").agg(F.first("x").alias("x")).collect()}
    return [x[r["doc_id"]] for r in rows]


def sampled(docs: DataFrame, sample: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(sample, "doc_id").select("doc_id", "toxic", F.xxhash64("doc_id", F.lit("turn")).alias("h"), "text")


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Scorer:
    """Learn from the labelled rows whose crc32(doc_id as text) mod 4 is not 2."""
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        (F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("toxic").isin(0, 1))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = counts.get(1, 0) / total if total else 0.0
        logit = np.log(max(share, 1e-12)) - np.log(max(1 - share, 1e-12))
        return Scorer(b"", b"", np.array([logit] + [0.0] * (FEATURES - 1)))
    hashed = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) / float(1 << 20)
    part = F.when(F.col("toxic") == 1, fit_docs / counts[1]).otherwise(fit_docs / counts[0])
    sample = small_side(saved(marks.where(hashed < part), "sample"), 16)
    rows = windows_of(docs, sample)
    if len({r["toxic"] for r in rows}) < 2:
        return Scorer(b"", b"", np.array([np.log(counts[1] / counts[0])] + [0.0] * (FEATURES - 1)))
    scorers = folded([(bytes(r["own"]), r["ws"], r["toxic"]) for r in rows])
    return calibrated(scorers[-1], measured(docs, sample, rows, scorers), [r["toxic"] for r in rows], counts[1] / total)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels")))

    def run(batches):
        for batch in batches:
            score = held.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"))
    return rows.select("doc_id", "text", "held_out").mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")
