"""Spelling variants by blocked Gram matrices of letter counts (operator 12).

Two words are near if one code point is inserted, deleted or replaced between them. Their letter counts then differ by
a squared distance of at most two, and their lengths by at most one. The counts of a few letter groups are block
keys: near words lie in the same block or in adjacent ones (one group up, or one up and another down), so only
those are compared and no near pair is lost. Blocks are dealt to tasks by the counts of the three ``COARSE`` groups; a
block of more than ``SLICE_BYTES`` of words is cut by hash. Inside a task the words are blocked once more by the
counts of the ``FINE`` groups; for every pair of adjacent blocks one NumPy product of the count matrices gives all squared
distances, pairs of at most two are kept, and the words themselves are compared.

Each pair of adjacent blocks meets in one task only: where the owner is the smaller in (length, then the direction
list). The roots follow the forms by pointer doubling; a form has ten times the occurrences, so chains are short.

Nulls: a null text has no words; a null doc_id counts as the empty text. Repeated rows count again. Without words of
enough occurrences the result is empty. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfengine.llm.common import bounded_batches, saved, table, tidy

LENGTH, LEAST, TIMES = 7, 2, 10
DELETED = 31
#: Bytes of words that a task holds as owners of a block; guests pass by in Arrow batches.
SLICE_BYTES = 1 << 20
#: Distinct words that a counting task holds before it hands them on.
HELD = 400_000
#: Letter groups of about equal frequency; letters in none belong to the last one. Any grouping gives the same pairs.
FINE = ("e", "sm", "tl", "aq", "np", "ih", "rgu", "odc", "")
COARSE = ((0, 1, 2), (3, 4, 5), (6, 7, 8))
#: Letters other than a-z are counted in so many columns; merged columns can only lower a distance.
OTHERS = 6

_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LENGTH},}}")
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_GROUP = np.full(0x100, len(FINE) - 1, np.int64)
for _g, _letters in enumerate(FINE):
    for _c in _letters:
        _GROUP[ord(_c)] = _g
_COARSE = np.array([next(k for k, part in enumerate(COARSE) if g in part) for g in _GROUP])
_COLUMN = np.array([c - 97 if 97 <= c <= 122 else 26 + c % OTHERS for c in range(0x100)])
#: One count a field of seven bits; sums may run over into the next field, but adjacent blocks stay adjacent.
_FIELD = np.array([1 << 7 * g for g in range(len(FINE))], np.int64)


def words_of(doc_id: int | None, raw: bytes) -> Iterator[tuple[str, int]]:
    """The words of a text with their occurrences: long runs in lower case, some with one code point deleted."""
    prefix = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for word, n in Counter(_RUN.findall(raw.translate(_LOWER).decode())).items():
        h = zlib.crc32(word.encode(), prefix)
        if h % DELETED == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < LENGTH:
                continue
        yield word, n


def _count(batches):
    held: Counter = Counter()

    def rows():
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary() if pa.types.is_large_string(batch.column("text").type) else pa.binary())
        for doc, raw in zip(batch.column("doc_id").to_pylist(), texts.to_pylist()):
            for word, n in words_of(doc, raw) if raw else ():
                held[word] += n
            if len(held) > HELD:
                yield from rows()
    if held:
        yield from rows()


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n) of all words of the documents (doc_id, text) with at least ``least`` occurrences."""
    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_count), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and the lengths."""
    raw = "".join(words).encode("utf-32-le")
    return np.frombuffer(raw, np.uint32).astype(np.int64), np.array([len(w) for w in words], np.int64)


def _keyed(batches):
    for batch in batches:
        flat, lengths = _codes(batch.column("word").to_pylist())
        row = np.repeat(np.arange(len(lengths)), lengths)
        counts = np.bincount(row * 3 + _COARSE[flat], minlength=3 * len(lengths)).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), *(pa.array(c) for c in counts.T)], ["word", "n", "c0", "c1", "c2"])


#: Directions from an owner's coarse block to a guest's, each unordered pair of blocks once.
DIRECTIONS = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, -1, 0), (1, 0, -1), (0, 1, -1)]


def _fine_steps(direction: tuple[int, int, int]) -> np.ndarray:
    """Differences of fine keys, guest's less owner's, that one edit can make in this direction."""
    up, down = [k for k in range(3) if direction[k] == 1], [k for k in range(3) if direction[k] == -1]
    if up and down:
        return np.array([_FIELD[i] - _FIELD[j] for i in COARSE[up[0]] for j in COARSE[down[0]]])
    if up:
        return np.array([_FIELD[i] for i in COARSE[up[0]]])
    return np.array([0, *(_FIELD[i] - _FIELD[j] for part in COARSE for i in part for j in part if i != j)])


_STEPS = [_fine_steps(d) for d in DIRECTIONS]


class Block:
    """Words of one length as code points, letter counts and fine keys, ordered by key."""

    def __init__(self, words: list[str], ns: np.ndarray):
        flat, lengths = _codes(words)
        size, length = len(words), int(lengths[0])
        row = np.repeat(np.arange(size), lengths)
        key = (np.bincount(row * len(FINE) + _GROUP[flat], minlength=size * len(FINE)).reshape(size, -1) * _FIELD).sum(1)
        order = np.argsort(key, kind="stable")
        counts = np.bincount(row * (26 + OTHERS) + _COLUMN[flat], minlength=size * (26 + OTHERS)).reshape(size, -1).astype(np.float64)
        self.words, self.n = np.array(words, object)[order], ns[order]
        self.codes, self.counts = flat.reshape(size, length)[order], counts[order]
        self.squares = (self.counts**2).sum(1)
        self.keys, self.starts = np.unique(key[order], return_index=True)
        self.ends = np.r_[self.starts[1:], size]


def edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words of each row are one edit apart; ``b`` has as many code points as ``a``, or one more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    head = np.cumprod(a == b[:, :-1], 1).sum(1)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], 1).sum(1)
    return head + tail >= a.shape[1]


def near(owner: Block, guest: Block, steps: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of near words in adjacent fine blocks; ``same``: both are one block, pairs once."""
    left, right = [], []
    for step in steps:
        if same and step < 0:
            continue  # the other way round has it
        at = np.searchsorted(guest.keys, owner.keys + step)
        at[at == len(guest.keys)] = 0
        for i in np.flatnonzero(guest.keys[at] == owner.keys + step):
            a0, a1, b0, b1 = owner.starts[i], owner.ends[i], guest.starts[at[i]], guest.ends[at[i]]
            for a in range(a0, a1, 1024):
                for b in range(b0, b1, 4096):
                    x, y = slice(a, min(a1, a + 1024)), slice(b, min(b1, b + 4096))
                    squared = owner.counts[x] @ guest.counts[y].T
                    squared *= -2
                    squared += owner.squares[x, None]
                    squared += guest.squares[None, y]
                    p, q = np.nonzero(squared <= 2)
                    if len(p):
                        p, q = p + a, q + b
                        if same and not step:
                            p, q = p[p < q], q[p < q]
                        ok = edits(owner.codes[p], guest.codes[q])
                        left.append(p[ok])
                        right.append(q[ok])
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _pairs(batches):
    """Near pairs of each (block, slice): rows come sorted by it, owners (direction -1) first."""
    owner, at, waiting = None, None, []

    def out(a: Block, b: Block, i, j):
        if len(i):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[a.words[i], b.words[j]], pa.string()), pa.array(np.r_[b.words[j], a.words[i]], pa.string()), pa.array(np.r_[b.n[j], a.n[i]])],
                ["word", "other", "other_n"])

    def closed():
        nonlocal owner, waiting
        if waiting:
            owner = Block([w for ws, _ in waiting for w in ws], np.concatenate([n for _, n in waiting]))
            waiting = []
            yield from out(owner, owner, *near(owner, owner, _STEPS[0], True))

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("length", "c0", "c1", "slice", "direction")], 1)
        n, words = batch.column("n").to_numpy(), batch.column("word").to_pylist()
        bounds = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                continue
            block, direction = tuple(keys[a, :4]), keys[a, 4]
            if block != at:
                yield from closed()
                owner, at = None, block
            if direction < 0:
                waiting.append((words[a:b], n[a:b]))
                continue
            yield from closed()
            guest = Block(words[a:b], n[a:b])
            yield from out(owner, guest, *near(owner, guest, _STEPS[direction], False))
    yield from closed()


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other, other_n): both ways of every near pair of the distinct words (word, n)."""
    block = ["length", "c0", "c1"]
    keyed = words.mapInArrow(tidy(_keyed), "word string, n long, c0 long, c1 long, c2 long").withColumn("length", F.expr("c0 + c1 + c2"))
    keyed = saved(keyed, "words")
    slices = F.ceil(F.sum("length") / F.lit(SLICE_BYTES)).cast("long")
    sizes = saved(keyed.groupBy(*block).agg(slices.alias("slices")), "blocks")
    own = F.pmod(F.xxhash64("word"), F.col("slices"))
    columns = [*block, "slice", "direction", "word", "n"]
    owners = keyed.join(sizes, block).select(*block, own.alias("slice"), F.lit(-1).alias("direction"), "word", "n")
    # a guest of direction d goes to the blocks whose counts are its own less d; a block's own words to its later slices
    targets = F.explode(F.array(*[
        F.struct((F.col("length") - sum(d)).alias("length"), (F.col("c0") - d[0]).alias("c0"), (F.col("c1") - d[1]).alias("c1"), F.lit(i).alias("direction"))
        for i, d in enumerate(DIRECTIONS)]))
    guests = keyed.select(targets.alias("t"), "word", "n").select("t.*", "word", "n").join(sizes, block)
    first = F.when(F.col("direction") == 0, own + 1).otherwise(F.lit(0))
    guests = guests.where(first < F.col("slices")).withColumn("slice", F.explode(F.sequence(first, F.col("slices") - 1)))
    dealt = owners.select(*columns).unionByName(guests.select(*columns))
    return (dealt.repartition(*block, "slice").sortWithinPartitions(*block, "slice", "direction")
            .mapInArrow(tidy(_pairs), "word string, other string, other_n long"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form that follows from each word of (word, form)."""
    at = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = saved(at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if not at.where("_moved").limit(1).count():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the documents (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    words = saved(vocabulary(docs, least), "vocabulary")
    best = F.min(F.struct((-F.col("other_n")).alias("_n"), F.col("other").alias("_w")))
    links = saved(near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_best")), "links")
    named = F.when(-F.col("_best._n") >= times * F.col("n"), F.col("_best"))
    all_words = words.join(links, "word", "left").withColumn("_best", named)
    all_words = saved(all_words.select("word", F.col("_best._w").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                       (-F.col("_best._n")).alias("form_n")), "variants")
    ends = roots(all_words.where(F.col("form").isNotNull()))
    return all_words.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op12_spelling``: the words of all documents with their forms and roots."""
    return variants(table(spark, sf_dir, "documents"))
