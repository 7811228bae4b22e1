"""MinHash near-duplicate groups with sequential Bayesian verification (operator 8).

Documents with equal shingle sets form one class. Classes whose signatures agree on a whole band
are candidates; candidate pairs are compared signature batch by batch and dropped as soon as the
posterior probability of reaching the threshold falls under ``miss``; survivors are compared on
their full shingle sets, and the confirmed links give connected components.

A band's bucket is never paired out: first every member is compared with one centre of its bucket
(``STAR_ROUNDS`` times, each with another centre). Members that are then outside of the bucket's largest
component are compared with those of other components in blocks of about ``BLOCK`` members, inside
tasks, where the survivors are verified too and only links that join components leave. So no candidate
of the banding is lost and a group of thousands of copies costs thousands of rows.

Nulls: a null or empty text, or one of white space only, has the empty set and is linked with
nothing. Rows with a null doc_id take part; a null id never names a component unless no row of it has
one. Repeated rows are copies of each other. Set equality and intersections are taken on 64-bit
shingle hashes (classes on 128-bit digests).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfengine.llm import shingles as S
from perfengine.llm.common import bounded_batches, saved, set_aside, small_side, table, tidy

WORDS, PERCENT = 4, 80
BANDS, ROWS = 28, 5
#: Hashes compared before each look at the posterior.
BATCH = 20
MISS = 1e-6
STAR_ROUNDS, BLOCK = 2, 256
_FACTORS = S.multipliers(BANDS * ROWS, 8)


def least_matches(threshold: float, miss: float, total: int = BANDS * ROWS, batch: int = BATCH) -> list[tuple[int, int]]:
    """(n, fewest matches among n hashes with posterior P(similarity >= threshold) >= miss).

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at the threshold
    is the chance that a binomial of n + 1 trials has at most m successes.
    """
    out = []
    for n in range(batch, total + 1, batch):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _sketch(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw, at in S.chunks(batch.column("text")):
                sets, so = S.distinct(*S.shingle_hashes(*S.word_hashes(raw, at), n_words))
                sig, n = S.signatures(sets, so, _FACTORS), np.diff(so)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, len(n)), pa.array(n), _digests(sets, so),
                     pa.array([s.tobytes() if k else None for s, k in zip(sig, n)], pa.binary())],
                    ["doc_id", "n_shingles", "digest", "sig"])
    return run


def _digests(sets: np.ndarray, at: np.ndarray) -> pa.Array:
    """128-bit digests of the sets; null for empty ones."""
    n = np.diff(at)
    out = np.zeros((len(n), 2), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            out[full, k] = S.mix(np.add.reduceat(S.mix(sets ^ np.uint64(salt)), at[full]) + n[full].astype(np.uint64))
    return pa.array([d.tobytes() if k else None for d, k in zip(out, n)], pa.binary())


def _digested(n_words: int):
    def run(batches):
        for batch in batches:
            for i, raw, at in S.chunks(batch.column("text")):
                sets, so = S.distinct(*S.shingle_hashes(*S.word_hashes(raw, at), n_words))
                yield pa.RecordBatch.from_arrays([_digests(sets, so), batch.column("text").slice(i, len(at) - 1)], ["digest", "text"])
    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), BANDS * ROWS)


def _bands(batches):
    for batch in batches:
        sig = _matrix(batch.column("sig"))
        for band in range(BANDS):
            key = np.full(len(sig), band + 1, np.uint64)
            for r in range(ROWS):
                key = S.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, band * ROWS + r])
            key = (key & ~np.uint64(31)) | np.uint64(band)  # the last bits name the band
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("digest")], ["bucket", "node"])


def _bayes(least):
    def run(batches):
        for batch in batches:
            left, right = _matrix(batch.column("sig_a")), _matrix(batch.column("sig_b"))
            alive, same, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
            for n, m in least:
                same[alive] += (left[alive, done:n] == right[alive, done:n]).sum(1)
                alive, done = alive[same[alive] >= m], n
            yield batch.select(["a", "b"]).take(pa.array(alive))
    return run


def _blocks(least, n_words: int, percent: int):
    """Confirmed links between the components of one group, as many as join them and no more.

    A pair that shares an earlier band is left to that band's bucket, so none is compared twice.
    """
    def run(batches):
        for batch in batches:
            for bucket, group in zip(batch.column("bucket").to_pylist(), batch.column("members").to_pylist()):
                sig = np.frombuffer(b"".join(g["sig"] for g in group), np.uint32).reshape(len(group), -1)
                code = np.unique(np.array([g["root"].hex() for g in group]), return_inverse=True)[1]
                band, sets, found = bucket & 31, {}, []

                def set_of(k, sets=sets, group=group):
                    if k not in sets:
                        sets[k] = next(S.text_sets(pa.array([group[k]["text"]], pa.string()), n_words))
                    return sets[k]

                for i in range(len(group)):
                    if group[i]["main"]:
                        continue
                    rest, same, done = np.flatnonzero(code != code[i]), 0, 0
                    for n, m in least:
                        same = same + (sig[rest, done:n] == sig[i, done:n]).sum(1)
                        keep = same >= m
                        rest, same, done = rest[keep], same[keep], n
                    before = (sig[rest, : band * ROWS] == sig[i, : band * ROWS]).reshape(len(rest), band, ROWS)
                    new = ~before.all(2).any(1)
                    for j in rest[new][np.argsort(-same[new], kind="stable")]:
                        if code[j] == code[i]:
                            continue  # joined meanwhile
                        x, y = set_of(i), set_of(int(j))
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * both >= percent * (len(x) + len(y) - both):
                            code[code == code[j]] = code[i]
                            found.append(sorted((group[i]["node"], group[j]["node"])))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])
    return run


def _exact(n_words: int, percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(S.text_sets(batch.column("text_a"), n_words), S.text_sets(batch.column("text_b"), n_words)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node: alternating large and small stars until nothing moves.

    Each step attaches neighbours to the smallest one known, by aggregates and joins on the edge
    table; the number of steps grows with the logarithm of the longest chain.
    """
    edges, last = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"), None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.crc32(F.concat("u", "v")))).first()
        if mark == last:
            break
        last = mark
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.union(low).distinct(), "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, digest, root, component_id of every row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    least = least_matches(percent / 100, miss)
    rows = saved(docs.mapInArrow(tidy(_sketch(n_words)), "doc_id long, n_shingles long, digest binary, sig binary"), "sketches")
    classes = rows.where("digest is not null").select("digest", "sig").dropDuplicates(["digest"])
    bands = saved(classes.mapInArrow(tidy(_bands), "bucket long, node binary"), "bands")
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = saved(bands.join(shared, "bucket"), "members")
    nodes = saved(members.select("node").distinct(), "candidates")
    wanted = small_side(nodes, 40)
    sigs = saved(rows.select(F.col("digest").alias("node"), "sig").join(wanted, "node", "left_semi")
                 .dropDuplicates(["node"]), "signatures")
    texts = saved(docs.mapInArrow(tidy(_digested(n_words)), "digest binary, text string")
                  .join(wanted, F.col("digest") == F.col("node"), "left_semi")
                  .select(F.col("digest").alias("node"), "text").dropDuplicates(["node"]), "texts")

    def both(pairs: DataFrame, side: DataFrame, what: str) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(side.select(F.col("node").alias(end), F.col(what).alias(f"{what}_{end}")), end)
        return pairs.select("a", "b", f"{what}_a", f"{what}_b")

    def confirmed(survivors: DataFrame) -> DataFrame:
        return both(survivors, texts, "text").mapInArrow(tidy(_exact(n_words, percent)), "a binary, b binary")

    def rooted(found: DataFrame) -> DataFrame:
        """Members of the buckets that still hold more than one component."""
        at = members.join(components(found), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
        at = saved(at, "rooted")
        each = at.groupBy("bucket", "root").agg(F.count("*").alias("n"))
        still = each.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most")).where("n > most.n")
        return saved(at.join(still, "bucket").select("bucket", "node", "root", (F.col("root") == F.col("most.root")).alias("main"),
                                                     F.col("most.n").alias("n_main"), (F.col("n") - F.col("most.n")).alias("n_other")), "open")

    def dealt(at: DataFrame) -> DataFrame:
        """Members by (bucket, x, y): each block of a bucket's largest component with each block of the others (x >= 0),
        and the blocks of the others among themselves (x < 0). A group holds two blocks whatever the bucket's size."""
        mains, others = F.ceil(F.col("n_main") / BLOCK).cast("int"), F.ceil(F.col("n_other") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("node", F.lit("block")), F.when(F.col("main"), mains).otherwise(others)).cast("int")

        def key(x, y):
            return F.struct(x.alias("x"), y.alias("y"))

        of_main = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda y: key(F.col("i"), y))
        of_other = F.concat(F.transform(F.sequence(F.lit(0), F.col("j") - 1), lambda x: key(x, F.col("i"))),
                            F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda y: key(-1 - F.least(F.col("i"), y), F.greatest(F.col("i"), y))))
        at = at.select("bucket", "node", "root", "main", mains.alias("j"), others.alias("k"), own.alias("i"))
        return at.select("bucket", "node", "root", "main", F.explode(F.when(F.col("main"), of_main).otherwise(of_other)).alias("p")).select(
            "bucket", "node", "root", "main", "p.x", "p.y")

    links, at = None, members.withColumn("root", F.col("node"))
    for turn in range(STAR_ROUNDS):
        centre = at.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "root")).alias("c"))
        pairs = (at.join(centre, "bucket").where("root <> c.root")
                 .select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct())
        survivors = saved(both(pairs, sigs, "sig").mapInArrow(tidy(_bayes(least)), "a binary, b binary"), "survivors")
        new = confirmed(survivors)
        links = saved(new if links is None else links.union(new), "links")
        at = rooted(links)

    groups = dealt(at).join(sigs, "node").join(texts, "node").groupBy("bucket", "x", "y").agg(
        F.collect_list(F.struct("node", "root", "main", "sig", "text")).alias("members"))
    links = saved(links.union(groups.select("bucket", "members").mapInArrow(tidy(_blocks(least, n_words, percent)), "a binary, b binary")), "links")

    at = rows.join(components(links), F.col("digest") == F.col("node"), "left").select(
        "doc_id", "n_shingles", "digest", F.coalesce("root", "digest").alias("root"))
    first = at.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("first"))
    return at.join(first, "root", "left").select(
        "doc_id", "n_shingles", "digest", "root", F.coalesce("first", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: doc_id, n_shingles, component_id, kept."""
    return near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: five-word shingles, similarity 0.8 or more; the smallest doc_id of each group stays.

    Rows whose doc_id is null or repeated are told apart by their shingle sets; of those in one group
    one row stays. Rows without words are linked with nothing and stay. Columns may have any further names.
    """
    docs, own = set_aside(docs, {"_id", "_row", "_digest", "_of", "_root"})
    n_words = 5
    found = saved(near_groups(docs, n_words), "groups")
    leads = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = saved(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and(leads).alias("leads")), "ids")
    odd = F.col("doc_id").isNull() | (F.col("n") > 1)
    gone = saved(ids.where(odd | ~F.col("leads")).select(F.col("doc_id").alias("_id")), "gone")
    once = docs.join(small_side(gone, 16), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_anti")
    again = saved(ids.where(odd).select(F.col("doc_id").alias("_id")), "again")
    if again.isEmpty():
        return once.select(*own)
    rows = docs.join(small_side(again, 16), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi")
    rows = rows.withColumn("_row", F.struct(*rows.columns)).select("_row", F.col("_row.text").cast("string").alias("text"))

    def digested(batches):
        for batch in batches:
            for i, raw, at in S.chunks(batch.column("text")):
                sets = S.distinct(*S.shingle_hashes(*S.word_hashes(raw, at), n_words))
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(i, len(at) - 1), _digests(*sets)], ["_row", "_digest"])

    rows = rows.mapInArrow(tidy(digested), T.StructType([T.StructField("_row", rows.schema["_row"].dataType), T.StructField("_digest", T.BinaryType())]))
    lead = found.where(leads & F.col("digest").isNotNull()).select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_of"), F.col("root").alias("_root")).distinct()
    some = rows.where("_digest is not null").join(
        lead, (F.col("_digest") == F.col("_of")) & F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id"))).dropDuplicates(["_root"])
    return once.unionByName(some.select("_row.*")).unionByName(rows.where("_digest is null").select("_row.*")).select(*own)
