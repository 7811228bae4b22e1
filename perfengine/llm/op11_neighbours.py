"""Approximate nearest neighbours by NN-descent and greedy graph search (operator 11).

Graph: every distinct vector is a node with a list of ``DEGREE`` neighbours. The lists start with the nearest of random
blocks. In each round a node is told its members (its neighbours, and up to ``REVERSE`` of those it is a neighbour of) by
a join with their vectors; members of which one is new to the node are compared with each other, and pairs that would
enter a list are sent to it. What one task has for a node is merged before it is sent. Rounds end when less than
``CHANGE`` of the entries are new. Any choice among equals is by smaller node.

Search: each query holds a beam of the ``BEAM`` nearest nodes seen. In each round the ``WIDTH`` nearest that are not
expanded yet are joined with their neighbours in either direction, these with their vectors, and the beam is cut again, until all of it is
expanded. It starts from the nearest of ``ENTRIES`` nodes drawn by hash, and, for a query that is a node, from its own
list. The nodes that may be among the nearest are compared once more on the original vectors in double precision.

Graph distances are of float32 vectors, moved to their mean and scaled by their largest component. Equal vectors are
one node, found exactly; a node answers with its smallest vec_ids, so copies are never lost and a hot vector costs no more than
any other. Every vector is in the graph; the recall is measured in the tests and the README.

Nulls: a null vec_id, and a vector that is null, empty, zero or has null or non-finite components takes no part; nor does one of
another length than the commonest (of equally common ones the longest). Of several vectors with one vec_id one is taken, by
the smallest digest. With fewer candidates than asked for all are returned; an empty table gives an empty result. Only the two
named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfengine.llm.common import bounded_batches, saved, table, tidy

NEAREST, EVERY = 10, 100
DEGREE, REVERSE, SENT = 24, 24, 4
ROUNDS, CHANGE = 30, 0.02
#: Nodes of a random block, and draws of blocks, that the first lists come from.
BLOCK, DRAWS = 512, 2
BEAM, WIDTH, ENTRIES, STEPS = 512, 128, 256, 200
#: Nodes, and queries, of a partition: what a task holds in memory.
PART_NODES, PART_QUERIES = 2048, 32
#: Squared distances so much above the last wanted one are compared exactly too.
MARGIN = 0.01

_STATE = "node long, vec binary, ids array<long>, ds array<float>, fresh array<boolean>, worst float"


def _floats(column: pa.Array, kind) -> np.ndarray:
    """The non-null vectors of a binary column one after another."""
    column = column.drop_null()
    if not len(column):
        return np.empty(0, kind)
    large = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(kind)


def _binaries(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in rows]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


def _packed(batches):
    for batch in batches:
        out = []
        for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
            if i is None or not x.is_valid or not len(x) or x.values.null_count:
                continue
            v = x.values.to_numpy() + 0.0
            if np.isfinite(v).all() and v.any():
                raw = v.tobytes()
                out.append((i, len(v), hashlib.blake2b(raw, digest_size=16).digest(), raw))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["vec_id", "size", "digest", "vec"])


def _sums(batches):
    total, n, most = 0.0, 0, 0.0
    for batch in batches:
        if len(batch):
            v = _floats(batch.column("vec"), np.float64).reshape(len(batch), -1)
            total, n, most = total + v.sum(0), n + len(v), max(most, float(np.abs(v).max()))
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([n]), pa.array([most])], ["total", "n", "most"])


def _scaled(mean, scale):
    def run(batches):
        for batch in batches:
            if len(batch):
                v = _floats(batch.column("vec"), np.float64).reshape(len(batch), -1)
                v = ((v / scale - mean) / 2).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(_binaries(v), pa.binary())], ["node", "vec"])
    return run


def _whole(batches, names):
    """All rows of a partition: partitions are cut to what a task can hold."""
    rows = [b.select(names) for b in batches if len(b)]
    return pa.Table.from_batches(rows).combine_chunks().to_batches()[0] if rows else None


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(-1)[..., :, None] + (y * y).sum(-1)[..., None, :] - 2 * (x @ np.swapaxes(y, -1, -2)), 0)


def _smallest(group: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` smallest (d, id) of each group, ordered, an id of a group once."""
    order = np.lexsort((d, ids, group))
    order = order[np.r_[True, (group[order][1:] != group[order][:-1]) | (ids[order][1:] != ids[order][:-1])]] if len(order) else order
    order = order[np.lexsort((ids[order], d[order], group[order]))]
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    return order[np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)])) < k]


def _by_node(node: np.ndarray, ids: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    """One row a node of entries that are grouped by node."""
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[first, len(node)])
    return pa.RecordBatch.from_arrays([pa.array(node[first]), _lists(ids, sizes), _lists(d.astype(np.float32), sizes)], ["node", "ids", "ds"])


def _first_lists(k: int):
    def run(batches):
        rows = _whole(batches, ["node", "vec"])
        if rows is None:
            return
        node = rows.column("node").to_numpy()
        vec = _floats(rows.column("vec"), np.float32).reshape(len(node), -1)
        order = np.argsort(node)
        for part in np.array_split(order, max(1, len(order) // BLOCK)):
            d = _squared(x := vec[part].astype(np.float64), x)
            np.fill_diagonal(d, np.inf)
            m = min(k, len(part) - 1)
            if m:
                near = np.argpartition(d, m - 1, 1)[:, :m]
                yield _by_node(np.repeat(node[part], m), node[part][near].ravel(), np.take_along_axis(d, near, 1).ravel())
    return run


def _local_join(degree: int, sent: int):
    """Pairs of members of one centre, one of them new to it, that are nearer than the last entry of a member's list."""
    def run(batches):
        rows = _whole(batches, ["centre", "member", "fresh", "worst", "vec"])
        if rows is None:
            return
        centre, member, worst = (rows.column(c).to_numpy() for c in ("centre", "member", "worst"))
        fresh = rows.column("fresh").to_numpy(zero_copy_only=False)
        vec = _floats(rows.column("vec"), np.float32).reshape(len(centre), -1)
        order = np.lexsort((member, centre))
        first = np.flatnonzero(np.r_[True, centre[order][1:] != centre[order][:-1]])
        sizes = np.diff(np.r_[first, len(order)])
        found = [], [], []
        by_size = np.argsort(sizes, kind="stable")
        for part in np.array_split(by_size, max(1, len(by_size) // 256)):
            width = int(sizes[part].max())
            at = first[part, None] + np.minimum(np.arange(width), sizes[part, None] - 1)
            there = np.arange(width) < sizes[part, None]
            at = order[at]
            m, f = member[at], fresh[at] & there
            d = _squared(x := vec[at].astype(np.float64), x)
            ok = (f[:, :, None] | f[:, None, :]) & there[:, :, None] & there[:, None, :] & (m[:, :, None] != m[:, None, :])
            d = np.where(ok & (d < worst[at][:, :, None]), d, np.inf)
            top = np.argpartition(d, min(sent, width) - 1, 2)[:, :, :sent]
            value = np.take_along_axis(d, top, 2)
            keep = np.isfinite(value)
            found[0].append(np.broadcast_to(m[:, :, None], top.shape)[keep])
            found[1].append(np.take_along_axis(np.broadcast_to(m[:, None, :], d.shape), top, 2)[keep])
            found[2].append(value[keep])
        a, b, d = map(np.concatenate, found)
        if len(a):
            keep = _smallest(a, d, b, degree)
            yield _by_node(a[keep], b[keep], d[keep])
    return run


def _merge(degree: int):
    """The lists of a partition's nodes with what was found for them; only rows of nodes have a vector."""
    def run(batches):
        rows = _whole(batches, ["node", "vec", "ids", "ds", "fresh"])
        if rows is None:
            return
        own = rows.column("vec").is_valid().to_numpy(zero_copy_only=False)
        node = rows.column("node").to_numpy()
        lengths = np.diff(rows.column("ids").offsets.to_numpy())
        row = np.repeat(np.arange(len(node)), lengths)
        ids, d = (rows.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "ds"))
        names = node[own]
        order = np.argsort(names)
        group = order[np.searchsorted(names[order], node)][row]
        old = own[row]
        # an entry that was there already is not new again: of equal ids the old one comes first
        rank = np.lexsort((~old, ids, group))
        rank = rank[np.r_[True, (group[rank][1:] != group[rank][:-1]) | (ids[rank][1:] != ids[rank][:-1])]] if len(rank) else rank
        keep = rank[_smallest(group[rank], d[rank], ids[rank], degree)]
        sizes = np.bincount(group[keep], minlength=len(names))
        last = np.cumsum(sizes) - 1
        worst = np.where(sizes == degree, d[keep][np.maximum(last, 0)] if len(keep) else np.inf, np.inf).astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), rows.column("vec").drop_null(), _lists(ids[keep], sizes), _lists(d[keep].astype(np.float32), sizes), _lists(~old[keep], sizes), pa.array(worst)],
            ["node", "vec", "ids", "ds", "fresh", "worst"])
    return run


def _members(state: DataFrame, reverse: int) -> DataFrame:
    """(centre, member, fresh): a node's neighbours, and up to ``reverse`` nodes that have it as theirs, new ones first."""
    forward = state.select("node", F.inline(F.arrays_zip("ids", "fresh"))).toDF("centre", "member", "fresh")
    backward = forward.select(F.col("member").alias("centre"), F.col("centre").alias("member"), "fresh")
    order = Window.partitionBy("centre").orderBy(F.col("fresh").desc(), F.xxhash64("centre", "member"), "member")
    backward = backward.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= reverse).drop("_r")
    return forward.unionByName(backward)


def _free(spark: SparkSession, old: DataFrame | None) -> None:
    """Delete a table that a later one has replaced."""
    for name in old.inputFiles()[:1] if old is not None else ():
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def build_graph(nodes: DataFrame, count: int, degree: int = DEGREE, reverse: int = REVERSE, change: float = CHANGE, rounds: int = ROUNDS) -> DataFrame:
    """NN-descent over (node, vec): each node with its neighbours ``ids``, nearest first, and squared distances ``ds``."""
    parts = max(1, math.ceil(count / PART_NODES))
    link = "node long, ids array<long>, ds array<float>"

    def merged(base: DataFrame, found: DataFrame, name: str) -> DataFrame:
        none = found.select("node", F.lit(None).cast("binary").alias("vec"), "ids", "ds", F.transform("ids", lambda x: F.lit(True)).alias("fresh"))
        rows = base.select("node", "vec", "ids", "ds", F.transform("ids", lambda x: F.lit(False)).alias("fresh")).unionByName(none)
        return saved(rows.repartition(parts, "node").mapInArrow(tidy(_merge(degree)), _STATE), name)

    first = None
    for draw in range(DRAWS):
        part = nodes.repartition(parts, F.xxhash64("node", F.lit(draw))).mapInArrow(tidy(_first_lists(math.ceil(degree / DRAWS))), link)
        first = part if first is None else first.unionByName(part)
    state = merged(nodes.select("node", "vec", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("ds")), first, "graph-0")
    for n in range(rounds):
        vectors = state.select(F.col("node").alias("member"), "vec", "worst")
        met = _members(state, reverse).join(vectors, "member").select("centre", "member", "fresh", "worst", "vec")
        found = met.repartition(parts, "centre").mapInArrow(tidy(_local_join(degree, SENT)), link)
        old, state = state, merged(state, found, f"graph-{n + 1}")
        _free(state.sparkSession, old)
        new, size = state.select(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("ids"))).first()
        if not new or new < change * size:
            break
    return state


def _expand(beam: int, width: int):
    """Beams (rows with ``ids``) with the nodes found for them (rows with ``id``), cut and with the next nodes to expand."""
    def run(batches):
        rows = _whole(batches, ["query", "vec", "ids", "ds", "done", "id", "found"])
        if rows is None:
            return
        query, own = rows.column("query").to_numpy(), rows.column("id").is_null().to_numpy(zero_copy_only=False)
        order = np.argsort(query, kind="stable")
        first = np.flatnonzero(np.r_[True, query[order][1:] != query[order][:-1]])
        vec = _floats(rows.column("vec"), np.float32).reshape(own.sum(), -1)
        found = _floats(rows.column("found"), np.float32).reshape((~own).sum(), vec.shape[1])
        place = np.where(own, np.cumsum(own), np.cumsum(~own)) - 1
        node = rows.column("id").fill_null(0).to_numpy()
        out = []
        for group in np.split(order, first[1:]):
            lead, more = group[own[group]][0], group[~own[group]]
            ids, d, done = (np.array(rows.column(c)[lead].as_py(), t) for c, t in (("ids", np.int64), ("ds", np.float32), ("done", bool)))
            x = vec[place[lead]].astype(np.float64)
            new = _squared(x[None], found[place[more]].astype(np.float64))[0].astype(np.float32)
            ids, d = np.r_[ids, node[more]], np.r_[d, new]
            done = np.r_[done, np.zeros(len(more), bool)]
            once = np.lexsort((~done, ids))
            once = once[np.r_[True, ids[once][1:] != ids[once][:-1]]]
            best = once[np.lexsort((ids[once], d[once]))][:beam]
            ids, d, done = ids[best], d[best], done[best]
            next_ = np.flatnonzero(~done)[:width]
            done[next_] = True
            out.append((int(query[lead]), x.astype(np.float32).tobytes(), ids, d, done, ids[next_]))
        columns = zip(*out)
        kinds = (pa.int64(), pa.binary(), *(pa.list_(t) for t in (pa.int64(), pa.float32(), pa.bool_(), pa.int64())))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["query", "vec", "ids", "ds", "done", "next"])
    return run


def search_graph(graph: DataFrame, queries: DataFrame, count: int, beam: int = BEAM, width: int = WIDTH, entries: int = ENTRIES) -> DataFrame:
    """(query, ids, ds): the beam of each query (query, vec) over the graph; ``count`` queries. A query that names a node starts there."""
    spark = graph.sparkSession
    # the entries: a bounded sample, compared with every query
    sample = graph.select("node", "vec").orderBy(F.xxhash64("node", F.lit(7)), "node").limit(entries)
    sample = [(r.node, bytes(r.vec)) for r in sample.collect()]
    sent = spark.sparkContext.broadcast((np.array([n for n, _ in sample]), np.frombuffer(b"".join(v for _, v in sample), np.float32).reshape(len(sample), -1)))

    def enter(batches):
        names, vecs = sent.value
        for batch in batches:
            if len(batch):
                d = _squared(_floats(batch.column("vec"), np.float32).reshape(len(batch), -1).astype(np.float64), vecs.astype(np.float64))
                near = np.argsort(d, 1, kind="stable")[:, :DEGREE]
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("vec"), pa.array(list(names[near]), pa.list_(pa.int64())),
                                                  pa.array(list(np.take_along_axis(d, near, 1).astype(np.float32)), pa.list_(pa.float32()))], ["query", "vec", "ids", "ds"])

    started = queries.mapInArrow(tidy(enter), "query long, vec binary, ids array<long>, ds array<float>")
    own = graph.select(F.col("node").alias("query"), F.concat(F.array("node"), "ids").alias("_i"), F.concat(F.array(F.lit(0.0).cast("float")), "ds").alias("_d"))
    none = F.array()
    started = started.join(own, "query", "left").select(
        "query", "vec", F.concat("ids", F.coalesce("_i", none.cast("array<long>"))).alias("ids"), F.concat("ds", F.coalesce("_d", none.cast("array<float>"))).alias("ds"))
    started = started.withColumn("done", F.transform("ids", lambda x: F.lit(False)))
    links = saved(_members(graph, REVERSE).select(F.col("centre").alias("node"), "member").distinct().groupBy("node").agg(F.collect_list("member").alias("near")), "links")
    vectors = graph.select(F.col("node").alias("id"), F.col("vec").alias("found"))
    parts = max(1, math.ceil(count / PART_QUERIES))
    beams = "query long, vec binary, ids array<long>, ds array<float>, done array<boolean>, next array<long>"
    state, old = started, None
    pairs = None
    for n in range(STEPS):
        rows = state.select("query", "vec", "ids", "ds", "done", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("found"))
        if pairs is not None:
            rows = rows.unionByName(pairs, allowMissingColumns=True)
        old, state = (state if n else None), saved(rows.repartition(parts, "query").mapInArrow(tidy(_expand(beam, width)), beams), f"beam-{n}")
        _free(spark, old)
        if not state.where(F.size("next") > 0).limit(1).count():
            break
        asked = state.select("query", F.explode("next").alias("node"))
        pairs = asked.join(links, "node").select("query", F.explode("near").alias("id")).distinct().join(vectors, "id").select("query", "id", "found")
    return state.select("query", "ids", "ds")


def _exact(batches):
    for batch in batches:
        if len(batch):
            x, y = (_floats(batch.column(c), np.float64).reshape(len(batch), -1) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(np.sqrt(((x - y) ** 2).sum(1)))], ["query", "node", "score"])


def nearest(rows: DataFrame, is_query, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of (vec_id, embedding) for each row where ``is_query`` holds."""
    spark = rows.sparkSession
    bounded_batches(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = rows.mapInArrow(tidy(_packed), "vec_id long, size int, digest binary, vec binary")
    rows = saved(rows.groupBy("vec_id").agg(F.min(F.struct("digest", "size", "vec")).alias("p")).select("vec_id", "p.*"), "vectors")
    size = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if size is None:
        return empty
    rows = rows.where(F.col("size") == size["size"])
    # the smallest ids of each distinct vector; the first names its node
    by_id = Window.partitionBy("digest").orderBy("vec_id")
    copies = saved(rows.select("digest", "vec_id").withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= k + 1), "copies")
    names = copies.where("_r = 1").select("digest", F.col("vec_id").alias("node"))
    originals = saved(rows.join(copies.where("_r = 1").select("vec_id"), "vec_id").select(F.col("vec_id").alias("node"), "vec"), "originals")
    copies = copies.join(names, "digest").select("node", "vec_id")
    asked = saved(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "digest").join(names, "digest").select("query_id", F.col("node").alias("query")), "queries")
    parts = originals.mapInArrow(tidy(_sums), "total binary, n long, most double").collect()
    count = sum(r.n for r in parts)
    scale = max(r.most for r in parts)
    mean = sum(np.frombuffer(r.total) / scale for r in parts) / count
    nodes = originals.mapInArrow(tidy(_scaled(mean, scale)), "node long, vec binary")
    graph = build_graph(nodes, count)
    queries = asked.select("query").distinct().join(graph.select(F.col("node").alias("query"), "vec"), "query")
    beams = search_graph(graph, queries, asked.count())
    # squared distances of the beam ascend; its first nodes may hold the k wanted besides the query's own
    last = F.element_at("ds", F.least(F.lit(k + 1), F.size("ds")))
    near = beams.select("query", last.alias("_last"), F.inline(F.arrays_zip("ids", "ds"))).where(F.col("ds") <= F.col("_last") * (1 + MARGIN)).select("query", F.col("ids").alias("node"))
    both = near.join(originals.select("node", F.col("vec").alias("y")), "node").join(originals.select(F.col("node").alias("query"), F.col("vec").alias("x")), "query")
    scores = saved(both.select("query", "node", "x", "y").mapInArrow(tidy(_exact), "query long, node long, score double"), "scores")
    out = asked.join(scores.join(copies, "node"), "query").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op11_neighbours``: the 10 nearest of all embeddings for those whose vec_id is divisible by 100."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
