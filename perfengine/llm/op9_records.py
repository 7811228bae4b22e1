"""Token ids in length-delimited binary records with a separate offset index (operator 9).

A file holds one record per document: length (uint64), masked CRC-32C of the length, payload, masked
CRC-32C of the payload, all little-endian, the framing that common record readers expect. The payload
is the ids of the document, its end id last, as unsigned integers of ``width`` bytes (2 where the
vocabulary allows, else 4). The index is a Parquet table (part, file, offset, n_bytes, width, n_tokens,
doc_id, seq): it is written by Spark's own commit after the files, so files of lost or repeated task
attempts are never named in it, and a reader may fetch records in any order by offset.

Texts are split before single spaces between non-spaces, places where the byte-level pre-tokenizer
always splits; each distinct piece is encoded once by the tokenizers library and kept in a bounded
memory of the worker. Texts with runs of spaces are encoded whole.

Nulls: a null text is empty and gives the end id alone. Order is by doc_id, nulls first, then by a
hash of the text; repeated rows give repeated records.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perfengine.llm.common import bounded_batches, saved, scratch, table, tidy

END_ID = 0
#: Pieces a worker remembers; it then keeps those that came again since the last time, or none if these are over half.
MEMORY = 1_000_000
#: As many in the pipeline, whose workers also keep what its other stages need.
STAGE_MEMORY = 500_000
#: Marks a piece that no space precedes; no UTF-8 text holds it.
FIRST = "\ud800"
#: Bytes of one file after which a task begins the next.
FILE_BYTES = 64 << 20
#: Texts encoded at once, and new pieces encoded in one run.
GROUP, RUN = 256, 512
MASK = 0xA282EAD8

_CASTAGNOLI = 0x82F63B78


def _crc_tables() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_CASTAGNOLI), t >> 1).astype(np.uint32)
    return t


_T = _crc_tables()
_LANE = 128


def _skip_tables() -> np.ndarray:
    """Tables that carry a CRC over ``_LANE`` zero bytes, one for each byte of the CRC."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        c = (np.arange(256, dtype=np.uint64) << np.uint64(8 * k)).astype(np.uint32)
        for _ in range(_LANE):
            c = _T[c & 0xFF] ^ (c >> 8)
        out[k] = c
    return out


_SKIP = _skip_tables()


def masked_crc32c(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of each slice ``raw[at[i]:at[i + 1]]`` (none shorter than 4 bytes).

    Leading zero bytes do not change a CRC that starts at zero, so every slice is padded in front to
    whole lanes; all lanes are summed at once and then joined from the left.
    """
    n = np.diff(at)
    lanes = -(-n // _LANE)
    ends = np.cumsum(lanes)
    grid = np.zeros(int(ends[-1]) * _LANE, np.uint8)
    first = ends * _LANE - n
    grid[np.arange(int(n.sum())) + np.repeat(first - (at[:-1] - at[0]), n)] = raw[at[0] : at[-1]]
    for k in range(4):
        grid[first + k] ^= 0xFF
    grid = np.ascontiguousarray(grid.reshape(-1, _LANE).T)
    crc = np.zeros(grid.shape[1], np.uint32)
    for column in grid:
        crc = _T[(crc ^ column) & 0xFF] ^ (crc >> 8)
    order = np.argsort(-lanes, kind="stable")
    base, count, total = (ends - lanes)[order], lanes[order], np.zeros(len(n), np.uint32)
    for step in range(int(count[0])):
        live = int(np.searchsorted(-count, -step, "left"))
        c = total[:live]
        c = _SKIP[0][c & 0xFF] ^ _SKIP[1][(c >> 8) & 0xFF] ^ _SKIP[2][(c >> 16) & 0xFF] ^ _SKIP[3][c >> 24]
        total[:live] = c ^ crc[base[:live] + step]
    out = np.empty_like(total)
    out[order] = total ^ np.uint32(0xFFFFFFFF)
    return ((out >> 15) | (out << 17)) + np.uint32(MASK)


class _Pieces(dict):
    """Piece -> number; a new piece gets the next number and waits to be encoded.

    A piece stands for a space and itself; with ``FIRST`` before it, for itself alone.
    """

    def __init__(self, tokenizer, size_of: np.ndarray):
        super().__init__()
        self.tokenizer, self.size_of, self.waiting = tokenizer, size_of, []
        self.ids, self.at = np.zeros(1 << 20, np.uint32), np.zeros(1, np.int64)
        self.used = np.zeros(0, np.int64)

    def count(self, codes: np.ndarray) -> None:
        """Note that the numbered pieces were used."""
        if len(self.used) < len(self):
            self.used = np.concatenate([self.used, np.zeros(len(self) + (1 << 16), np.int64)])
        np.add.at(self.used, codes, 1)

    def renewed(self) -> _Pieces:
        """A smaller memory, of the pieces that were used more than once."""
        new, again = _Pieces(self.tokenizer, self.size_of), np.flatnonzero(self.used[: len(self)] > 1)
        if 2 * len(again) > len(self):
            return new
        wanted = self.used > 1
        new.update((p, n) for n, p in enumerate(p for p, k in self.items() if wanted[k]))
        begin, n = self.at[again], self.at[again + 1] - self.at[again]
        new.at = np.concatenate([new.at, np.cumsum(n)])
        new.ids = self.ids[np.arange(int(n.sum())) + np.repeat(begin - np.cumsum(n) + n, n)]
        return new

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.waiting.append(piece)
        return n

    def settle(self) -> None:
        if not self.waiting:
            return
        waiting, self.waiting = self.waiting, []
        plain = [i for i, p in enumerate(waiting) if p and p[0] != FIRST and len(p.strip()) == len(p)]
        blocks, lengths = [], []
        # pieces that begin with their space and hold none at the ends are encoded in one run, and cut
        # apart again by the lengths of the tokens' bytes
        for k in range(0, len(plain), RUN):
            run = [waiting[i] for i in plain[k : k + RUN]]
            text = " " + " ".join(run)
            # the fast call leaves out the offsets
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            sizes = map(len, run) if text.isascii() else (len(p.encode()) for p in run)
            ends = np.cumsum(np.fromiter(sizes, np.int64, len(run)) + 1)
            cuts = np.searchsorted(np.cumsum(self.size_of[ids]), ends, "left") + 1
            blocks.append(ids[: cuts[-1]])
            lengths.append(np.diff(cuts, prepend=0))
        alone = np.ones(len(waiting), bool)
        alone[plain] = False
        rest = np.flatnonzero(alone)
        texts = [p[1:] if p[:1] == FIRST else " " + p for p in (waiting[i] for i in rest)]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        # from the order of encoding to that of the numbers
        flat, order = np.concatenate([*blocks, *found]), np.r_[np.array(plain, np.int64), rest]
        done = np.concatenate([*lengths, np.array([len(f) for f in found], np.int64)])
        n, begin = np.zeros(len(waiting), np.int64), np.zeros(len(waiting), np.int64)
        n[order], begin[order] = done, np.cumsum(done) - done
        at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)])
        while len(self.ids) < at[-1]:
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + (1 << 16), np.uint32)])
        self.ids[self.at[-1] : at[-1]] = flat[np.arange(int(n.sum())) + np.repeat(begin - np.cumsum(n) + n, n)]
        self.at = at


class Encoder:
    """Ids of whole texts as numpy arrays."""

    def __init__(self, path: str, memory: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.memory = memory or MEMORY
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        # a character of a byte-level token is a byte
        self.size_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.pieces = _Pieces(self.tokenizer, self.size_of)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.pieces) > self.memory:
            self.pieces = self.pieces.renewed()
        codes = []
        for text in texts:
            if not text:
                codes.append(np.zeros(0, np.int64))
            elif "  " in text:
                codes.append(None)
            else:
                parts = text.split(" ")
                parts[0] = FIRST + parts[0]
                codes.append(np.fromiter(map(self.pieces.__getitem__, parts), np.int64, len(parts)))
        self.pieces.settle()
        for code in codes:
            if code is not None:
                self.pieces.count(code)
        out = []
        for text, code in zip(texts, codes):
            if code is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
            else:
                begin, n = self.pieces.at[code], self.pieces.at[code + 1] - self.pieces.at[code]
                out.append(self.pieces.ids[np.arange(int(n.sum())) + np.repeat(begin - np.cumsum(n) + n, n)])
        return out


_ENCODERS: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, memory: int | None = None) -> Encoder:
    if (path, memory) not in _ENCODERS:
        _ENCODERS[path, memory] = Encoder(path, memory)
    return _ENCODERS[path, memory]


INDEX = "part int, file string, offset long, n_bytes long, width int, n_tokens long, doc_id long, seq long"


def _frames(payloads: list[bytes]) -> list[bytes]:
    sizes = np.array([len(p) for p in payloads], np.uint64)
    heads = sizes.astype("<u8").view(np.uint8)
    crc_heads = masked_crc32c(heads, np.arange(len(sizes) + 1) * 8).astype("<u4")
    body = np.frombuffer(b"".join(p.rjust(4, b"\0") for p in payloads), np.uint8)
    at = np.concatenate([[0], np.cumsum(np.maximum(sizes, 4))]).astype(np.int64)
    crcs = masked_crc32c(body, at).astype("<u4")
    return [h.tobytes() + c.tobytes() + p + b.tobytes() for h, c, p, b in zip(heads.reshape(-1, 8), crc_heads, payloads, crcs)]


def _writer(folder: str, tokenizer: str, end_id: int, memory: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, attempt = encoder(tokenizer, memory), TaskContext.get().partitionId(), uuid.uuid4().hex
        store, root = fs.FileSystem.from_uri(folder)
        out, name, offset, seq, files = None, "", 0, 0, 0
        try:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for i in range(0, len(texts), GROUP):
                    ids = [np.append(x, np.uint32(end_id)) for x in encode(texts[i : i + GROUP])]
                    # payloads have 4 bytes at least, so that one checksum routine serves all
                    width = [encode.width if len(x) * encode.width >= 4 else 4 for x in ids]
                    frames = _frames([x.astype(f"<u{w}").tobytes() for x, w in zip(ids, width)])
                    rows = []
                    for x, w, frame in zip(ids, width, frames):
                        if out is None or offset >= FILE_BYTES:
                            if out is not None:
                                out.close()
                            name, offset = f"part-{part:05d}-{files:04d}-{attempt}.rec", 0
                            files += 1
                            out = store.open_output_stream(f"{root}/{name}")
                        out.write(frame)
                        rows.append((part, name, offset, len(frame), w, len(x), seq))
                        offset, seq = offset + len(frame), seq + 1
                    cols = list(zip(*rows))
                    cols.insert(6, batch.column("doc_id").slice(i, len(rows)))
                    types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                    names = ["part", "file", "offset", "n_bytes", "width", "n_tokens", "doc_id", "seq"]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types)], names)
        finally:
            if out is not None:
                out.close()
    return run


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, memory: int | None = None) -> DataFrame:
    """Write the records of ``docs`` in ascending doc_id order under ``folder``; return the index."""
    spark = docs.sparkSession
    bounded_batches(spark)
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = ["doc_id", "_tie"]
    rows = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    index = rows.select("doc_id", "text").mapInArrow(tidy(_writer(folder, tokenizer, end_id, memory)), INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        source, name = None, None
        for batch in batches:
            rows, out = batch.to_pydict(), []
            for file, offset, n, width in zip(rows["file"], rows["offset"], rows["n_bytes"], rows["width"]):
                if file != name:
                    source, name = store.open_input_file(f"{root}/{file}"), file
                out.append(source.read_at(n, offset))
            sizes = [len(x) - 16 for x in out]
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            body = np.frombuffer(b"".join(x[12:-4] for x in out), np.uint8)
            heads = np.frombuffer(b"".join(x[:8] for x in out), np.uint8)
            if out:
                good = (masked_crc32c(heads, np.arange(len(out) + 1) * 8) == np.frombuffer(b"".join(x[8:12] for x in out), "<u4")).all()
                good &= (masked_crc32c(body, at) == np.frombuffer(b"".join(x[-4:] for x in out), "<u4")).all()
                if not good or (heads.view("<u8") != np.array(sizes, np.uint64)).any():
                    raise ValueError(f"a record of {folder} does not match its checksum")
            ids = [np.frombuffer(x[12:-4], f"<u{w}").astype("<u4") for x, w in zip(out, rows["width"])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("seq"), batch.column("doc_id"), pa.array(ids, pa.list_(pa.uint32())).cast(pa.list_(pa.int64()))],
                ["part", "seq", "doc_id", "ids"])
    return run


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(part, seq, doc_id, ids) of the index's records, read from the files and checked; any order will do."""
    return index.select("part", "file", "offset", "n_bytes", "width", "doc_id", "seq").mapInArrow(
        tidy(_reader(folder)), "part int, seq long, doc_id long, ids array<bigint>")


def _digest(folder: str):
    read = _reader(folder)

    def run(batches):
        for batch in read(batches):
            ids = batch.column("ids")
            flat, at = ids.flatten().to_numpy().astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a - at[0] : b - at[0]].tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("seq"), batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                ["part", "seq", "doc_id", "n_tokens", "ids_crc32"])
    return run


def tokenize(spark: SparkSession, docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, memory: int | None = None) -> DataFrame:
    """Write, read back and digest: doc_id, start, n_tokens, ids_crc32 of each document in order."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = folder or scratch(spark, "records")
    index = write_records(docs, folder, tokenizer, memory=memory)
    back = index.select("part", "file", "offset", "n_bytes", "width", "doc_id", "seq").mapInArrow(
        tidy(_digest(folder)), "part int, seq long, doc_id long, n_tokens long, ids_crc32 long")
    back = saved(back, "digests")
    # one row per part: the only rows that meet in one place
    sums = back.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return (back.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "part")
            .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(spark, table(spark, sf_dir, "documents"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the records of all documents and their digest."""
    return tokenize(spark, docs, memory=STAGE_MEMORY)
