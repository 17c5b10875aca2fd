"""Token ids in files of patched frame-of-reference blocks.

File: ``PFR1``, then blocks, then an index, then a trailer. A block of up to ``BLOCK`` ids is a header (minimum, width,
count, number of exceptions), the differences to the minimum packed at the width that the ``PERCENTILE``-th of them
needs, and the exceptions that need more bits: positions, then whole differences. The index has each block's start
and each document's id and number of ids; the trailer has the counts and the index's place. Reading starts at the
trailer and decodes blocks as they are needed, so neither side holds a whole shard's ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokenizing import encoder, public
from .util import shared_dir, slices, stage, table

MAGIC, BLOCK, PERCENTILE, END_ID = b"PFR1", 1024, 90, 1
_HEAD, _TRAIL = struct.Struct("<IBHH"), struct.Struct("<QQQQ4s")
#: Blocks encoded or decoded together.
MANY = 128


def _width(x: np.ndarray) -> np.ndarray:
    """Bits that each unsigned 32-bit number needs."""
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of ids (unsigned 32-bit, any number of them)."""
    out: list[bytes] = []
    for lo in range(0, len(ids), MANY * BLOCK):
        part = ids[lo : lo + MANY * BLOCK]
        n = -(-len(part) // BLOCK)
        last = len(part) - (n - 1) * BLOCK
        full = np.concatenate([part, np.full(n * BLOCK - len(part), part[-1], np.uint32)]).reshape(n, BLOCK)
        least = full.min(axis=1)
        diff = full - least[:, None]
        at = BLOCK * PERCENTILE // 100
        width = _width(np.partition(diff, at, axis=1)[:, at])
        over = (diff >> 1 >> np.maximum(width - 1, 0).astype(np.uint32)[:, None] > 0) & (width[:, None] < 32)
        over[width == 0] = diff[width == 0] > 0
        packed: list[bytes] = [b""] * n
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            if w:
                bits = np.unpackbits(diff[own].astype(">u4").view(np.uint8).reshape(len(own), BLOCK, 4), axis=2)[:, :, 32 - w :]
                rows = np.packbits(bits.reshape(len(own), -1), axis=1)
                for i, row in zip(own, rows, strict=True):
                    packed[i] = row.tobytes()
        for i in range(n):
            count = last if i == n - 1 else BLOCK
            where = np.flatnonzero(over[i, :count]).astype("<u2")
            out.append(_HEAD.pack(int(least[i]), int(width[i]), count, len(where)) + packed[i][: -(-count * int(width[i]) // 8)] + where.tobytes() + diff[i, where].astype("<u4").tobytes())
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of blocks, one after the other."""
    parts: list[np.ndarray | None] = [None] * len(blocks)
    heads = [_HEAD.unpack_from(b) for b in blocks]
    for w, count in {(h[1], h[2]) for h in heads}:
        own = [i for i, h in enumerate(heads) if h[1:3] == (w, count)]
        size = -(-count * w // 8)
        if w:
            raw = np.frombuffer(b"".join(blocks[i][_HEAD.size : _HEAD.size + size] for i in own), np.uint8).reshape(len(own), size)
            bits = np.zeros((len(own), count, 32), np.uint8)
            bits[:, :, 32 - w :] = np.unpackbits(raw, axis=1)[:, : count * w].reshape(len(own), count, w)
            diff = np.packbits(bits, axis=2).view(">u4").reshape(len(own), count).astype(np.uint32)
        else:
            diff = np.zeros((len(own), count), np.uint32)
        for j, i in enumerate(own):
            least, _, _, k = heads[i]
            if k:
                at = _HEAD.size + size
                diff[j, np.frombuffer(blocks[i], "<u2", k, at)] = np.frombuffer(blocks[i], "<u4", k, at + 2 * k)
            parts[i] = diff[j] + np.uint32(least)
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


class Writer:
    """Writes one shard; the file appears under its name only when it is whole."""

    def __init__(self, path: str):
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.tmp)
        self.out.write(MAGIC)
        self.at, self.starts, self.docs, self.rest = len(MAGIC), [], [], []
        self.kept = self.total = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((-1 << 63 if doc_id is None else doc_id, len(ids) // 4))
        self.rest.append(ids)
        self.kept += len(ids) // 4
        self.total += len(ids) // 4
        if self.kept >= MANY * BLOCK:
            self._flush(self.kept // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.rest), "<u4")
        for block in encode_blocks(ids[:n]):
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.rest, self.kept = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> None:
        if self.kept:
            self._flush(self.kept)
        docs = np.array(self.docs, np.int64).reshape(-1, 2)
        self.out.write(np.array(self.starts, "<u8").tobytes() + docs.T.astype("<i8").tobytes())
        self.out.write(_TRAIL.pack(len(self.starts), len(docs), self.total, self.at, MAGIC))
        self.out.close()
        self.fs.move(self.tmp, self.path)


class Reader:
    """Reads a shard by its index."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        self.file.seek(self.file.size() - _TRAIL.size)
        blocks, docs, self.total, self.end, magic = _TRAIL.unpack(self.file.read(_TRAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a whole token file")
        self.file.seek(self.end)
        self.starts = np.append(np.frombuffer(self.file.read(8 * blocks), "<u8"), np.uint64(self.end)).astype(np.int64)
        self.doc_ids, self.sizes = np.frombuffer(self.file.read(16 * docs), "<i8").reshape(2, docs)

    def blocks(self, lo: int, hi: int) -> np.ndarray:
        """The ids of blocks lo..hi-1."""
        base = self.starts[lo]
        self.file.seek(int(base))
        raw = self.file.read(int(self.starts[hi] - base))
        return decode_blocks([raw[a - base : b - base] for a, b in zip(self.starts[lo:hi], self.starts[lo + 1 : hi + 1], strict=True)])

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from the one numbered ``start``; reads the blocks that hold them."""
        if n <= 0:
            return np.empty(0, np.uint32)
        lo = start // BLOCK
        return self.blocks(lo, -(-(start + n) // BLOCK))[start - lo * BLOCK :][:n]

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """Each document's id and ids (little-endian), in the file's order, a run of blocks at a time."""
        have, base, block, start = np.empty(0, np.uint32), 0, 0, 0
        for d, n in zip(self.doc_ids.tolist(), self.sizes.tolist(), strict=True):
            parts = []
            want, at = n, start
            while want:
                if at >= base + len(have):
                    base, hi = block * BLOCK, min(block + MANY, len(self.starts) - 1)
                    have, block = self.blocks(block, hi), hi
                own = have[at - base : at - base + want]
                parts.append(own.astype("<u4").tobytes())
                at, want = at + len(own), want - len(own)
            start += n
            yield None if d == -1 << 63 else d, b"".join(parts)


def write_tokens(docs: DataFrame, path: str | None = None, folder: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode documents and write token files in ascending order of ``id_col``; returns the staged manifest ``shard, file, n_docs, n_ids``.

    Shards are ranges of ids (repeated ids: by a hash of the text, then as they come; null ids first). Null and empty
    texts are the end id alone. An empty table gives no files and an empty manifest; other columns are ignored. A
    task that runs again writes files of its own, and the manifest names those of the attempt that counted.
    """
    spark = docs.sparkSession
    folder, tokens = folder or shared_dir(spark), path or public("word_bpe_49k.json")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("tie", F.xxhash64("text"))
    ranged = own.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail, out = encoder(tokens), np.array([end_id], "<u4").tobytes(), None
        shard = TaskContext.get().partitionId()
        name = f"{folder}/shard-{shard:07d}-{uuid.uuid4().hex[:8]}.pfr"
        for b in slices(batches):
            out = out or Writer(name)
            for d, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                out.add(d, ids + tail)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "n_docs": [len(out.docs)], "n_ids": [out.total]})

    return stage(ranged.mapInArrow(run, "shard long, file string, n_docs long, n_ids long"))


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of token files, as read back: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` (little-endian unsigned 32-bit)."""
    order = Window.orderBy("shard")
    # one row a file: a sum over all of them in order is small
    placed = manifest.select("file", (F.sum("n_ids").over(order) - F.col("n_ids")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
            return pa.RecordBatch.from_arrays(cols[: 4 + with_ids], names[: 4 + with_ids])

        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                rows, held = [], 0
                for d, ids in Reader(file).documents():
                    rows.append((d, start, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                    start, held = start + len(ids) // 4, held + len(ids) * with_ids
                    if len(rows) >= 5000 or held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return _spread(placed, manifest.sparkSession).mapInArrow(run, schema)


def _spread(files: DataFrame, spark: SparkSession) -> DataFrame:
    """Deal the rows of a manifest over tasks."""
    return files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")


def op8_pfor_token_files(spark, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents")))
