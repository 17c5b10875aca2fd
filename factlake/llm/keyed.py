"""Finding keys that occur more than once, over many more keys than a row each would allow.

Arrow workers hold keys (64-bit hashes) as arrays and send blocks of them, one binary value a bucket of the key space,
through an ordinary shuffle. Keys that a worker sees often are not gathered: it answers for its own occurrences and
sends one marker, so a key that a third of all rows hold costs a marker a worker and lands on no single task.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key, the row (document) that has it, and a number that goes with them.
ENTRY = np.dtype([("key", "<u8"), ("row", "<i8"), ("at", "<u4")])
#: An answer: the row and its number.
PLACE = np.dtype([("row", "<i8"), ("at", "<u4")])
#: Marks an entry that stands for many; no row has this number.
MARKER = -1
BLOCKS, GROUPED = "bucket long, kind int, block binary", pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("block", pa.binary())])
#: Entries that a worker gathers before it sends them on.
GATHER = 1_000_000


#: Bytes of text a bucket at most, on average: what a task gathers does not depend on how the session is set.
BUCKET_BYTES = 32 << 20


def buckets(docs: DataFrame, text_col: str, each: int) -> int:
    """Buckets to deal keys and rows into: odd, about ``each`` for every shuffle partition, and as many as the texts' bytes ask for."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    return max(each * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES) // 2 * 2 + 1


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no DataFrame refers to any more; without this they stay until the driver happens to collect garbage."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def numbered(docs: DataFrame, id_col: str, text_col: str, n: int, more: Iterable[str] = ()) -> DataFrame:
    """``row`` (a number of its own for each row), ``doc_id``, ``text``, the row's ``bucket`` and, as a struct, further columns.

    The number follows the order in which the rows are read: give tables, or what :func:`factlake.llm.util.stage` has written.
    """
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in more]).alias("more")] if more else []))
    return own.withColumn("bucket", F.pmod("row", F.lit(n)))


def _rows(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, x = zip(*parts, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], schema=GROUPED)


def batches_of(parts: list[tuple[int, int, bytes]], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    lo = size = 0
    for hi, p in enumerate(parts, 1):
        size += len(p[2])
        if size >= most or hi == len(parts):
            yield _rows(parts[lo:hi])
            lo, size = hi, 0


def pack(x: np.ndarray) -> bytes:
    """Records by field, rows and numbers as differences: in their order these shrink to little when the shuffle compresses them."""
    return b"".join((np.diff(x[f], prepend=x[f].dtype.type(0)) if f in ("row", "at") else np.ascontiguousarray(x[f])).tobytes() for f in x.dtype.names)


def unpack(blocks: list[bytes], dtype: np.dtype) -> np.ndarray:
    """All records of blocks."""
    sizes = [len(b) // dtype.itemsize for b in blocks]
    out, lo = np.empty(sum(sizes), dtype), 0
    for b, n in zip(blocks, sizes, strict=True):
        at = 0
        for f in dtype.names:
            own = np.frombuffer(b, dtype[f], n, at)
            out[f][lo : lo + n] = np.cumsum(own, dtype=dtype[f]) if f in ("row", "at") else own
            at += n * dtype[f].itemsize
        lo += n
    return out


def cut_by(where: np.ndarray, data: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    """Blocks of ``data`` by bucket, in order within a bucket."""
    if not len(where):
        return []
    order = np.argsort(where, kind="stable")
    where, data = where[order], data[order]
    first = np.flatnonzero(np.diff(where, prepend=-1))
    return [(int(where[a]), kind, pack(data[a:b])) for a, b in zip(first, np.append(first[1:], len(where)), strict=True)]


def key_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the keys, first place of each distinct key in it, and how many there are of it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    return order, first, np.diff(np.append(first, len(k)))


def send(entries: np.ndarray, n: int, local: int, kind: np.dtype = PLACE) -> Iterator[pa.RecordBatch]:
    """Blocks for the reducers (kind 0) and, for keys that these entries hold ``local`` times or more, answers (kind 1); a marker's number is how often."""
    if not len(entries):
        return
    order, first, count = runs(entries["key"])
    often = np.empty(len(entries), bool)
    often[order] = np.repeat(count >= local, count)
    markers = np.zeros(int((count >= local).sum()), ENTRY)
    markers["key"], markers["row"], markers["at"] = entries["key"][order[first[count >= local]]], MARKER, count[count >= local]
    single = np.concatenate([entries[~often], markers])
    parts = cut_by(key_bucket(single["key"], n), single, 0)
    if often.any():
        known = np.empty(int(often.sum()), kind)
        for f in kind.names:
            known[f] = entries[f][often]
        parts += cut_by(known["row"] % n, known, 1)
    yield from batches_of(parts)


def answer(entries: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Answers for the entries whose key occurs again or has a marker."""
    order, first, count = runs(entries["key"])
    marked = np.logical_or.reduceat(entries["row"][order] == MARKER, first) if len(first) else np.empty(0, bool)
    found = np.empty(len(entries), bool)
    found[order] = np.repeat((count > 1) | marked, count)
    found &= entries["row"] != MARKER
    out = np.empty(int(found.sum()), kind)
    for f in kind.names:
        out[f] = entries[f][found]
    return out


#: Kind of the blocks that hold keys which occur more often than a group may be large.
LARGE = 3


def repeated(sent: DataFrame, n: int, kind: np.dtype = PLACE, most: int | None = None) -> DataFrame:
    """From blocks made by :func:`send`, blocks of answers dealt by row: ``bucket, kind, block``; blocks of other kinds than 0 pass through.

    With ``most``, keys that occur more often in all are given too, as blocks of kind ``LARGE``.
    """

    def run(key: tuple, groups: pa.Table) -> pa.Table:
        kinds, blocks = groups.column("kind").to_numpy(), groups.column("block").to_pylist()
        parts = [(key[0].as_py(), int(k), x) for k, x in zip(kinds, blocks, strict=True) if k]
        own = unpack([x for k, x in zip(kinds, blocks, strict=True) if k == 0], ENTRY)
        del blocks
        if len(own):
            found = answer(own, kind)
            parts += cut_by(found["row"] % n, found, 1)
            if most is not None:
                order, first, _ = runs(own["key"])
                often = np.add.reduceat(np.where(own["row"] == MARKER, own["at"].astype(np.int64), 1)[order], first) > most
                if often.any():
                    parts.append((key[0].as_py(), LARGE, np.ascontiguousarray(own["key"][order[first[often]]]).tobytes()))
        return pa.Table.from_batches(list(batches_of(parts)), GROUPED)

    return sent.groupBy("bucket").applyInArrow(run, BLOCKS)


def gathered(column: pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    """All records of a column of blocks."""
    return unpack(column.to_pylist(), dtype)
