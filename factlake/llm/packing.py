"""Best-fit-decreasing packing of documents into sequences of a fixed number of tokens.

Pieces of equal length are interchangeable, so best-fit decreasing over all pieces is a function of the histogram
of lengths: at most ``capacity`` rows on the driver, whatever the corpus. A segment tree over remaining capacities
finds the tightest open bin in logarithmic time and takes all bins of that remaining capacity together. The plan,
ranges of (length, rank) to ranges of sequences, is applied in parallel; a piece's rank among those of its length
is its rank inside its task plus what earlier tasks hold, so no length is ever gathered in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokenizing import encoder, public
from .util import slices, stage, table

CAPACITY, END_ID = 1024, 2


class RoomTree:
    """Segment tree over remaining capacities 0..capacity; a leaf holds ranges of bins with that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.full = [False] * (2 * self.size)
        self.ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _set(self, room: int) -> None:
        i = room + self.size
        self.full[i] = bool(self.ranges[room])
        while i > 1:
            i //= 2
            now = self.full[2 * i] or self.full[2 * i + 1]
            if self.full[i] == now:
                break
            self.full[i] = now

    def add(self, room: int, start: int, count: int) -> None:
        if room and count:
            self.ranges[room].append((start, count))
            self._set(room)

    def take(self, room: int) -> tuple[int, int]:
        got = self.ranges[room].pop()
        self._set(room)
        return got

    def tightest(self, need: int) -> int | None:
        """The least room of ``need`` or more that an open bin has."""
        i = need + self.size
        if self.full[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.full[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.full[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing for ``{length: count}``: rows (length, first rank, pieces a sequence, first sequence, offset), and the number of sequences.

    Rows of a length are in order of rank; a row holds up to the next one's first rank.
    """
    tree, plan, bins = RoomTree(capacity), [], 0
    for length in sorted((n for n, c in histogram.items() if c > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1..{capacity}")
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                start, count = bins, -(-left // each)
                bins += count
            else:
                each = room // length
                start, count = tree.take(room)
            full = min(count, left // each)
            if full:
                plan.append((length, rank, each, start, capacity - room))
                tree.add(room - each * length, start, full)
                rank, left = rank + full * each, left - full * each
            rest = count - full
            if rest and 0 < left < each:
                plan.append((length, rank, each, start + full, capacity - room))
                tree.add(room - left * length, start + full, 1)
                full, rest, left = full + 1, rest - 1, 0
            tree.add(room, start + full, rest)
    return plan, bins


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenised pieces of documents: ``doc_id, piece, start, length, ids_crc32, part, idx`` and, if asked for, ``ids`` (little-endian unsigned 32-bit).

    Null text counts as empty. A longer document is cut into pieces of ``capacity`` ids, of which the first may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(path), np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in slices(batches):
            doc, piece, start, length, crc, idx, raw = [], [], [], [], [], [], []
            for d, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                ids += tail
                n = len(ids) // 4
                a, e, k = 0, n % capacity or capacity, 0
                while a < n:
                    own = ids[4 * a : 4 * e]
                    doc.append(d), piece.append(k), start.append(a), length.append(e - a), crc.append(zlib.crc32(own)), idx.append(int(seen[e - a]))
                    seen[e - a] += 1
                    if with_ids:
                        raw.append(own)
                    a, e, k = e, e + capacity, k + 1
            cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(doc), pa.int64()), pa.array(idx, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "idx"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, idx long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id, offset`` to staged pieces (``length``, ``part`` and ``idx`` as :func:`cut` gives them).

    Sequences are filled without gaps from offset 0. The histogram and the plan depend on ``capacity`` only.
    """
    counts = stage(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = best_fit_plan(histogram, capacity)
    at = np.array(plan, np.int64).reshape(-1, 5)
    by_length = {int(n): at[at[:, 0] == n] for n in np.unique(at[:, 0])}
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["part", "length"])
    names = [c for c in pieces.columns if c not in ("part", "idx")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("before").to_numpy() + b.column("idx").to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                m, rows = length == n, by_length[int(n)]
                own = rows[np.searchsorted(rows[:, 1], rank[m], "right") - 1]
                k = rank[m] - own[:, 1]
                seq[m], off[m] = own[:, 3] + k // own[:, 2], own[:, 4] + k % own[:, 2] * n
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    return ranked.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` ids; one row a piece: ``doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset``.

    Null and empty texts are the end id alone; null ids stay null; repeated rows are packed once each; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    return place(stage(cut(docs, path or public("byte_bpe_50k.json"), capacity, end_id, id_col, text_col, with_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ``ids``: ``sequence_id, n_ids, ids, doc_ids``; a sequence holds ``capacity`` ids at most."""
    row = F.struct("offset", "doc_id", "ids")
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.sort_array(F.collect_list(row)).alias("rows"))
    joined = F.aggregate("rows", F.lit(b""), lambda a, r: F.concat(a, r["ids"]))
    return grouped.select("sequence_id", "n_ids", joined.alias("ids"), F.col("rows.doc_id").alias("doc_ids"))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
