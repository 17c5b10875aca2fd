"""Helpers shared by the operators: shared storage, Arrow slicing and vectorised word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at a time inside a Python worker.
SLICE_BYTES = 4 << 20
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers find this package where the driver did, if it isn't installed
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; where that is unset and Spark runs in this process alone, a temporary one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="factlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/factlake-{uuid.uuid4().hex}"


def stage(df: DataFrame, keep: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = keep or shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def steady(docs: DataFrame) -> DataFrame:
    """``docs`` in an order that is the same each time it is read: as it is, if it comes from files or memory row by row, else staged."""
    nodes = [docs._jdf.queryExecution().analyzed()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() not in ("Project", "Filter", "SubqueryAlias", "View", "LocalRelation", "LogicalRDD", "Range") and "Relation" not in node.nodeName():
            return stage(docs)
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return docs


def drop(staged: DataFrame) -> None:
    """Delete the files of a staged DataFrame that nothing reads any more, with Hadoop's own file systems."""
    spark = staged.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches with about ``most`` bytes of ``column``; a longer value comes alone and whole."""
    for b in batches:
        lens = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        ends, lo = np.cumsum(lens), 0
        while lo < b.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + most, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a fixed number of entries."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < self.MOST:
            self[word] = h
        return h


_WORDS = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multiplier of the rolling hash of word sequences, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 15)
        have = np.full(size, np.uint64(base & MASK64))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 21:
            _POWERS[base] = have
    return have[:n]


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes; empty with fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    s = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(BASE, len(h)), out=s[1:])
    return mix((s[k:] - s[:-k]) * powers(BASE_INV, n))
