"""Removal of word sequences that occur more than once, by prefix-partitioned suffix trees.

A suffix begins at a word and matters up to its first ``window`` words; a node of the suffix tree that is so deep and has
two leaves or more is a repeat. Prefixes split the suffixes into groups that fit in memory, a subtree each:

1. A sparse set of prefixes of ``SHORT`` words stands for all windows (winnowing: each window belongs to the least prefix
   in it, by fingerprint, so equal windows belong to equal prefixes at equal places). A prefix that occurs once ends its branch.
2. A prefix that occurs up to ``GROUP`` times is a group: the words around its occurrences are gathered, and the subtree of
   their suffixes is built from the words themselves, as sorted suffixes (prefix doubling). The leaves of a node as deep as the
   window are a run of equal rank; nodes with two leaves or more are repeats.
3. A prefix that occurs more often is made longer, up to the window: suffixes are gathered by fingerprints (96 bits) of so long
   prefixes. One that many share is not gathered at all: workers answer for occurrences that they see together and send one marker.

Maximal repeats are the unions of overlapping repeated windows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyed import BLOCKS, ENTRY, GATHER, GROUPED, LARGE, MARKER, PLACE, batches_of, buckets, cut_by, gathered, key_bucket, numbered, pack, release, repeated, send, unpack
from .util import drop, mix, slices, stage, steady, table, windows, word_hashes

WINDOW, SHORT = 35, 20
#: Occurrences of a prefix in a group at most (some 50 words each); a more frequent prefix is made longer.
GROUP = 4_096
#: Frequent prefixes that are broadcast at most, at 8 bytes each; if there are more, all prefixes are made longer.
MOST_LARGE = 1_000_000


def _slide(x: np.ndarray, k: int, f: np.ufunc) -> np.ndarray:
    """``f`` over every run of ``k`` values."""
    step = 1
    while step * 2 <= k:
        x, step = f(x[:-step], x[step:]), step * 2
    return f(x[: len(x) - (k - step)], x[k - step :]) if step < k else x


def word_list(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def chosen(short: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the prefixes chosen by some window, and the least prefix of every window."""
    k = window - size + 1
    least = _slide(short, k, np.minimum)
    padded = np.concatenate([np.zeros(k - 1, np.uint64), least, np.zeros(k - 1, np.uint64)])
    return np.flatnonzero(_slide(padded, k, np.maximum) == short), least


def _prefixes(docs: DataFrame, n: int, window: int, size: int) -> DataFrame:
    """Blocks of the chosen short prefixes of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in slices(batches):
            for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = word_list(text)
                if len(words) < window:
                    continue
                short = windows(word_hashes(words), size)
                at, _ = chosen(short, window, size)
                e = np.empty(len(at), ENTRY)
                e["key"], e["row"], e["at"] = mix(short[at]), row, at  # the least of several hashes would not spread evenly
                held.append(e)
            if sum(map(len, held)) >= GATHER:
                yield from send(np.concatenate(held), n, 2)
                held = []
        if held:
            yield from send(np.concatenate(held), n, 2)

    return docs.select("row", "text").mapInArrow(run, BLOCKS)


#: A suffix below a repeated prefix: both halves of the fingerprint of its window, its document and place.
SUFFIX = np.dtype([("key", "<u8"), ("more", "<u4"), ("row", "<i8"), ("at", "<u4")])


def _leaves(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of a subtree whether its node of window depth has another leaf (or a marker), and a suffix of each such node."""
    order = np.lexsort((s["more"], s["key"]))
    key, more = s["key"][order], s["more"][order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (more[1:] != more[:-1]))) if len(s) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(s)))
    deep = (count > 1) | np.logical_or.reduceat(s["row"][order] == MARKER, first) if len(first) else np.empty(0, bool)
    out = np.empty(len(s), bool)
    out[order] = np.repeat(deep, count)
    return out, order[first[deep]]


def _places(s: np.ndarray) -> np.ndarray:
    out = np.empty(len(s), PLACE)
    out["row"], out["at"] = s["row"], s["at"]
    return out


#: Words around an occurrence of a prefix: its key, its document, the place of the first word, how many there are, and as bits at which of them its windows begin.
AROUND = np.dtype([("key", "<u8"), ("row", "<i8"), ("at", "<u4"), ("size", "<u4"), ("starts", "<u8")])
#: Kind of the blocks of words around prefixes.
WORDS_AROUND = 2
#: Bytes of words around prefixes that a worker holds before it packs them.
HELD_BYTES = 8 << 20


def _pack_around(records: np.ndarray, texts: list[bytes]) -> bytes:
    raw = len(records).to_bytes(8, "little") + records.tobytes() + b"\n".join(texts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack_around(block: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), "zstd", asbytes=True)
    end = 8 + int.from_bytes(raw[:8], "little") * AROUND.itemsize
    return np.frombuffer(raw[8:end], AROUND), raw[end:].split(b"\n")


def _cut_around(around: list[np.ndarray], texts: list[bytes], n: int) -> list[tuple[int, int, bytes]]:
    e = np.concatenate(around)
    where = key_bucket(e["key"], n)
    order = np.argsort(where, kind="stable")
    return [(int(where[p[0]]), WORDS_AROUND, _pack_around(e[p], [texts[j] for j in p.tolist()])) for p in np.split(order, np.flatnonzero(np.diff(where[order])) + 1)]


def _owned(at: np.ndarray, short: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """For each chosen place (ascending) and each of ``k`` distances whether the window that begins so far before it belongs to it: to the first of equal least prefixes."""
    key, o = short[at], np.arange(k)
    order = np.lexsort((at, key))
    gap = np.full(len(at), k)
    same = key[order[1:]] == key[order[:-1]]
    gap[order[1:][same]] = (at[order[1:]] - at[order[:-1]])[same]
    begin = at[:, None] - o
    inside = (begin >= 0) & (begin < len(least))
    return inside & (least[np.where(inside, begin, 0)] == key[:, None]) & (o < gap[:, None])


def _suffixes(docs: DataFrame, found: DataFrame, n: int, window: int, size: int, large: np.ndarray | None) -> DataFrame:
    """Blocks of the words around repeated prefixes and, below the ``large`` ones (None: all), of suffixes; buckets of keys: twice ``n``."""
    k = window - size + 1
    o = np.arange(k)

    def run(key: tuple, texts: pa.Table, blocks: pa.Table) -> pa.Table:
        at = gathered(blocks.column("block"), PLACE)
        at = at[np.lexsort((at["at"], at["row"]))]
        parts, held, around, near, size_near = [], [], [], [], 0
        rows = texts.column("row").to_numpy()
        lo, hi = np.searchsorted(at["row"], rows), np.searchsorted(at["row"], rows, "right")
        for i in np.flatnonzero(hi > lo).tolist():
            words = word_list(texts.column("text")[i].as_py())
            h = word_hashes(words)
            short = windows(h, size)
            _, least = chosen(short, window, size)
            own = at["at"][lo[i] : hi[i]].astype(np.int64)
            mine = _owned(own, short, least, k)
            long = np.ones(len(own), bool) if large is None else np.isin(mix(short[own]), large)
            if long.any():
                start = (own[:, None] - o)[mine & long[:, None]]
                s = np.empty(len(start), SUFFIX)
                s["key"], s["more"], s["row"], s["at"] = windows(h, window)[start], windows(mix(h), window)[start] >> np.uint64(32), rows[i], start
                held.append(s)
            mine, own = mine[~long], own[~long]
            has = mine.any(axis=1)
            mine, own = mine[has], own[has]
            if len(own):
                nearest, farthest = mine.argmax(axis=1), k - 1 - mine[:, ::-1].argmax(axis=1)
                e = np.empty(len(own), AROUND)
                e["key"], e["row"], e["at"], e["size"] = mix(short[own]), rows[i], own - farthest, farthest - nearest + window
                bit = np.where(mine, farthest[:, None] - o, 0).astype(np.uint64)
                e["starts"] = np.where(mine, np.uint64(1) << bit, np.uint64(0)).sum(axis=1, dtype=np.uint64)
                around.append(e)
                near += [b" ".join(words[a:b]) for a, b in zip(e["at"].tolist(), (e["at"] + e["size"]).tolist(), strict=True)]
                size_near += sum(map(len, near[-len(own) :]))
                if size_near >= HELD_BYTES:
                    parts += _cut_around(around, near, 2 * n)
                    around, near, size_near = [], [], 0
        if held:
            s = np.concatenate(held)
            deep, nodes = _leaves(s)
            marks = s[nodes]
            marks["row"], marks["at"] = MARKER, 0
            # leaves of nodes known here are answered here, with a marker for each such node
            parts += [(key[0].as_py(), 1, pack(_places(s[deep])))] if deep.any() else []
            rest = np.concatenate([s[~deep], marks])
            parts += cut_by(key_bucket(rest["key"], 2 * n), rest, 0)
        if around:
            parts += _cut_around(around, near, 2 * n)
        return pa.Table.from_batches(list(batches_of(parts)), GROUPED) if parts else GROUPED.empty_table()

    texts = docs.select("bucket", "row", "text")
    return texts.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(run, BLOCKS)


def _rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)


def subtree(around: np.ndarray, texts: list[bytes], window: int) -> np.ndarray:
    """Leaves, as places, of the nodes of ``window`` words with two leaves or more, in the tree of the suffixes that begin windows."""
    # words around copies are the same: they are ranked once
    own, at = np.unique(np.fromiter(map({}.setdefault, texts, itertools.count()), np.int64, len(texts)), return_inverse=True)
    words = b" ".join([texts[j] for j in own.tolist()]).split(b" ")
    rank, depth = np.fromiter(map({}.setdefault, words, itertools.count()), np.int64, len(words)), 1
    del words
    while depth < window:
        step = min(depth, window - depth)
        rank, depth = _rank(rank[:-step], rank[step:]), depth + step
    base = (np.cumsum(around["size"][own], dtype=np.int64) - around["size"][own])[at]
    which, o = np.nonzero(around["starts"][:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1))
    node = rank[base[which] + o]
    deep = np.bincount(node)[node] > 1
    out = np.empty(int(deep.sum()), PLACE)
    out["row"], out["at"] = around["row"][which[deep]], around["at"][which[deep]] + o[deep]
    return out


def subtrees(around: np.ndarray, texts: list[bytes], window: int, most: int) -> Iterator[np.ndarray]:
    """:func:`subtree` of whole groups, as many together as have ``most`` occurrences."""
    order = np.argsort(around["key"], kind="stable")
    ends = np.append(np.flatnonzero(np.diff(around["key"][order])) + 1, len(order))
    lo = 0
    while lo < len(order):
        hi = int(ends[max(np.searchsorted(ends, lo, "right"), np.searchsorted(ends, lo + most, "right") - 1)])
        part = order[lo:hi]
        yield subtree(around[part], [texts[j] for j in part.tolist()], window)
        lo = hi


def _deep(sent: DataFrame, n: int, window: int, most: int) -> DataFrame:
    """Leaves of the deep internal nodes, dealt by document."""

    def run(key: tuple, groups: pa.Table) -> pa.Table:
        kinds, blocks = groups.column("kind").to_numpy(), groups.column("block").to_pylist()
        parts = [(key[0].as_py(), 1, x) for k, x in zip(kinds, blocks, strict=True) if k == 1]
        s = unpack([x for k, x in zip(kinds, blocks, strict=True) if k == 0], SUFFIX)
        if len(s):
            deep, _ = _leaves(s)
            out = _places(s[deep & (s["row"] != MARKER)])
            parts += cut_by(out["row"] % n, out, 1)
        around, texts, seen = [], [], {}
        for x in [x for k, x in zip(kinds, blocks, strict=True) if k == WORDS_AROUND]:
            records, near = _unpack_around(x)
            around.append(records)
            texts += map(seen.setdefault, near, near)
        del blocks, seen, s
        if around:
            out = np.concatenate(list(subtrees(np.concatenate(around), texts, window, most)))
            parts += cut_by(out["row"] % n, out, 1)
        return pa.Table.from_batches(list(batches_of(parts)), GROUPED) if parts else GROUPED.empty_table()

    return sent.groupBy("bucket").applyInArrow(run, BLOCKS)


def _large(found: DataFrame) -> np.ndarray | None:
    """Keys of the prefixes that occur too often for a group; None if there are too many of them to send to the workers."""
    keys = found.where(F.col("kind") == LARGE)
    if (keys.agg(F.sum(F.octet_length("block"))).first()[0] or 0) > 8 * MOST_LARGE:
        return None
    return np.sort(np.frombuffer(b"".join(bytes(r["block"]) for r in keys.select("block").collect()), "<u8"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False, more: tuple[str, ...] = (), group: int = GROUP) -> DataFrame:
    """Remove every word covered by a run of ``window`` words that also starts anywhere else, in the same document or another.

    Returns for each row ``doc_id, n_words, n_removed, kept_sha256`` and, if asked for, ``kept`` (the kept words joined by
    one blank; the text itself where nothing goes) and ``repeats`` (first word and words of each maximal repeat). Null and
    empty texts have no words; shorter texts than ``window`` words keep all of them; repeated rows are documents of their own (so the
    second copy's words repeat, and the first's); an empty table gives none; other columns are ignored, but those named by ``more``
    come along as a struct of that name. ``group`` bounds the occurrences of a prefix that are gathered; it changes no result.
    """
    size = max(min(SHORT, max(1, window // 2 + 1)), window - 63)
    docs = steady(docs)
    n = buckets(docs, text_col, 1)
    own = numbered(docs, id_col, text_col, n, more)
    found = stage(repeated(_prefixes(own, n, window, size), n, most=group))
    release(docs.sparkSession)
    deep = stage(_deep(_suffixes(own, found.where("kind = 1"), n, window, size, _large(found)), n, window, group))
    drop(found)
    release(docs.sparkSession)

    def run(key: tuple, texts: pa.Table, blocks: pa.Table) -> pa.Table:
        at = gathered(blocks.column("block"), PLACE)
        at = at[np.argsort(at["row"], kind="stable")]
        rows = texts.column("row").to_numpy()
        lo, hi = np.searchsorted(at["row"], rows), np.searchsorted(at["row"], rows, "right")
        out: dict[str, list] = {c: [] for c in schema.names}
        for i in range(len(rows)):
            text = texts.column("text")[i].as_py()
            words = word_list(text)
            gone, repeats = np.zeros(len(words) + 1, np.int64), []
            if hi[i] > lo[i]:
                start = np.unique(at["at"][lo[i] : hi[i]]).astype(np.int64)
                np.add.at(gone, start, 1)
                np.add.at(gone, start + window, -1)
                mark = np.cumsum(gone)[:-1] > 0
                words, n_words = [w for w, m in zip(words, mark.tolist(), strict=True) if not m], len(words)
                edge = np.flatnonzero(np.diff(mark.astype(np.int8), prepend=0, append=0))
                repeats = [{"first": int(a), "words": int(b - a)} for a, b in edge.reshape(-1, 2)]
                kept = b" ".join(words)
            else:
                n_words, kept = len(words), b" ".join(words)
            row = {"doc_id": texts.column("doc_id")[i].as_py(), "n_words": n_words, "n_removed": n_words - len(words), "kept_sha256": hashlib.sha256(kept).hexdigest()}
            if with_text:
                row |= {"kept": text if len(words) == n_words else kept.decode("utf-8", "surrogatepass"), "repeats": repeats}
            for c, v in row.items():
                out[c].append(v)
        made = pa.table(out, schema)
        return made.append_column("more", texts.column("more")) if more else made

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    spark_schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        schema = schema.append(pa.field("kept", pa.string())).append(pa.field("repeats", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))))
        spark_schema += ", kept string, repeats array<struct<first: long, words: long>>"
    if more:
        spark_schema += f", more {own.schema['more'].dataType.simpleString()}"
    return own.groupBy("bucket").cogroup(deep.groupBy("bucket")).applyInArrow(run, spark_schema)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
