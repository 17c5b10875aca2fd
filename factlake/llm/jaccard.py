"""Set-similarity join of documents on word shingles, by prefixes of token combinations.

A pair links when the Jaccard similarity of its shingle sets is at least ``NUM / DEN``. Documents with too many shingles of their
own have no partner and end early; equal sets are settled by their first document. Of what is left, every shingle's documents
are counted, and in one order of all shingles, those of fewest documents first, a document's *extended prefix* must share a
signature with each partner's:

* rare shingles are signatures by themselves: so many are indexed as, with those nobody shares, exceed ``n - ceil(t n)``;
* if there are too few, the prefix extends into the frequent class, whose signatures are combinations of two shingles
  that are neighbours in the order. Of p shingles in the prefix, d missing from the partner and i inserted by it break at most
  2d + i of the p - 1 combinations, and 2d + i <= n/2 - 2s where s shingles are not frequent, so n//2 - 2s + 2 suffice.

Sizes, shared shingles and places in the prefixes rule pairs out before they are made. First a signature's leading document
meets the others of each worker, and the workers' leading ones the first of them; verified links join documents into components;
then only pairs across components are made: those of a signature's first document with the others of all workers, then those of
the next ones, by every reducer at most ``MOST`` times as many as it has signatures, in as many rounds as that takes. So no link
that joins components is lost, and a group of copies costs a few pairs a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyed import BLOCKS, ENTRY, GATHER, GROUPED, PLACE, batches_of, buckets, cut_by, gathered, key_bucket, numbered, release, repeated, send, unpack
from .util import drop, mix, slices, stage, steady, table, windows, word_hashes

WORDS, NUM, DEN = 5, 75, 100
#: Occurrences among the entries that a worker sends together from which it answers for them itself.
LOCAL = 8
#: Documents from which a shingle is of the frequent class. Pairs a reducer makes in a round: as many times its signatures.
FREQUENT, MOST = 64, 4


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text, A-Z in lower case; the whole sequence if it has fewer words; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    if len(words) < size:
        return mix(windows(h, len(words)) + np.uint64(len(words)))
    return np.unique(windows(h, size))


def allowed(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles of a set of n that may be missing from a partner: n - ceil(t n)."""
    return n - -(-n * NUM // DEN)


def signatures(n: int, keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, int]:
    """Signatures of a set of ``n`` shingles of which ``keys`` occur elsewhere too, each in ``count`` documents, by their places in the order, and the place of the first frequent one."""
    if n == 1:
        return keys, 1
    spare, once = allowed(n), n - len(keys)
    rare = int((count < FREQUENT).sum())
    if once > spare:
        return keys[:0], rare
    keys = keys[np.lexsort((keys, count))]
    if once + rare > spare:
        sig = keys[: spare + 1 - once]
    else:
        dense = keys[rare:][: n // 2 - 2 * (once + rare) + 2]
        sig = np.concatenate([keys[:rare], mix(dense[:-1] * np.uint64(3) + dense[1:])])
    return sig, rare


def _sent(docs: DataFrame, n: int, size: int) -> DataFrame:
    """Blocks of all shingles of all documents; ``at`` is the size of the document's set. Blocks of kind 2 have every document's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            yield from send(np.concatenate(held), n, LOCAL, ENTRY)
            each = np.array(sizes, PLACE)
            yield from batches_of(cut_by(each["row"] % n, each, 2))

        held, sizes, total = [], [], 0
        for b in slices(batches):
            for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = shingles(text, size)
                e = np.empty(len(s), ENTRY)
                e["key"], e["row"], e["at"] = s, row, len(s)
                held.append(e)
                sizes.append((row, len(s)))
                total += len(s)
                if total >= GATHER:
                    yield from out()
                    held, sizes, total = [], [], 0
        if held:
            yield from out()

    return docs.select("row", "text").mapInArrow(run, BLOCKS)


def _survivors(found: DataFrame, n: int) -> DataFrame:
    """Documents that may have partners: ``bucket, row, n, same, keys``; ``same`` is equal for equal sets of which every shingle is shared."""

    def grouped(key: tuple, blocks: pa.Table) -> pa.Table:
        x = gathered(blocks.column("block"), ENTRY)
        x = x[np.lexsort((x["key"], x["row"]))]
        first = np.flatnonzero(np.append(True, x["row"][1:] != x["row"][:-1])) if len(x) else np.empty(0, np.int64)
        end = np.append(first[1:], len(x))
        size = x["at"][first].astype(np.int64)
        keep = np.flatnonzero(size - (end - first) <= allowed(size))
        out: dict[str, list] = {c: [] for c in schema.names}
        for i in keep.tolist():
            k = np.ascontiguousarray(x["key"][first[i] : end[i]])
            full = len(k) == size[i]
            out["bucket"].append(key[0].as_py()), out["row"].append(int(x["row"][first[i]])), out["n"].append(int(size[i]))
            out["same"].append(np.array([mix(k).sum(), mix(mix(k)).sum(), size[i]], np.uint64).tobytes() if full else None)
            out["keys"].append(k.tobytes())
        return pa.table(out, schema)

    schema = pa.schema([("bucket", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("keys", pa.binary())])
    return found.where("kind = 1").groupBy("bucket").applyInArrow(grouped, "bucket long, row long, n long, same binary, keys binary")


def _sizes(found: DataFrame) -> DataFrame:
    """``row, n_shingles`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = gathered(b.column("block"), PLACE)
            yield pa.RecordBatch.from_arrays([pa.array(x["row"]), pa.array(x["at"].astype(np.int64))], ["row", "n_shingles"])

    return found.where("kind = 2").select("block").mapInArrow(run, "row long, n_shingles long")


def _sets(rows: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(k, np.uint64) for k in rows.column("keys").to_pylist()]


def _counted(docs: DataFrame, n: int) -> DataFrame:
    """For each bucket of documents (``sender``) and each of keys (``to``, in order) in how many documents its distinct keys are: 4 bytes each, in order."""

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        keys, count = np.unique(np.concatenate(_sets(rows)), return_counts=True)
        where = key_bucket(keys, n)
        first = np.flatnonzero(np.diff(where, prepend=-1)).tolist()
        blocks = [keys[a:b].tobytes() + count[a:b].astype("<u4").tobytes() for a, b in zip(first, [*first[1:], len(keys)], strict=True)]
        return pa.table({"to": pa.array(where[first], pa.int64()), "sender": pa.array([key[0].as_py()] * len(first), pa.int64()), "block": pa.array(blocks, pa.binary())})

    def tell(key: tuple, asked: pa.Table) -> pa.Table:
        blocks = asked.column("block").to_pylist()
        size = [len(b) // 12 for b in blocks]
        keys = np.concatenate([np.frombuffer(b, np.uint64, k) for b, k in zip(blocks, size, strict=True)])
        count = np.concatenate([np.frombuffer(b, "<u4", k, 8 * k) for b, k in zip(blocks, size, strict=True)])
        own, at = np.unique(keys, return_inverse=True)
        total = np.minimum(np.bincount(at, weights=count, minlength=len(own)), 0xFFFFFFFF)[at].astype("<u4")
        ends = np.cumsum(size).tolist()
        return pa.table({"sender": asked.column("sender"), "to": asked.column("to"), "block": pa.array([total[e - k : e].tobytes() for e, k in zip(ends, size, strict=True)], pa.binary())})

    asked = docs.select("bucket", "keys").groupBy("bucket").applyInArrow(ask, "to long, sender long, block binary")
    return asked.groupBy("to").applyInArrow(tell, "sender long, to long, block binary")


def _prefixed(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """Documents that may still have partners: ``row, n, m`` (shingles that others have), ``sig``, ``at`` (signatures and their places), ``keys`` (the m shingles)."""

    def run(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        sets = _sets(rows)
        order = np.argsort(told.column("to").to_numpy())
        blocks = told.column("block").to_pylist()
        total = np.frombuffer(b"".join(blocks[i] for i in order.tolist()), "<u4")
        out: dict[str, list] = {c: [] for c in schema.names}
        if sets:
            own, at = np.unique(np.concatenate(sets), return_inverse=True)
            at, lo = total[at], 0
            for row, n, keys in zip(rows.column("row").to_pylist(), rows.column("n").to_pylist(), sets, strict=True):
                count, lo = at[lo : lo + len(keys)], lo + len(keys)
                keys, count = keys[count > 1], count[count > 1]
                sig, rare = signatures(n, keys, count)
                if len(sig):
                    for c, v in zip(schema.names, (row, n, len(keys), sig.tobytes(), rare, keys.tobytes()), strict=True):
                        out[c].append(v)
        return pa.table(out, schema)

    schema = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("sig", pa.binary()), ("rare", pa.int64()), ("keys", pa.binary())])
    return docs.select("bucket", "row", "n", "keys").groupBy("bucket").cogroup(counted.groupBy("sender")).applyInArrow(run, "row long, n long, m long, sig binary, rare long, keys binary")


#: A signature, a document, its component so far, its size, shared shingles and ``excess``, and the signature's place, also among frequent ones.
SIGNED = np.dtype([("key", "<u8"), ("row", "<i8"), ("label", "<i8"), ("n", "<i8"), ("m", "<i8"), ("place", "<u4"), ("dense", "<u4"), ("excess", "<u2")])
#: Sums of two documents' excess up to which they may be linked.
LIMIT = 30_000 * (DEN - NUM) // NUM
PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])


def excess(n: int, shared: int) -> int:
    """30,000 (n / shared - 1), rounded down, of a set with ``shared`` of its n shingles in other sets too.

    Two sets have at most the lesser of their shared numbers in common, so their similarity is at most 1 / (n / shared + n' / shared' - 1):
    they can't be linked if the sum of their excess is above ``LIMIT``.
    """
    return min(60_000, 30_000 * (n - shared) // shared)


def records(sig: np.ndarray, row: int, label: int, n: int, m: int, rare: int) -> np.ndarray:
    """Records of a document's signatures."""
    e = np.empty(len(sig), SIGNED)
    e["key"], e["row"], e["label"], e["n"], e["m"], e["excess"] = sig, row, label, n, m, excess(n, m)
    e["place"] = np.arange(len(sig))
    e["dense"] = np.maximum(np.arange(len(sig)) - rare, 0)
    return e


def _grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records by signature, those with the least excess first; each signature's first place and number of records."""
    x = x[np.lexsort((x["row"], x["excess"], x["key"]))]
    start = np.flatnonzero(np.append(True, x["key"][1:] != x["key"][:-1])) if len(x) else np.empty(0, np.int64)
    return x, start, np.diff(np.append(start, len(x)))


def _may(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two documents of a signature can be linked, if no earlier one is common: by their sizes, shared shingles and the signature's places.

    Before the first common combination no two common shingles are neighbours in both sets, so at most a third of what both have there is common.
    """
    most = np.minimum(np.minimum(a["m"], b["m"]), (a["dense"].astype(np.int64) + b["dense"]) // 3 + np.minimum(a["m"] - a["place"], b["m"] - b["place"]))
    return (a["label"] != b["label"]) & (DEN * most >= NUM * (a["n"] + b["n"] - most))


def _meet(x: np.ndarray, lo: int, hi: int | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs with different labels, that may be linked, of each signature's documents number ``lo`` up to ``hi`` and its later ones; the first record of each signature; and the number at which ``most`` pairs were there, or -1 if all were made.

    Documents come in order of their excess: once a document and the next one exceed the limit, so do all later ones.
    """
    x, start, count = _grouped(x)
    firsts, found, total = x[start], [np.empty((0, 2), np.int64)], 0
    if len(x):
        begin = np.repeat(start, count)
        place = np.arange(len(x)) - begin
        sums = x["excess"].astype(np.int64)
        low, high = np.minimum.reduceat(x["label"], start), np.maximum.reduceat(x["label"], start)
        at = np.flatnonzero(np.repeat(low < high, count))
        j = lo
        while len(at) and (hi is None or j < hi):
            if most is not None and total > most:
                return np.unique(np.concatenate(found), axis=0), firsts, j
            at = at[place[at] > j]
            head = begin[at] + j
            at = at[sums[head] + sums[np.minimum(head + 1, len(x) - 1)] <= LIMIT]
            head = begin[at] + j
            may = _may(x[head], x[at])
            found.append(np.sort(np.stack([x["row"][head[may]], x["row"][at[may]]], 1), axis=1))
            total += int(may.sum())
            j += 1
    return np.unique(np.concatenate(found), axis=0), firsts, -1


def _signed(docs: DataFrame, n: int, local: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], wanted: Mapping[int, int] | None = None) -> DataFrame:
    """Blocks of signatures of documents (``row, n, m, sig, rare, label``): ``local`` gives what goes to the reducers (if ``wanted``, those only) and the pairs met already."""
    live = np.ones(n, bool) if wanted is None else np.isin(np.arange(n), list(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            x, met = local(x[live[key_bucket(x["key"], n)]])
            pair = np.empty(len(met), PAIR)
            pair["a"], pair["b"] = met[:, 0], met[:, 1]
            yield from batches_of(cut_by(pair["a"] % n, pair, 1) + cut_by(key_bucket(x["key"], n), x, 0))

        held, total = [], 0
        for batch in batches:
            for row, size, m, sig, rare, label in zip(*(batch.column(c).to_pylist() for c in ("row", "n", "m", "sig", "rare", "label")), strict=True):
                held.append(records(np.frombuffer(sig, np.uint64), row, label, size, m, rare))
                e = held[-1]
                total += len(e)
                if total >= GATHER:
                    yield from out(np.concatenate(held))
                    held, total = [], 0
        if total:
            yield from out(np.concatenate(held))

    return docs.select("row", "n", "m", "sig", "rare", "label").mapInArrow(run, BLOCKS)


def _mixed(docs: DataFrame, n: int) -> DataFrame:
    """Labels of which a document shares a signature with one of another label."""

    def local(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x[np.lexsort((x["excess"], x["label"], x["key"]))]
        return x[np.append(True, (x["key"][1:] != x["key"][:-1]) | (x["label"][1:] != x["label"][:-1]))[: len(x)]], np.empty((0, 2), np.int64)

    def grouped(blocks: pa.Table) -> pa.Table:
        x, _ = local(gathered(blocks.column("block"), SIGNED))
        x, start, count = _grouped(x)  # the least excess of each label
        first = np.repeat(x["excess"][start].astype(np.int64), count)
        second = np.repeat(x["excess"][np.minimum(start + 1, len(x) - 1)].astype(np.int64), count)
        place = np.arange(len(x)) - np.repeat(start, count)
        may = np.repeat(count > 1, count) & (x["excess"] + np.where(place > 0, first, second) <= LIMIT)
        return pa.table({"label": pa.array(np.unique(x["label"][may]), pa.int64())})

    return _signed(docs, n, local).groupBy("bucket").applyInArrow(grouped, "label long").distinct()


def _pairs(docs: DataFrame, n: int, begun: Mapping[int, int] | None = None) -> tuple[DataFrame, dict[int, int]]:
    """Candidate pairs ``a, b`` of documents with different labels that share a signature; and the reducers that have more to do, with the document they came to.

    At first (``begun`` is None) only each signature's first document meets the others, those that a worker sees together there.
    What a worker's first document met there has not met the first one of all: all reducers have more to do then, from number 0 on,
    and as the first one's links spare most other pairs, they are verified before more are made.
    """

    def local(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if begun is not None:
            return x, np.empty((0, 2), np.int64)
        met, x, _ = _meet(x, 0, 1)
        return x, met

    def grouped(key: tuple, blocks: pa.Table) -> pa.Table:
        kinds, data, own = blocks.column("kind").to_numpy(), blocks.column("block").to_pylist(), key[0].as_py()
        parts = [(own, 1, x) for k, x in zip(kinds, data, strict=True) if k == 1]
        x = unpack([x for k, x in zip(kinds, data, strict=True) if k == 0], SIGNED)
        pairs, _, to = _meet(x, 0, 1) if begun is None else _meet(x, begun[own], None, max(50_000, MOST * len(x)) if begun[own] else 0)
        pair = np.empty(len(pairs), PAIR)
        pair["a"], pair["b"] = pairs[:, 0], pairs[:, 1]
        parts += cut_by(pair["a"] % n, pair, 1)
        if to >= 0:
            parts.append((own, 2, to.to_bytes(8, "little")))
        return pa.Table.from_batches(list(batches_of(parts)), GROUPED)

    def once(blocks: pa.Table) -> pa.Table:
        pairs = np.unique(gathered(blocks.column("block"), PAIR))
        return pa.table({"a": pa.array(pairs["a"], pa.int64()), "b": pa.array(pairs["b"], pa.int64())})

    made = stage(_signed(docs, n, local, begun).groupBy("bucket").applyInArrow(grouped, BLOCKS))
    if begun is None:
        left = dict.fromkeys(range(n), 0)
    else:
        left = {r["bucket"]: int.from_bytes(r["block"], "little") for r in made.where("kind = 2").collect()}  # a row a reducer at most
    return stage(made.where("kind = 1").groupBy("bucket").applyInArrow(once, "a long, b long")), left


def bitmap(keys: np.ndarray) -> bytes:
    """A bit for each of 4 to 8 times as many cells of the key space as there are keys, set where a key falls."""
    size = max(3, int(4 * len(keys)).bit_length())
    bits = np.zeros(1 << size, np.uint8)
    bits[(keys >> np.uint64(64 - size)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def most_common(a: bytes, na: int, b: bytes, nb: int) -> int:
    """An upper bound of the keys that sets of ``na`` and ``nb`` keys with these bitmaps share: cells that both hold, and keys beyond one a cell."""
    x, y = np.unpackbits(np.frombuffer(a, np.uint8)), np.unpackbits(np.frombuffer(b, np.uint8))
    while len(x) > len(y):
        x = x[::2] | x[1::2]
    while len(y) > len(x):
        y = y[::2] | y[1::2]
    both, px, py = np.count_nonzero(x & y), np.count_nonzero(x), np.count_nonzero(y)
    return both + min(na - px, nb - py)


def _links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough. Shingles that occur once only need not be looked at.

    Bitmaps, a small part of the sets' size, rule out most pairs first; only the rest is joined with the sets themselves.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keys = [np.frombuffer(k, np.uint64) for k in x.column("keys").to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column("row"), x.column("n"), pa.array([len(k) for k in keys], pa.int64()), pa.array([bitmap(k) for k in keys], pa.binary())], ["row", "n", "m", "bits"])

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select(*[F.col(c).alias(x if c == "row" else f"{c}{x}") for c in df.columns])

    def ruled_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for na, nb, ma, mb, a, b in zip(*(x.column(c).to_pylist() for c in ("na", "nb", "ma", "mb", "bitsa", "bitsb")), strict=True):
                most = min(ma, mb)
                if DEN * most >= NUM * (na + nb - most):
                    most = min(most, most_common(a, ma, b, mb))
                keep.append(DEN * most >= NUM * (na + nb - most))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sketches = docs.select("row", "n", "keys").mapInArrow(sketch, "row long, n long, m long, bits binary")
    near = stage(pairs.join(side(sketches, "a"), "a").join(side(sketches, "b"), "b").mapInArrow(ruled_out, "a long, b long"))
    own = docs.select("row", "n", "keys")
    both = near.join(side(own, "b"), "b").join(side(own, "a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for na, nb, ka, kb in zip(*(x.column(c).to_pylist() for c in ("na", "nb", "keysa", "keysb")), strict=True):
                common = len(np.intersect1d(np.frombuffer(ka, np.uint64), np.frombuffer(kb, np.uint64), assume_unique=True))
                keep.append(DEN * common >= NUM * (na + nb - common))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``row, label``: for every row on an edge (``a, b``) the least row reachable. Alternates large-star and small-star steps until nothing changes."""
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        after = stage(small)
        # a star forest: nothing above a root is anyone's root
        if after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and after.groupBy("u").count().where("count > 1").isEmpty():
            return after.select(F.col("u").alias("row"), F.col("v").alias("label"))
        edges = after


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, with_row: bool = False) -> DataFrame:
    """One row for each document: ``doc_id, n_shingles, component_id`` (the least id in its component, itself included).

    Null and empty texts and those without words have no shingles and are linked with nothing; repeated rows are linked with
    each other if they have words; rows without an id take part and their component has the least id that isn't null, if any;
    an empty table gives none; other columns are ignored, whatever their names. If asked for, ``row`` (``monotonically_increasing_id``
    over ``docs``, which must then be read from files) and ``first``: true for one row of each component, that with the least id
    (nulls last) and of these the least number.
    """
    spark, docs = docs.sparkSession, steady(docs)
    n = buckets(docs, text_col, 2)
    own = numbered(docs, id_col, text_col, n)
    found = stage(repeated(_sent(own, n, size), n, ENTRY))
    release(spark)  # of the shuffle of all shingles
    kept = stage(_survivors(found, n))
    sizes = stage(_sizes(found))
    drop(found)
    # equal sets: all but the first are settled
    same = stage(kept.where("same IS NOT NULL").groupBy("same").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    equal = stage(kept.select("row", "same").join(same, "same").where("row <> first").select(F.col("row").alias("b"), F.col("first").alias("a")))
    reps = stage(kept.join(equal.select(F.col("b").alias("row")), "row", "left_anti").drop("same"))
    drop(kept)
    signed = stage(_prefixed(reps, _counted(reps, n)))
    drop(reps)
    release(spark)
    pairs, begun = _pairs(signed.withColumn("label", F.col("row")), n)
    links = stage(_links(pairs, signed))
    label = components(links)
    while begun:
        # only components that share a signature with another one can have a link between them left
        now = signed.join(label, "row", "left").withColumn("label", F.coalesce("label", "row"))
        left = stage(now.join(stage(_mixed(now, n)), "label", "left_semi"))
        pairs, begun = _pairs(left, n, begun)
        new = stage(_links(pairs, signed))
        drop(left)
        if not new.isEmpty():
            links = links.unionByName(new)
            label = components(links)
    ids = own.select("row", "doc_id")
    copies = equal.join(label.withColumnRenamed("row", "a"), "a", "left").select(F.col("b").alias("row"), F.coalesce("label", "a").alias("label"))
    member = label.unionByName(copies)
    member = stage(member.unionByName(member.select(F.col("label").alias("row"), "label").distinct()))
    least = member.join(ids, "row").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head"))
    own_least = member.join(least, "label").select("row", "component_id", (F.col("row") == F.col("head.row")).alias("first"))
    out = ids.join(sizes, "row").join(own_least, "row", "left")
    more = ["row", F.coalesce("first", F.lit(True)).alias("first")] if with_row else []
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *more)


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))
