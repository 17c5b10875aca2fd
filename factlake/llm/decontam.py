"""Finding benchmark items in documents, with DataFrame functions only.

A window of a document has as many words as the item it is held against. A document and an item meet on word shingles that
both have (a window without one has similarity 0). Every window that holds such a shingle is looked at: the number of its
shingles that the item has bounds the similarity from above, and what that leaves is verified by the exact similarity of
the weighted shingles (weight: occurrences). The distance of the 64-bit SimHashes is given with each; it decides nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import table

WORDS, THRESHOLD, RADIUS, BITS = 5, 0.75, 23, 64
#: Rows of the benchmark's shingle table up to which it is broadcast (about 150 bytes each); beyond, it is shuffled.
MOST_BROADCAST = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, r"[\x20\x09-\x0D]+"), "")


def shingles(w: Column, size: int) -> Column:
    """Hash of every run of ``size`` words, in order."""
    places = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))


def simhash(s: Column) -> Column:
    """Bit b is set if more of the shingles, each as often as it occurs, have it than not; 0 without shingles."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"),
        lambda acc, b: acc.bitwiseOR(F.when(F.aggregate(s, F.lit(0), lambda n, h: n + F.when(F.getbit(h, b) == 1, 1).otherwise(-1)) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))),
    )


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """(block number, bits of the block) for ``radius + 1`` blocks."""
    cuts = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def similarity(a: Column, b: Column) -> Column:
    """Sum of the lesser over sum of the greater number of occurrences of each shingle."""
    count = lambda s, x: F.size(F.filter(s, lambda y: y == x))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """``item_id, n`` (words), ``k`` (shingle size: all its words if it has fewer than ``size``), ``s`` (shingles), ``f`` (fingerprint); items without words are left out."""
    own = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).select("item_id", "w", F.size("w").alias("n")).where("n > 0")
    sized = own.withColumn("k", F.least("n", F.lit(size)))
    cases = F.when(F.col("k") == 1, shingles(F.col("w"), 1))
    for k in range(2, size + 1):
        cases = cases.when(F.col("k") == k, shingles(F.col("w"), k))
    return sized.withColumn("s", cases).withColumn("f", simhash(F.col("s"))).drop("w")


def windows(own: DataFrame, benchmark: DataFrame, size: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``row, doc_id, item_id, start, n_words, similarity, hamming`` of windows of ``own`` (``row, doc_id, w``: words): see :func:`leaks`."""
    bench = items(benchmark, size=size)
    at = bench.select("item_id", "n", "k", "s", F.posexplode("s").alias("j", "h"))
    at = at.withColumn("before", F.get("s", F.col("j") - 1))
    sizes = at.groupBy("k").count().collect()  # a row a shingle size: 5 at most
    small = sum(r["count"] for r in sizes) <= MOST_BROADCAST
    known = bench.select("item_id", "s", "f")
    known = F.broadcast(known) if small else known
    found = None
    # posexplode_outer: for the inner one Spark adds a filter that makes the shingles twice
    for k in sorted(r["k"] for r in sizes):
        index = at.where(F.col("k") == k).select(F.col("h"), "item_id", "j", "n", "before")
        with_s = own.select("row", "doc_id", F.size("w").alias("words"), shingles(F.col("w"), k).alias("d"))
        if small:
            met = with_s.select("row", "doc_id", "words", "d", F.posexplode_outer("d").alias("pos", "h")).join(F.broadcast(index), "h")
        else:
            met = with_s.select("row", F.posexplode_outer("d").alias("pos", "h")).join(index, "h").join(with_s, "row")
        # the first shingle of each aligned run will do: the others lie less than an item behind it
        met = met.where((F.col("j") == 0) | (F.col("pos") == 0) | ~F.get("d", F.col("pos") - 1).eqNullSafe(F.col("before")))
        last = F.greatest(F.lit(0), F.col("words") - F.col("n"))
        low = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("n") + k, last))
        high = F.least(F.col("pos") + F.col("n") - k, last)
        met = met.select(
            "row", "doc_id", "item_id", F.least(last, F.greatest(F.lit(0), F.col("pos") - F.col("j"))).alias("aligned"), low.alias("low"), F.least("n", "words").alias("n_words"),
            (high - low).alias("more"), F.greatest(F.lit(1), F.col("n") - k + 1).alias("m"), F.slice("d", low + 1, high - low + F.col("n") - k + 1).alias("d"),
        )
        found = met if found is None else found.unionByName(met)
    if found is None:
        return own.sparkSession.createDataFrame([], "row long, doc_id long, item_id long, start int, n_words int, similarity double, hamming int")
    found = found.join(known, "item_id")
    had = found.withColumn("had", F.transform("d", lambda x: F.array_contains("s", x)))
    window = lambda a, i: F.slice(a, i + 1, F.col("m"))
    most = lambda i: F.size(F.filter(window(F.col("had"), i), lambda x: x))
    near = F.filter(F.sequence(F.lit(0), F.col("more")), lambda i: most(i) / (F.size(window(F.col("d"), i)) + F.size("s") - most(i)) >= threshold)
    each = had.withColumn("i", F.explode(near)).withColumn("start", F.col("low") + F.col("i")).withColumn("d", window(F.col("d"), F.col("i")))
    each = each.select("row", "doc_id", "item_id", "start", "n_words", "d", "s", "f", (F.col("start") == F.col("aligned")).alias("aligned"))
    each = each.groupBy("row", "item_id", "start").agg(F.max("aligned").alias("aligned"), *[F.first(c).alias(c) for c in ("doc_id", "n_words", "d", "s", "f")])
    good = each.withColumn("similarity", similarity(F.col("d"), F.col("s"))).where(F.col("similarity") >= threshold)
    own_start = F.when(F.col("aligned"), F.col("start"))
    by = Window.partitionBy("row", "item_id")
    good = good.withColumn("left", F.last(own_start, True).over(by.orderBy("start"))).withColumn("right", F.last(own_start, True).over(by.orderBy(F.desc("start"))))
    apart = lambda gap: F.coalesce(gap >= F.col("n_words"), F.lit(True))
    good = good.where(F.col("aligned") | (apart(F.col("start") - F.col("left")) & apart(F.col("right") - F.col("start"))))
    return good.select("row", "doc_id", "item_id", "start", "n_words", "similarity", F.bit_count(simhash(F.col("d")).bitwiseXOR(F.col("f"))).alias("hamming"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Windows of documents that are benchmark items: ``doc_id, item_id, start`` (word, from 0), ``n_words, similarity, hamming``.

    All windows with a shingle of the item are held against it. Given are those that an aligned shingle starts (it puts the item's
    first word there, moved inside the document if need be) and, where none of these overlaps them, all others; a document
    shorter than the item is one window. Null and empty texts and items have no windows; each of several overlapping windows has a row; rows
    that are repeated give equal rows, once for each; other columns are ignored; empty tables give none.
    """
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    return windows(own, benchmark, size, threshold).drop("row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark item is found; a null id stays."""
    bad = leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows in whose text no benchmark item is found, whatever their ids: each row is judged by itself."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    own = rows.select("row", F.lit(None).cast("long").alias("doc_id"), words(F.col("doc").getField(text_col)).alias("w"))
    return rows.join(windows(own, benchmark).select("row").distinct(), "row", "left_anti").select("doc.*")


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
