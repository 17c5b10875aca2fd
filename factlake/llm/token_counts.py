"""Token totals by source, language and tokenizer version, maintained from signed changes.

A batch of changes (inserts +1, deletes -1, a revision is both) is pre-aggregated where it is read, written as one small
delta table and committed by a file of its batch id that names the table. Totals are additive: the sum of committed deltas.
A batch id that is already there is not applied again, and its file names one table, whoever wrote it: a job that is run
again, or half of it, or twice at a time, cannot count twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokenizing import piece_counts, public
from .util import shared_dir, slices, stage, table

KEYS = ("source", "lang", "version")
#: Tokenizer versions of the query: files of the public tokenizers.
VERSIONS = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}
#: Versions of the query that SQL can express too: white-space words; runs of letters, of digits, and of other signs.
WORDS, RUNS = r"[^\x20\x09-\x0D]+", r"\p{L}+|\p{N}+|[^\p{L}\p{N}\x20\x09-\x0D]+"
PATTERNS = {"words-1": WORDS, "runs-2": RUNS}
#: What a revised text no longer has.
NOISE = r"[*%$&#|!]+"


def count_matches(text: Column, pattern: str) -> Column:
    """Matches in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def count_tokens(docs: DataFrame, versions: Mapping[str, str], text_col: str = "text") -> DataFrame:
    """``doc_id, source, lang, counts``: tokens of each whole text by version (``versions`` has the files' paths); null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            each = piece_counts(tuple(versions.values())).count(b.column("text").to_pylist())
            n = pa.array([x for row in each for x in row], pa.int64())
            offsets = pa.array(range(0, len(n) + 1, len(versions)), pa.int32())
            counts = pa.MapArray.from_arrays(offsets, pa.array(list(versions) * len(each), pa.string()), n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("lang"), counts], ["doc_id", "source", "lang", "counts"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, source string, lang string, counts map<string, long>")


class TokenCounts:
    """Rollups of token counts in a shared folder.

    Changes have ``source, lang, version, sign, n_tokens``; further columns are ignored. Null sources, languages and
    versions are groups of their own, null signs and counts are 0. An empty batch commits an empty delta.
    """

    SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or shared_dir(spark)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _at(self, batch_id: str) -> str:
        if not batch_id or set(batch_id) & set("/\\{}*?[]:,_."):
            raise ValueError(f"not a batch id: {batch_id!r}")
        return f"{self.folder}/commits/{batch_id}"

    def committed(self, batch_id: str) -> bool:
        fs, path = self._fs(self._at(batch_id))
        return fs.exists(path)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it had been applied."""
        if self.committed(batch_id):
            return False
        sign, n = F.coalesce(F.col("sign").cast("long"), F.lit(0)), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
        delta = changes.groupBy(*[F.col(k).cast("string").alias(k) for k in KEYS]).agg(F.sum(sign).alias("n_docs"), F.sum(sign * n).alias("n_tokens"))
        name = uuid.uuid4().hex
        delta.coalesce(1).write.parquet(f"{self.folder}/deltas/{name}")
        fs, path = self._fs(self._at(batch_id))
        fs.mkdirs(path.getParent())
        tmp = self._fs(f"{self.folder}/{name}.tmp")[1]
        out = fs.create(tmp, False)
        out.write(bytearray(name.encode()))
        out.close()
        if fs.exists(path) or not fs.rename(tmp, path):
            fs.delete(tmp, False)
        return self._named(path) == name

    def _named(self, path) -> str:
        stream = self._fs(str(path))[0].open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def deltas(self) -> DataFrame:
        fs, path = self._fs(f"{self.folder}/commits")
        names = [self._named(x.getPath()) for x in fs.listStatus(path) if not x.getPath().getName().startswith(".")] if fs.exists(path) else []
        if not names:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.folder}/deltas/{n}" for n in names])

    def totals(self) -> DataFrame:
        """``source, lang, version, n_docs, n_tokens`` of what is there now; groups with nothing left are gone."""
        total = self.deltas().groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return total.where("n_docs <> 0 OR n_tokens <> 0")


def signed(counts: DataFrame, sign: int, column: str = "counts") -> DataFrame:
    """Changes from per-document counts (a map of version to count)."""
    return counts.select("source", "lang", F.explode(column).alias("version", "n_tokens"), F.lit(sign).alias("sign"))


def rolled_up(spark: SparkSession, counts: DataFrame, revised: DataFrame, toxic: DataFrame, poor: DataFrame) -> DataFrame:
    """Totals after all documents were loaded (twice: the second is a replay), toxic ones taken down and poor ones revised."""
    rollup = TokenCounts(spark)
    for batch, changes in (
        ("load", signed(counts, 1)),
        ("load", signed(counts, 1)),
        ("takedown", signed(counts.join(toxic, "doc_id", "left_semi"), -1)),
        ("revision", signed(counts.join(poor, "doc_id", "left_semi"), -1).unionByName(signed(revised, 1))),
    ):
        rollup.commit(batch, changes)
    return rollup.totals()


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, and the ids of toxic ones and of others of low quality."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    return docs, toxic, labels.where("quality = 0").select("doc_id").distinct().join(toxic, "doc_id", "left_anti")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Loads all documents (twice: the second is a replay), takes toxic ones down, and revises those of low quality to texts without noise signs."""
    docs, toxic, poor = judged(spark, sf_dir)
    files = {v: public(f) for v, f in VERSIONS.items()}
    counts = stage(count_tokens(docs, files))
    # only texts with noise signs have other counts once revised: these alone are counted again, and no text is moved to meet its label
    cleaned = count_tokens(docs.where(F.col("text").rlike(NOISE)).withColumn("text", F.regexp_replace("text", NOISE, "")), files)
    revised = counts.join(poor, "doc_id", "left_semi").join(cleaned, "doc_id", "left_anti").unionByName(cleaned.join(poor, "doc_id", "left_semi"))
    return rolled_up(spark, counts, revised, toxic, poor)


def token_counts_by_pattern(spark, sf_dir: str) -> DataFrame:
    """The same with versions that are regular expressions, which SQL can express."""
    docs, toxic, poor = judged(spark, sf_dir)

    def counted(text: Column) -> Column:
        return F.create_map(*[x for v, p in PATTERNS.items() for x in (F.lit(v), count_matches(text, p))])

    both = stage(docs.select("doc_id", "source", "lang", counted(F.col("text")).alias("counts"), counted(F.regexp_replace("text", NOISE, "")).alias("revised")))
    revised = both.join(poor, "doc_id", "left_semi").select("doc_id", "source", "lang", F.col("revised").alias("counts"))
    return rolled_up(spark, both, revised, toxic, poor)


PATTERN_SQL = rf"""
WITH toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
poor AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM toxic)),
final AS (
  SELECT source, lang, CASE WHEN doc_id IN (SELECT doc_id FROM poor) THEN regexp_replace(text, '{NOISE}', '', 'g') ELSE text END AS text
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM toxic)),
counted AS (
  SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(text, '{WORDS}')) AS n FROM final
  UNION ALL SELECT source, lang, 'runs-2', len(regexp_extract_all(text, '{RUNS}')) FROM final)
SELECT source, lang, version, count(*) AS n_docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_tokens FROM counted GROUP BY 1, 2, 3
"""
