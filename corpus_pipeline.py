"""A pipeline for training documents: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last have the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import decontam, jaccard, packing, quality, substrings
from factlake.llm.util import shared_dir, stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted to the labels of these documents, does not reject."""
    model = quality.train(docs, quality.ratings_of(table(spark, sf_dir, "labels")))
    return quality.grade(docs.select(*COLUMNS), model).where("keep").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar ones: that with the least id, a null one last; of rows with equal ids the first."""
    gone = jaccard.similar_groups(docs, with_row=True).where("NOT first").select("row")
    return docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS).join(gone, "row", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that occur more than once; texts of which nothing is left go."""
    cut = substrings.remove_repeats(docs, with_text=True, more=("lang", "source")).where("n_removed < n_words OR n_words = 0")
    return cut.select("doc_id", F.col("kept").alias("text"), "more.lang", "more.source", F.length("kept").cast("long").alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is found."""
    return decontam.clean_rows(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", pack),
]
#: The stages are a fitted model, a tokenizer and algorithms on sequences: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage_of in STAGES[:-1]:
        docs = stage(stage_of(spark, docs, sf_dir), shared_dir(spark))
    return STAGES[-1][1](spark, docs, sf_dir)
