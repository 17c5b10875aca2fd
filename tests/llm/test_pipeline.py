import random
from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from factlake.llm import registry

DATA = Path("/root/testdata/sf0.001")


def test_registered():
    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in registry.QUERIES if q.startswith("op")} and "pipeline" in found
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_stages(spark):
    """Each stage against what its rule says of its own input."""
    docs, sf_dir = spark.read.parquet(str(DATA / "documents.parquet")), str(DATA)
    for name, stage_of in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stage(stage_of(spark, docs, sf_dir))
        assert after.columns == corpus_pipeline.COLUMNS and dict(after.dtypes) == dict(docs.dtypes)
        before, left = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in after.collect()}
        assert set(left) <= set(before) and 0 < len(left) <= len(before), name
        if name != "substring dedup":
            assert all(before[d] == t for d, t in left.items())
        docs = after
    packed = corpus_pipeline.pack(spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == set(left)


SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, path, rows, items=(), labels=()):
    """Tables of a small corpus: rows are (doc_id, text)."""
    spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in rows], SHAPE).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet"), str(path)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))


def test_rows_without_or_with_repeated_ids(spark, tmp_path):
    """Each stage keeps or drops rows, not ids: one row of a repeated or id-less copy stays to the end, and a clean text with a removed row's id."""
    rng = random.Random(2)
    a, b, c, d, e, item = (prose(rng, 60) for _ in range(6))
    rows = [(1, a), (1, a), (None, b), (None, b), (2, c), (None, c), (3, d), (4, d), (4, e), (5, f"x {item} y"), (None, f"z {item}"), (5, prose(rng, 50)), (None, None), (6, "")]
    docs, sf_dir = folder(spark, tmp_path, rows, [(9, item)])
    once = corpus_pipeline.stage(corpus_pipeline.near_duplicates(spark, docs, sf_dir))
    left = [(1, a), (None, b), (2, c), (3, d), (4, e), rows[9], rows[11], (None, None), (6, "")]
    assert pairs(once) == sorted(left, key=str)
    cut = corpus_pipeline.stage(corpus_pipeline.repeated_passages(spark, once, sf_dir))
    assert [x[0] for x in pairs(cut)].count(1) == 1 and (1, a) in pairs(cut) and (None, b) in pairs(cut)
    clean = corpus_pipeline.benchmark_leaks(spark, docs, sf_dir)
    assert pairs(clean) == sorted([r for r in rows if item not in (r[1] or "")], key=str)


@pytest.mark.parametrize("labels", [[], [(i, 0, 1) for i in range(20)]])
def test_nothing_known_rejects_nothing(spark, tmp_path, labels):
    """Without labels, or with one grade only, the first stage keeps every document."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 20)) for i in range(20)] + [(None, "no id"), (30, None)]
    docs, sf_dir = folder(spark, tmp_path, rows, labels=labels)
    assert pairs(corpus_pipeline.quality_filter(spark, docs, sf_dir)) == sorted(rows, key=str)
