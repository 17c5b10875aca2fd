"""Classifier, language, likelihood and counts: on fixtures with known answers."""

import os
import random
import re
from pathlib import Path

import duckdb
import collections
import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.llm import decontam, langid, lm, quality, token_counts

DATA = Path("/root/testdata/sf0.001")


def test_quality(spark):
    rng = random.Random(1)
    docs, ratings = [], []
    for i in range(300):
        words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(40)]
        g = i % 3
        if g < 2:
            words[5] = rng.choice(["awful", "dreadful"])
        if g == 0:
            words = [w + "***" for w in words]
        docs.append((i, " ".join(words), "k")), ratings.append((i, g))
    docs += [(900, None, "k"), (901, "", "k"), (None, "plain words", "k"), (5, docs[5][1], "k")]
    ratings += [(7, None), (None, 1), (8, 9), (5000, 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string, keep string")
    r = spark.createDataFrame(ratings, "doc_id long, grade int")
    model = quality.train(d.where("doc_id < 200"), r)
    assert (np.diff(model.theta) >= 0).all()
    out = {x["doc_id"]: x for x in quality.grade(d, model).collect()}
    held = [i for i in range(200, 300)]
    assert np.mean([(out[i]["p_top"] >= 0.5) == (i % 3 == 2) for i in held]) > 0.95
    mean = [np.mean([out[i]["expected_grade"] for i in held if i % 3 == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert quality.grade(d, model).count() == len(docs) and quality.grade(d.limit(0), model).count() == 0
    none = quality.train(d.limit(0), r)
    assert 0 < quality.grade(d.limit(1), none).first()["p_top"] < 1


def test_language(spark):
    texts = {"en": "the weather is what they think about when they are there with others", "de": "ich habe nicht gewusst dass sie schon wieder durch die strassen gehen", "ru": "мы не знали что они уже снова идут по улицам города"}
    rows = [(i, t, k) for i in range(5) for k, t in texts.items()]
    docs = spark.createDataFrame([*rows, (50, None, "en"), (51, "x", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["de", "en", "ru"]
    mixed = f"{texts['en']} {texts['de']} {texts['ru']} {texts['ru']}"
    test = spark.createDataFrame([(1, "they think about the weather"), (2, mixed), (3, None), (4, "12 34 ..."), (5, ""), (6, "знали улицам")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(test, model, with_spans=True).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "ru", "und", "und", "und", "ru"]
    assert [s["lang"] for s in got[2]["spans"]] == ["en", "de", "ru"] and got[3]["score"] == 0 and 0 < got[2]["score"] < 1
    nothing = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(test, nothing).collect()} == {"und"}


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    counts = np.array([3, 0, 5, 1])
    e = rng.normal(0, 8, (counts.sum(), 3)).astype(np.float32)
    got = langid.viterbi(e, counts, 6.0)
    at = 0
    for n in counts:
        best = max((sum(e[at + i, p[i]] for i in range(n)) - 6.0 * sum(a != b for a, b in zip(p, p[1:])), p) for p in np.ndindex(*[3] * n)) if n else (0, ())
        assert tuple(got[at : at + n]) == tuple(best[1])
        at += n


def test_likelihood(spark):
    rng = random.Random(4)
    good = lambda: " ".join(f"{a} {b}" for a, b in rng.choices([("red", "apple"), ("green", "pear"), ("blue", "sky")], k=60))
    bad = lambda: " ".join(rng.choices("red apple green pear blue sky".split(), k=120))
    rows = [(i, good()) for i in range(60)] + [(100 + i, bad()) for i in range(3)] + [(200, None), (201, ""), (202, "zebra quagga"), (0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    out = lm.score_documents(docs).collect()
    mean = lambda lo, hi: np.mean([r["mean_log_likelihood"] for r in out if lo <= r["doc_id"] < hi and r["mean_log_likelihood"] is not None])
    assert mean(0, 60) > mean(100, 103) + 0.5
    assert {(r["n_tokens"], r["log_likelihood"], r["mean_log_likelihood"]) for r in out if r["doc_id"] in (200, 201)} == {(0, 0.0, None)}
    assert lm.score_documents(docs.limit(0)).count() == 0


def test_lexicon_is_a_distribution(spark):
    words = " ".join(f"w{i % 700}" for i in range(5000))
    counts = lm.count_words(spark.createDataFrame([(words,)], "text string"))
    lex = lm.lexicon(counts)
    h = np.unique(lm.hashes(words))
    cls, inside = lex.look_up(h)
    for c in np.unique(cls):
        assert np.exp(inside[cls == c]).sum() <= 1.01
    assert (counts.agg(F.sum("n")).first()[0], len(h)) == (5000, 700)


def test_rare_words_have_their_own_counts(spark, monkeypatch):
    """Words that aren't sent to the workers: of one class and in equal places, their scores differ by their counts alone."""
    monkeypatch.setattr(lm, "VOCABULARY", 3)
    group = {}
    for i in range(400):
        group.setdefault(int(lm.hashes(f"rare{i}")[0]) & (lm.SHARED - 1), []).append(f"rare{i}")
    a, b, c = next(v for v in group.values() if len(v) >= 3)[:3]
    rows = [(i, "the of and " * 300) for i in range(20)] + [(100, a), (101, b), (102, c)] + [(103, a)] * 4 + [(104, f"{b} {c} {b}")]
    out = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100]["log_likelihood"] - out[101]["log_likelihood"] == pytest.approx(np.log(5 / 3), abs=1e-4)
    assert out[101]["log_likelihood"] - out[102]["log_likelihood"] == pytest.approx(np.log(3 / 2), abs=1e-4)
    assert out[100]["log_likelihood"] == pytest.approx(out[103]["log_likelihood"], abs=1e-4) and len(out) == 25


def test_all_documents_train(spark):
    """Words of documents that no sample holds are learned too, from every partition."""
    rows = [(i, " ".join(["one two three" if i % 2 else "red green blue"] * 4000)) for i in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lex = lm.lexicon(lm.count_words(docs))
    own = lm.encoded(docs.selectExpr("monotonically_increasing_id() AS row", "CAST(NULL AS long) AS doc_id", "text"), lex)
    net = lm.train_on_all(own, lm.train([]))
    for _, text in rows[:2]:
        cls = lex.look_up(lm.hashes(text))[0][:60]
        assert net.log_probability(lm.contexts(cls), cls).mean() > -3.5 > np.log(1 / lm.CLASSES)
    assert lm.train_on_all(own.limit(0), net) is net


def test_gradient():
    """The network learns a deterministic sequence."""
    seq = np.tile(np.arange(5), 400)
    net = lm.train([seq], steps=200)
    assert np.exp(net.log_probability(lm.contexts(seq)[10:100], seq[10:100])).mean() > 0.9


def test_counts(spark):
    t = token_counts.TokenCounts(spark)
    shape = "source string, lang string, version string, sign int, n_tokens long, n_docs string"
    assert t.totals().count() == 0
    first = spark.createDataFrame([("a", "en", "v1", 1, 10, ""), ("a", "en", "v1", 1, 5, ""), (None, None, "v1", 1, 7, ""), ("b", "fr", "v1", None, None, "")], shape)
    assert t.commit("b1", first) and not t.commit("b1", first)
    assert {tuple(r) for r in t.totals().collect()} == {("a", "en", "v1", 2, 15), (None, None, "v1", 1, 7)}
    assert t.commit("b2", spark.createDataFrame([("a", "en", "v1", -1, 10, ""), ("a", "en", "v1", 1, 4, ""), (None, None, "v1", -1, 7, "")], shape))
    assert {tuple(r) for r in t.totals().collect()} == {("a", "en", "v1", 2, 9)}
    assert t.commit("b3", first.limit(0)) and t.committed("b3") and not t.committed("b4")
    again = token_counts.TokenCounts(spark, t.folder)
    assert {tuple(r) for r in again.totals().collect()} == {("a", "en", "v1", 2, 9)}
    with pytest.raises(ValueError):
        t.commit("a/b", first)


def library(file):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(file), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_piece_counts_equal_the_library():
    from factlake.llm.tokenizing import PieceCounts

    files, rng = list(token_counts.VERSIONS.values()), random.Random(3)
    bits = ["the", "It's", "don't", " ", "  ", "\n", "\n\n", "\t", "é", "12", "a1b", "...", "\u00a0", "\r\n", "\x1c", "x" * 50, "<|endoftext|>", "日本"]
    texts = ["", None, " a", "a ", "\n"] + ["".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 20))) for _ in range(400)]
    got = PieceCounts(tuple(token_counts.public(f) for f in files)).count(texts)
    for k, f in enumerate(files):
        fresh = library(f)
        assert [x[k] for x in got] == [len(fresh.encode_ordinary(t or "")) for t in texts]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_counts_equal_sql(spark):
    con = duckdb.connect()
    for f in ("documents.parquet", "labels.parquet"):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA / f}'")
    got = token_counts.token_counts_by_pattern(spark, str(DATA)).select("source", "lang", "version", "n_docs", "n_tokens")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(token_counts.PATTERN_SQL).fetchall())
    toxic = {r[0] for r in con.execute("SELECT doc_id FROM labels WHERE toxic = 1").fetchall()}
    poor = {r[0] for r in con.execute("SELECT doc_id FROM labels WHERE quality = 0").fetchall()} - toxic
    want: collections.Counter = collections.Counter()
    for version, file in token_counts.VERSIONS.items():
        fresh = library(file)
        for d, text, lang, source in con.execute("SELECT doc_id, text, lang, source FROM documents").fetchall():
            if d not in toxic:
                text = re.sub(token_counts.NOISE, "", text or "") if d in poor else text or ""
                want[source, lang, version, "docs"] += 1
                want[source, lang, version, "tokens"] += len(fresh.encode_ordinary(text))
    rolled = token_counts.op3_token_counts(spark, str(DATA)).collect()
    assert {(r["source"], r["lang"], r["version"], k): r[f"n_{k}"] for r in rolled for k in ("docs", "tokens")} == dict(want)
    counts = token_counts.count_tokens(spark.createDataFrame([(None, None, None, None, 1), (1, "", "en", "web", 2), (1, "two words", "en", "web", 3)], "doc_id long, text string, lang string, source string, counts int"), {"v": token_counts.public("byte_bpe_50k.tiktoken")})
    assert [r["counts"] for r in counts.collect()] == [{"v": 0}, {"v": 0}, {"v": 2}]
    assert len(os.listdir(DATA)) > 1


def brute_leaks(docs, items):
    def words(t):
        return (t or "").lower().split()

    def sh(w, k):
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    out = set()
    for d, t in docs:
        w = words(t)
        for i, text in items:
            iw = words(text)
            if not iw:
                continue
            k = min(5, len(iw))
            want = sh(iw, k)
            own = sh(w, k)
            for start in {max(0, min(p - j, len(w) - len(iw))) for p, x in enumerate(own) for j, y in enumerate(want) if x == y}:
                have = own[start : start + len(want)]
                common = sum(min(have.count(x), want.count(x)) for x in set(have))
                s = common / (len(have) + len(want) - common)
                if s >= 0.75:
                    out.add((d, i, start, round(s, 9)))
    return out


def test_leaks(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 8, 20, 36, 59])] + [(90, None), (91, "  "), (92, "re re re re re re re re")]
    docs = [(1, None), (2, ""), (3, "just words")]
    for n, (_, t) in enumerate(items):
        if t and t.strip():
            w = t.split()
            for m in range(4):
                v = list(w)
                if m == 1:
                    v[0] = "zz"
                if m == 2:
                    v.insert(len(v) // 2, "zz")
                if m == 3:
                    v = v[1:]
                docs.append((100 * n + m, " ".join([word() for _ in range(rng.randint(0, 30))] + v + [word() for _ in range(rng.randint(0, 30))]).upper()))
    docs.append((None, items[5][1]))
    d = spark.createDataFrame([(a, b, 7) for a, b in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    got = decontam.leaks(d, b)
    assert {(r["doc_id"], r["item_id"], r["start"], round(r["similarity"], 9)) for r in got.collect()} == brute_leaks(docs, items)
    clean = {r["doc_id"] for r in decontam.decontaminate(d, b).collect()}
    assert clean == ({x for x, _ in docs} - {x[0] for x in brute_leaks(docs, items)}) | {None}
    assert decontam.leaks(d.limit(0), b).count() == 0 and decontam.leaks(d, b.limit(0)).count() == 0


def all_windows(docs, items):
    """Every window of every document by brute force, whatever its start."""
    out = set()
    for d, t in docs:
        w = t.lower().split()
        for i, text in items:
            iw = text.lower().split()
            k = min(5, len(iw))
            want = [tuple(iw[x : x + k]) for x in range(len(iw) - k + 1)]
            for start in range(max(0, len(w) - len(iw)) + 1):
                v = w[start : start + len(iw)]
                have = [tuple(v[x : x + k]) for x in range(len(v) - k + 1)]
                common = sum(min(have.count(x), want.count(x)) for x in set(have))
                if common and common / (len(have) + len(want) - common) >= 0.75:
                    out.add((d, i, start))
    return out


def test_leaks_at_every_start(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([7, 36, 59, 59, 80])]
    docs = []
    for i, t in items:
        w = t.split()
        v = ["zz", *w[1:-1], "yy"]
        docs.append((10 * i, " ".join([word() for _ in range(50)] + v[: len(v) // 2] + ["p", "q", "r"] + v[len(v) // 2 :] + [word() for _ in range(40)])))
        for m in range(1, 6):
            v = list(w)
            for _ in range(m // 2 + 1):
                v.insert(rng.randint(0, len(v)), "ins") if rng.random() < 0.7 else v.pop(rng.randrange(len(v)))
            docs.append((10 * i + m, " ".join([word() for _ in range(rng.randint(0, 9))] + v + [word() for _ in range(rng.randint(0, 9))] + (w if m == 5 else []))))
    got = {(r["doc_id"], r["item_id"], r["start"]) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want, aligned = all_windows(docs, items), {x[:3] for x in brute_leaks(docs, items)}
    n = {i: len(t.split()) for i, t in items}
    assert aligned < want and {x[:2] for x in aligned} < {x[:2] for x in want} and (20, 2) in {x[:2] for x in want}
    alone = {(d, i, s) for d, i, s in want if not any((d, i) == (e, j) and abs(s - t) < n[i] for e, j, t in aligned)}
    assert got == aligned | alone


def test_leaks_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MOST_BROADCAST", 0)
    d = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "else")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "two three four five six seven")], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontam.leaks(d, b).collect()] == [(1, 7, 1, 6)]


def test_simhash_blocks(spark):
    a, b = spark.range(1).select(F.lit(0x0F0F0F0F0F0F0F0F).alias("a"), F.lit(0x0F0F0F0F0F0F0F0E).alias("b")).select(decontam.blocks(F.col("a")).alias("a"), decontam.blocks(F.col("b")).alias("b")).first()
    assert len(a) == decontam.RADIUS + 1 and sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s = spark.range(1).select(decontam.simhash(F.array(*[F.lit(x).cast("long") for x in (5, 5, 8)])).alias("f")).first()["f"]
    assert s == 5


def test_scores_are_sums_over_positions(spark, monkeypatch):
    """Every document's score, recomputed word by word with plain sums from the trained weights and the corpus's own counts."""
    made = {}
    of, all_of = lm.lexicon, lm.train_on_all
    monkeypatch.setattr(lm, "VOCABULARY", 30)
    monkeypatch.setattr(lm, "lexicon", lambda counts: made.setdefault("lex", of(counts)))
    monkeypatch.setattr(lm, "train_on_all", lambda docs, net: made.setdefault("net", all_of(docs, net)))
    rng = random.Random(6)
    texts = [" ".join(f"w{min(rng.randint(0, 60), rng.randint(0, 60))}" for _ in range(rng.randint(1, 40))) for _ in range(60)] + ["w1", ""]
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)]
    got = sorted((r["n_tokens"], round(r["log_likelihood"], 3)) for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string, row string")).collect())
    lex, net = made["lex"], made["net"]
    count = collections.Counter(w for t in texts for w in t.split())
    frequent = dict(zip(lex.words.tolist(), lex.classes.tolist()))
    code = {w: int(lm.hashes(w)[0]) for w in count}
    cls = {w: frequent.get(h, lm.OWN + (h & (lm.SHARED - 1))) for w, h in code.items()}
    own = sorted(count, key=lambda w: (-count[w], code[w]))[: lm.OWN]
    top = {w for w in own if code[w] in frequent}
    total = collections.Counter()
    for w in count:
        if w not in top:
            total[lm.OWN + (code[w] & (lm.SHARED - 1))] += count[w]
    want = []
    for t in texts:
        words, score = t.split(), 0.0
        c = [lm.CLASSES] * lm.SPAN + [cls[w] for w in words] + [lm.CLASSES] * lm.SPAN
        for i, w in enumerate(words):
            around = [c[i + k] for k in range(2 * lm.SPAN + 1) if k != lm.SPAN]
            h = np.tanh(sum(net.inputs[k][x] for k, x in enumerate(around)) + net.bias)
            out = (h @ net.weights + net.base).astype(np.float64)
            score += out[cls[w]] - np.log(np.exp(out).sum())
            if cls[w] >= lm.OWN:
                score += np.log(count[w] / (total[cls[w]] + 1))
        want.append((len(words), round(score, 3)))
    assert len(got) == len(want) and all(a[0] == b[0] and abs(a[1] - b[1]) < 0.02 for a, b in zip(got, sorted(want)))
