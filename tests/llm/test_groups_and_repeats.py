"""Similar groups and repeated passages against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.llm import jaccard, keyed, substrings


def sets_of(rows):
    out = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def components(rows):
    sets, parent = sets_of(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return collections.Counter((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows)))


def mutated(rng, words, share):
    return [rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4)))
    rows, n = [], 100
    common = [word() for _ in range(60)]
    for size in (1, 3, 5, 6, 7, 8, 9, 12, 40, 90, 200):
        base = [word() for _ in range(size)]
        for share in (0, 0, 0.004, 0.01, 0.02, 0.03, 0.05, 0.1):
            rows.append((n := n - 1 if rng.random() < 0.5 else n + 50, " ".join(mutated(rng, base, share))))
            if rng.random() < 0.4:
                rows.append((n + 1000, " ".join(common + base)))
    base = [word() for _ in range(120)]
    rows += [(5000 + i, " ".join(mutated(rng, base, 0.015))) for i in range(60)]
    rows += [(6000 + i, " ".join(base[i : i + 100])) for i in range(20)]
    rows += [(7000, None), (7001, ""), (7002, " \n\t"), (7003, "A a  A\na a a a"), (7004, "a a a a a"), (7005, "Hot"), (7006, "hot"), (None, "no id at all"), (7007, "no id at all"), (7008, "x"), (7008, "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("local, frequent, most", [(2, 3, 0), (8, 64, 4), (1000, 2, 4)])
def test_similar_groups(spark, monkeypatch, local, frequent, most):
    monkeypatch.setattr(jaccard, "LOCAL", local)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "MOST", most)
    rows = corpus(local)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, row string")
    got = jaccard.similar_groups(docs).collect()
    assert collections.Counter(map(tuple, got)) == components(rows)


def test_first_document_meets_those_of_other_workers(spark, monkeypatch):
    """Near copies that are similar enough to the original alone, gathered by several workers: each has its link with the original."""
    monkeypatch.setattr(jaccard, "GATHER", 500)
    rng, rows = random.Random(7), []
    for group in range(2):
        base = [f"{group}w{i}" for i in range(200)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(40):
            at = {6 * place + rng.randrange(2) for place in rng.sample(range(33), 5)}
            rows.append((len(rows), " ".join(f"n{rng.randrange(10**9)}" if i in at else w for i, w in enumerate(base))))
    rng.shuffle(rows)
    got = collections.Counter(map(tuple, jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()))
    assert got == components(rows) and {r[2] for r in got} == {0, 41}


def test_similar_groups_empty(spark):
    assert jaccard.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spark.createDataFrame([(1, None), (2, "lone words here")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar_groups(one).collect())) == [(1, 0, 1), (2, 1, 2)]


def test_repeated_and_dealt_input(spark):
    """Rows that do not come in the same order each time they are read are staged first."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 2 for _ in range(30))) for i in range(40)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).orderBy(F.rand())
    got = jaccard.similar_groups(docs).collect()
    assert collections.Counter(map(tuple, got)) == components(rows)


def test_signatures_meet(monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 50)
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(2, 80))
        x = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        count = rng.integers(2, int(rng.integers(3, 200)), 1 << 8)
        keep = x[rng.random(len(x)) > rng.random() * 0.3]
        y = np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, int(rng.integers(0, 1 + n // 4)), dtype=np.uint64)]))
        common = len(np.intersect1d(x, y))
        if 100 * common < 75 * (len(x) + len(y) - common) or np.array_equal(x, y):
            continue
        # shingles of one set only occur once; the others are rare or frequent
        shared = np.intersect1d(x, y)
        sig = [jaccard.signatures(len(s), shared, count[(shared % 256).astype(int)]) for s in (x, y)]
        assert set(sig[0][0].tolist()) & set(sig[1][0].tolist())


def of_one_signature(n, m):
    x = np.concatenate([jaccard.records(np.array([7], np.uint64), i, i, n, m, 0) for i in range(600)])
    x["dense"], x["place"] = 60, 20
    return x


def test_one_signature_of_many_documents():
    """Documents that share a signature and nothing else that would rule a pair out: every pair is made once, no round makes more than its share."""
    x, at, seen = of_one_signature(100, 100), 0, []
    while at >= 0:
        pairs, _, at = jaccard._meet(x, at, None, 2000)
        assert len(pairs) <= 2600
        seen += map(tuple, pairs.tolist())
    assert len(seen) == len(set(seen)) == 600 * 599 // 2
    x["label"] = 3
    assert not len(jaccard._meet(x, 0)[0])
    assert not len(jaccard._meet(of_one_signature(100, 80), 0)[0])  # each has a fifth of its own


def test_rounds_make_every_pair(spark, monkeypatch):
    """Of documents that nothing rules out, every two that share a signature are made a pair until no reducer has more to do, however workers gather them."""
    monkeypatch.setattr(jaccard, "GATHER", 30)
    share = [[1 << 60, i % 3 + 1 << 61] for i in range(40)]
    rows = [(i, 100, 100, bytearray(np.array(s, np.uint64).tobytes()), 2, i) for i, s in enumerate(share)]
    docs = spark.createDataFrame(rows, "row long, n long, m long, sig binary, rare long, label long").repartition(3)
    (pairs, begun), seen = jaccard._pairs(docs, 3), set()
    seen.update(map(tuple, pairs.collect()))
    while begun:
        pairs, begun = jaccard._pairs(docs, 3, begun)
        seen.update(map(tuple, pairs.collect()))
    assert seen == {(a, b) for b in range(40) for a in range(b)}


def test_bounds_hold():
    """No bound rules out a pair that is similar enough, at the first signature that both have."""
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(4, 120))
        both = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        sets = [np.unique(np.concatenate([both[rng.random(len(both)) > rng.random() * 0.2], rng.integers(0, 1 << 62, int(rng.integers(0, 1 + n // 6)), dtype=np.uint64)])) for _ in range(2)]
        common = len(np.intersect1d(*sets))
        if 100 * common < 75 * (len(sets[0]) + len(sets[1]) - common) or np.array_equal(*sets):
            continue
        count = lambda k: np.where(k % 3 > 0, 100, 2 + (k % 7).astype(np.int64))
        made = []
        for i, s in enumerate(sets):
            sig, rare = jaccard.signatures(len(s), s, count(s))
            made.append(jaccard.records(sig, i, i, len(s), len(s), rare))
        assert len(jaccard._meet(np.concatenate(made), 0)[0]) == 1


def repeats(rows, window):
    count, out = collections.Counter(), []
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for _, w in split:
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    for d, w in split:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("window, group", [(3, 4_096), (8, 4_096), (8, 5), (35, 4_096), (35, 0), (35, 16)])
def test_remove_repeats(spark, window, group):
    rng = random.Random(window)
    passage = [[rng.choice("abcdef") + rng.choice("xyz") for _ in range(rng.randint(window - 2, window * 3))] for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [[f"{rng.random():.6f}" for _ in range(rng.randint(0, 40))] for _ in range(3)]
        parts.insert(rng.randint(0, 3), passage[i % 4][rng.randint(0, 2) :])
        rows.append((i if i != 5 else None, rng.choice([" ", "\n", "  "]).join(w for p in parts for w in p)))
    rows += [(100, None), (101, ""), (102, "a " * 200), (103, "b b"), (3, rows[3][1]), (104, "é " + " ".join(passage[0]) + " ü")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, bucket int")
    got = substrings.remove_repeats(docs, window=window, with_text=True, group=group).collect()
    assert collections.Counter(tuple(r)[:4] for r in got) == repeats(rows, window)
    for r in got:
        assert sum(x["words"] for x in r["repeats"]) == r["n_removed"]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_subtrees(spark):
    """Groups of many prefixes, cut by memory: words decide, not their fingerprints, and every window is one leaf."""
    rng = random.Random(4)
    docs = [[rng.choice("ab") for _ in range(rng.randint(0, 60))] for _ in range(40)]
    around, texts, want = [], [], set()
    count = collections.Counter(tuple(w[i : i + 5]) for w in docs for i in range(len(w) - 4))
    for row, w in enumerate(docs):
        for i in range(len(w) - 4):
            around.append((ord(w[i]), row, i, 5, 1))  # the key is the first word
            texts.append(" ".join(w[i : i + 5]).encode())
            if count[tuple(w[i : i + 5])] > 1:
                want.add((row, i))
    for most in (1, 50, 10_000):
        got = [tuple(x) for part in substrings.subtrees(np.array(around, substrings.AROUND), texts, 5, most) for x in part.tolist()]
        assert len(got) == len(set(got)) and set(got) == want
    block = substrings._pack_around(np.array(around[:3], substrings.AROUND), texts[:3])
    assert substrings._unpack_around(block)[0].tolist() == around[:3] and substrings._unpack_around(block)[1] == texts[:3]


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    e = np.empty(500, keyed.ENTRY)
    e["key"], e["row"], e["at"] = rng.integers(0, 1 << 63, 500), rng.integers(-1, 1 << 50, 500), rng.integers(0, 1 << 32, 500)
    got = keyed.unpack([keyed.pack(e[:200]), keyed.pack(e[200:])], keyed.ENTRY)
    assert (got == e).all() and len(keyed.unpack([], keyed.ENTRY)) == 0
