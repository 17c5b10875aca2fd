import random
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factlake.llm import packing
from factlake.llm.tokenizing import Encoder, public


def naive_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            r, i = min(fits)
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    histogram = {n: lengths.count(n) for n in lengths}
    plan, bins = packing.best_fit_plan(histogram, 40)
    assert bins == naive_best_fit(lengths, 40)
    place = {}
    for n in histogram:
        rows = [p for p in plan if p[0] == n]
        for rank in range(histogram[n]):
            _, lo, each, start, off = [p for p in rows if p[1] <= rank][-1]
            place.setdefault(start + (rank - lo) // each, []).append((off + (rank - lo) % each * n, n))
    for got in place.values():
        end = 0
        for off, n in sorted(got):
            assert off == end
            end += n
        assert end <= 40


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    enc, rng = Encoder(public(name)), random.Random(3)
    bits = ["the", "It's", "don't", " ", "  ", "\n", "\n\n", "\t", "é", "ÉTÉ", "12", "a1b", "'s", "...", " ", "\r\n", "\x1c", "x" * 50, "é", "<|endoftext|>", "日本"]
    texts = ["", None, " a", "a ", "\n"] + ["".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 20))) for _ in range(400)]
    assert enc.encode(texts) == enc._raw([t or "" for t in texts])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_equal_a_fresh_library(name):
    """Texts that hold the files' own special tokens, against a tokenizer that nothing has been set on."""
    enc, fresh, rng = Encoder(public(name)), Tokenizer.from_file(public(name)), random.Random(5)
    bits = ["hi", "there", "It's", " ", "\n", "  ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", "é", "12"]
    texts = ["hi <|endoftext|> there", "<|endoftext|>", "a<|startoftext|>b", "<|endoftext|>\n\n<|endoftext|>"] + ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(1, 15))) for _ in range(300)]
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == want
    assert len(want[0]) < 5


def test_pack_documents(spark):
    rows = [(1, "one two three", "x"), (2, None, "y"), (3, "", "z"), (4, "word " * 3000, None), (4, "word " * 3000, None), (None, "no id", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack_documents(docs, with_ids=True)
    out = got.collect()
    assert sorted(r["length"] for r in out if r["doc_id"] in (2, 3)) == [1, 1]
    assert all(r["length"] == 1024 for r in out if r["piece"] > 0)
    assert len([r for r in out if r["doc_id"] == 4]) == 2 * -(-3001 // 1024)
    seqs = packing.sequences(got).collect()
    assert all(r["n_ids"] <= 1024 and len(r["ids"]) == 4 * r["n_ids"] for r in seqs)
    assert sum(r["n_ids"] for r in seqs) == sum(r["length"] for r in out)
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_merged_here_equal_the_library(name):
    rng = random.Random(8)
    letters = [chr(c) for c in range(0x260) if chr(c).isalpha()]
    words = [*letters, *(a + b for a in letters for b in "aIİ"), "a" * 64, "a" * 65, "aaa", "aaaaa", "abab" * 9, "µªº", "ΣσΣ", "éa", "́", "x'llama", "'sa", "a'", "dǅ"]
    words += ["".join(rng.choices("etaoinshrdluETAN" if rng.random() < 0.7 else letters, k=rng.randint(1, 20))) for _ in range(20_000)]
    words += [w + "".join(rng.choices(string.punctuation, k=rng.randint(1, 3))) for w in words[::3]]
    texts = [" ".join(words[i : i + 50]).replace("t", "t\n", 1) for i in range(0, len(words), 50)] + words[:2000] + ["\n" + w for w in words[:200]]
    lib = Tokenizer.from_file(public(name))
    assert Encoder(public(name)).encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_words_are_not_encoded_by_the_library(name):
    enc, sent = Encoder(public(name)), []
    raw, pieces = enc._raw, enc._pieces
    enc._raw = lambda texts: sent.extend(texts) or raw(texts)
    enc._pieces = lambda words, lead: sent.extend(words) or pieces(words, lead)
    enc.encode(["The cat, Éan sat.\nOn one mat!", "don't 12"])
    assert sorted(sent) == ["!", ",", ".", "12", "don't"]
    enc.encode(["Mat, sat! The."])
    assert len(sent) == 5
