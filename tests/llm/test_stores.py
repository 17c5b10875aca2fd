"""Token files and Ogg columns: exact round trips, and damage that is noticed."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factlake.llm import ogg, pfor
from factlake.llm.tokenizing import Encoder, public


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(1000, 1040), max_size=3000))
def test_blocks(ids):
    x = np.array(ids, np.uint32)
    assert (pfor.decode_blocks(pfor.encode_blocks(x)) == x).all()


def test_shard(tmp_path):
    rng = np.random.default_rng(2)
    docs = [(i, np.minimum(rng.zipf(1.3, n), 49407).astype("<u4").tobytes()) for i, n in enumerate([0, 1, 5, 300_000, 1024, 7, 0])]
    w = pfor.Writer(f"file://{tmp_path}/a.pfr")
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    r = pfor.Reader(f"file://{tmp_path}/a.pfr")
    assert list(r.documents()) == docs and r.total == sum(len(x) for _, x in docs) // 4
    whole = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    assert (r.ids(150_000, 4000) == whole[150_000:154_000]).all() and len(r.ids(3, 0)) == 0
    (tmp_path / "b.pfr").write_bytes((tmp_path / "a.pfr").read_bytes()[:-3])
    with pytest.raises(ValueError, match="not a whole"):
        pfor.Reader(f"file://{tmp_path}/b.pfr")


def test_token_files(spark):
    rows = [(5, "five words in this one"), (1, None), (3, ""), (2, "x " * 4000), (3, "again three"), (None, "no id")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, start int")
    got = pfor.read_tokens(pfor.write_tokens(docs), with_ids=True).collect()
    enc, at = Encoder(public("word_bpe_49k.json")), 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["n_tokens"] and r["ids"][-4:] == b"\1\0\0\0"
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, 1, 2, 3, 3, 5]
    assert sorted(r["ids"][:-4] for r in got) == sorted(enc.encode([t for _, t in rows]))
    assert pfor.read_tokens(pfor.write_tokens(docs.limit(0))).count() == 0


def naive_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=300))
def test_crc(data):
    assert ogg.page_crc(data) == naive_crc(data)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5000), st.sampled_from([1, 100, 255, 510, 1500, 4000]), st.integers(1, 3), st.randoms())
def test_mux_round_trip(size, packet, streams, rng):
    payload = rng.randbytes(size)
    media = ogg.mux(payload, packet, streams)
    got, marks = ogg.decode(media)
    assert got == payload and sum(n for _, _, n in marks) == size
    for s in range(streams):
        ends = [t for k, t, _ in marks if k == s]
        assert ends == sorted(ends) and (not ends or abs(ends[-1] - sum(n for k, _, n in marks if k == s) / ogg.RATE) < 1e-9)


def test_packets_across_pages():
    packets = [b"i", bytes(255), b"", bytes(1000), bytes(range(200))]
    ends = [0, 255, 255, 1255, 1455]
    for segments in (1, 2, 3, 255):
        media = b"".join(p for _, p in ogg._pages(7, packets, ends, segments))
        assert [p for p, _ in ogg.demux(media)[7]] == packets


def test_damage_is_noticed():
    media = ogg.mux(bytes(range(256)) * 40)
    for at in (30, 60, 3000, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            ogg.decode(bytes(bad))
    with pytest.raises(ValueError):
        ogg.decode(media[:-40])


def test_media_columns(spark):
    rows = [(1, "hello"), (2, None), (3, ""), (4, "x" * 64), (5, "long " * 30_000), (1, "hello")]
    docs = spark.createDataFrame([(d, t, "m") for d, t in rows], "doc_id long, text string, media string")
    got = ogg.read_media(ogg.to_media(docs), with_payload=True).collect()
    for (d, t), r in zip(rows, got, strict=True):
        n, p = ogg.pad(t)
        assert (r["doc_id"], r["n_bytes"], r["payload"], r["payload_sha256"], r["tail_crc32"]) == (d, n, p, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[0][1:] == got[5][1:] and len(got[2]["payload"]) == 64
    assert ogg.read_media(ogg.to_media(docs.limit(0))).count() == 0
