"""Language identification of mixed-language text.

Words are runs of letters. A word's script narrows the languages to those seen in that script; each language scores the
word's letter trigrams; a Viterbi search with a penalty for every switch then labels spans of words. The language
with most letters in its spans is the document's, and its share of the letters the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import slices, table

#: Documents a language in the training sample, about (chosen by a hash of the id); cells of the trigram table.
FIT_DOCS, CELLS = 1200, 1 << 16
#: Log-probability that a change of language costs, and what a language loses for a word in a script it isn't written in.
SWITCH, FOREIGN = 12.0, 60.0
UNKNOWN = "und"
#: First and last code points of scripts.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)
_KINDS: np.ndarray | None = None


def kinds() -> np.ndarray:
    """For each code point 0 if it is no letter, else 1 for a script that isn't listed or 2 and more for those that are."""
    global _KINDS
    if _KINDS is None:
        t = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)
        for k, (_, ranges) in enumerate(SCRIPTS):
            for a, b in ranges:
                t[a : b + 1] *= k + 2
        _KINDS = t
    return _KINDS


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram cell of each letter, first letter of each word, letters of each word, script of each word, and words of each text."""
    lows = [(t or "").lower() for t in texts]
    c = np.frombuffer("\n".join(lows).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lows])
    kind = kinds()[np.minimum(c, 0x10FFFF)] if len(c) else np.empty(0, np.uint8)
    at = np.flatnonzero(kind)
    if not len(at):
        return at, at, at, at, np.zeros(len(texts), np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    padded = np.zeros(len(c) + 2, np.uint32)
    padded[1:-1] = np.where(kind > 0, c, 0)
    cell = (padded[at] * np.uint32(0x9E3779B1) + padded[at + 1] * np.uint32(0x85EBCA77) + padded[at + 2] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
    size = np.diff(np.append(first, len(at)))
    per_text = np.diff(np.searchsorted(at[first], ends), prepend=0)
    return cell, first, size, kind[at[first]], per_text


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # log-probability of each cell by language
    foreign: np.ndarray  # loss of each script by language

    def emissions(self, cell: np.ndarray, first: np.ndarray, script: np.ndarray) -> np.ndarray:
        out = np.empty((len(first), len(self.langs)), np.float32)
        for lo in range(0, len(first), 100_000):
            own = first[lo : lo + 100_000]
            a, b = own[0], first[lo + 100_000] if lo + 100_000 < len(first) else len(cell)
            out[lo : lo + len(own)] = np.add.reduceat(self.scores[cell[a:b]], own - a, axis=0)
        return out - self.foreign[script]


def viterbi(emissions: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word of many texts at once, the texts' words being one after the other.

    Ties go to staying, then to the first language.
    """
    best = np.empty(len(emissions), np.int32)
    if not len(emissions):
        return best
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    start, n = starts[order], counts[order]
    alive = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")
    value = np.zeros((len(n), emissions.shape[1]), np.float32)
    moved, origin = np.zeros(emissions.shape, bool), np.zeros(len(emissions), np.int32)
    for step, k in enumerate(alive):
        at = start[:k] + step
        v = value[:k]
        top = v.max(axis=1)
        if step:
            origin[at] = v.argmax(axis=1)
            jump = (top - switch)[:, None]
            moved[at] = jump > v
            v = np.maximum(v, jump)
        v = v + emissions[at]
        value[:k] = v - v.max(axis=1)[:, None]
    state = value.argmax(axis=1).astype(np.int32)
    for step in range(len(alive) - 1, -1, -1):
        k = alive[step]
        at, s = start[:k] + step, state[:k]
        best[at] = s
        state[:k] = np.where(moved[at, s], origin[at], s)
    return best


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[list[tuple[int, int, str]]]]:
    """Language, score and spans (first word, words, language) of each whole text; ``und`` and 0 for null or no letter."""
    cell, first, size, script, counts = words(texts)
    n = len(model.langs)
    if not n or not len(first):
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    state = viterbi(model.emissions(cell, first, script), counts)
    doc = np.repeat(np.arange(len(texts)), counts)
    mass = np.bincount(doc * n + state, weights=size, minlength=len(texts) * n).reshape(-1, n)
    total, top = mass.sum(axis=1), mass.argmax(axis=1)
    runs = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(state, prepend=-1) != 0))
    begin = (np.cumsum(counts) - counts)[doc[runs]]
    spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for d, a, length, s in zip(doc[runs].tolist(), (runs - begin).tolist(), np.diff(np.append(runs, len(doc))).tolist(), state[runs].tolist(), strict=True):
        spans[d].append((a, length, model.langs[s]))
    langs = [model.langs[t] if z else UNKNOWN for t, z in zip(top.tolist(), total.tolist(), strict=True)]
    return langs, (mass.max(axis=1) / np.maximum(total, 1)).tolist(), spans


def train(docs: DataFrame, fit_docs: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the texts and languages of ``docs``: about ``fit_docs`` documents a language, by a hash of the id.

    Rows without language or text are left out; no rows give a model that answers ``und``.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) * F.col("n") < F.lit(fit_docs << 20)
    sample = own.join(F.broadcast(sizes), "lang").where(share).select("lang", "text")  # a row a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[np.ndarray]] = {}
        for b in slices(batches):
            langs = b.column("lang").to_pylist()
            for lang in set(langs):
                cell, first, size, script, _ = words([t for t, x in zip(b.column("text").to_pylist(), langs, strict=True) if x == lang])
                have = total.setdefault(lang, [np.zeros(CELLS), np.zeros(len(SCRIPTS) + 2)])
                have[0] += np.bincount(cell, minlength=CELLS)
                have[1] += np.bincount(script, weights=size, minlength=len(SCRIPTS) + 2)
        for lang, (cells, scripts) in total.items():
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(at) + len(scripts)), "cell": np.concatenate([at, -1 - np.arange(len(scripts))]), "n": np.concatenate([cells[at], scripts])})

    # CELLS rows a language at most
    got = sample.mapInArrow(run, "lang string, cell long, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    where = np.searchsorted(langs, got.column("lang").to_pylist()) if langs else np.empty(0, int)
    cell, n = got.column("cell").to_numpy(), got.column("n").to_numpy()
    counts, scripts = np.zeros((CELLS, len(langs))), np.zeros((len(SCRIPTS) + 2, len(langs)))
    m = cell >= 0
    counts[cell[m], where[m]] = n[m]
    scripts[-1 - cell[~m], where[~m]] = n[~m]
    scores = np.log((counts + 0.2) / (counts.sum(axis=0) + 0.2 * CELLS)) if langs else counts
    written = scripts > 0.01 * scripts.sum(axis=0)
    written[~written.any(axis=1)] = True
    return Model(langs, scores.astype(np.float32), np.where(written, 0, FOREIGN).astype(np.float32))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document, and ``spans`` if asked for; only the text decides. Other columns are ignored; repeated rows stay; an empty table gives none."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # CELLS numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=6 << 20):
            langs, score, spans = predict(sent.value, b.column("text").to_pylist())
            cols = [b.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())]
            if with_spans:
                cols.append(pa.array([[{"first": a, "words": n, "lang": x} for a, n, x in s] for s in spans], pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "spans"][: len(cols)])

    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<first: long, words: long, lang: string>>" * with_spans
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
