"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from ``SPAN`` words on both sides while it is itself hidden: log P(word | left, right) = log P(class | left,
right) by the network + log P(word | class) by corpus counts. The most frequent words are classes of their own, the others
share classes by a hash. The counts of all words of all documents are gathered by one aggregation. A bounded number of
frequent ones is sent to the workers; every other word meets its own count in a join. The network, a few thousand
weights, starts from a bounded sample; then each partition trains it on all words of its documents, and the results are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import slices, stage, table, word_hashes

SPAN, HIDDEN, OWN, SHARED = 2, 32, 96, 32
CLASSES = OWN + SHARED
#: Words whose counts are sent to the workers at most (other words' counts are joined).
VOCABULARY = 1 << 17
#: Of the start of the training: documents (by a hash of the id) and words of them at most, and steps. Words of a step.
FIT_DOCS, FIT_WORDS, STEPS, BATCH = 2000, 1_500_000, 400, 4096
#: Words that a worker shuffles together in the pass over all documents; learning rate there at first; partial averages that the driver gets.
POOL, RATE, SLOTS = 1 << 18, 0.01, 16


def hashes(text: str | None) -> np.ndarray:
    """Signed 64-bit hashes of the words of a text, A-Z in lower case."""
    return word_hashes(text.encode("utf-8", "surrogatepass").lower().split()).view(np.int64) if text else np.empty(0, np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (hash), ``n`` over the whole texts of all documents; workers add up what they see before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            w, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w), pa.array(n)], ["word", "n"])

        held, total = [], 0
        for b in slices(batches):
            for t in b.column("text").to_pylist():
                held.append(hashes(t))
                total += len(held[-1])
            if total >= 2_000_000:
                yield out(held)
                held, total = [], 0
        if held:
            yield out(held)

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Frequent words by hash, with their class and log P(word | class); for other words, by shared class, what log P(word | class) is less the logarithm of their count."""

    words: np.ndarray
    classes: np.ndarray
    log_in_class: np.ndarray
    log_other: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each word, log P(word | class) without the count of words that aren't frequent, and whether it is frequent."""
        shared = OWN + (h & (SHARED - 1))
        if not len(self.words):
            return shared, self.log_other[shared - OWN], np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[at] == h
        return np.where(known, self.classes[at], shared), np.where(known, self.log_in_class[at], self.log_other[shared - OWN]), known

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word and log P(word | class), to which the logarithm of its count is to be added if it isn't frequent."""
        return self.find(h)[:2]


def lexicon(counts: DataFrame) -> Lexicon:
    """From word counts: at most ``VOCABULARY`` rows, a row for each step of the counts and two numbers a shared class come to the driver."""
    step = F.floor(F.log2("n") * 16)
    least, words = 1 << 30, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        words += r["count"]
        if words > VOCABULARY:
            break
        least = r["step"]
    top = counts.where(step >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    word, n = top["word"].to_numpy(np.int64), top["n"].to_numpy(np.float64)
    cls = np.where(np.arange(len(word)) < OWN, np.arange(len(word)), OWN + (word & (SHARED - 1)))
    of = counts.groupBy(F.col("word").bitwiseAND(SHARED - 1).alias("c")).agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(SHARED)
    total[of["c"].to_numpy(int)] = of["n"]
    total -= np.bincount(word[:OWN] & (SHARED - 1), weights=n[:OWN], minlength=SHARED)
    shared = cls >= OWN
    inside = np.zeros(len(word))
    inside[shared] = np.log(n[shared] / (total[cls[shared] - OWN] + 1))
    order = np.argsort(word)
    return Lexicon(word[order], cls[order], inside[order], -np.log(total + 1))


@dataclass
class Network:
    """tanh of the sum of one vector for each side position's class, then a softmax over the classes."""

    inputs: np.ndarray  # positions x (classes + edge) x hidden
    bias: np.ndarray
    weights: np.ndarray
    base: np.ndarray

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.inputs[0][context[:, 0]]
        for k in range(1, context.shape[1]):
            h = h + self.inputs[k][context[:, k]]
        return np.tanh(h + self.bias)

    def shifted(self, out: np.ndarray) -> np.ndarray:
        """Sums of the output layer, less their greatest where ``exp`` could overflow."""
        if not np.abs(self.weights).sum(axis=0).max() + np.abs(self.base).max() < 80:
            out -= out.max(axis=1, keepdims=True)
        return out

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        out = self.shifted(self.hidden(context) @ self.weights + self.base)
        at = out[np.arange(len(target)), target]
        return at - np.log(np.exp(out, out=out).sum(axis=1))


def contexts(classes: np.ndarray) -> np.ndarray:
    """For each word the classes of ``SPAN`` words before and after it; ``CLASSES`` beyond the ends."""
    n = len(classes)
    padded = np.full(n + 2 * SPAN, CLASSES, np.int64)
    padded[SPAN : SPAN + n] = classes
    return np.stack([padded[k : k + n] for k in range(2 * SPAN + 1) if k != SPAN], 1)


class Adam:
    """Steps of the network's weights."""

    def __init__(self, net: Network):
        self.net, self.params, self.step = net, [net.inputs, net.bias, net.weights, net.base], 0
        self.first, self.second = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]

    def move(self, c: np.ndarray, y: np.ndarray, rate: float) -> None:
        """One step on the contexts ``c`` of the classes ``y``."""
        net, size = self.net, len(y)
        self.step += 1
        h = net.hidden(c)
        out = h @ net.weights
        out += net.base
        out = net.shifted(out)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        out[np.arange(size), y] -= 1
        out /= size
        dh = (out @ net.weights.T) * (1 - h * h)
        grads = [np.zeros_like(net.inputs), dh.sum(axis=0), h.T @ out, out.sum(axis=0)]
        for k in range(2 * SPAN):
            order = np.argsort(c[:, k].astype(np.uint8), kind="stable")
            own = c[order, k]
            start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            grads[0][k][own[start]] = np.add.reduceat(dh[order], start, axis=0)
        for p, g, m, v in zip(self.params, grads, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-7)).astype(np.float32)


def train(documents: list[np.ndarray], seed: int = 7, steps: int = STEPS) -> Network:
    """Train on the class sequences of sampled documents by Adam; none give a uniform network."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.1, (2 * SPAN, CLASSES + 1, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32), np.zeros(CLASSES, np.float32))
    documents = [d for d in documents if len(d)]
    if not documents:
        net.weights[:] = 0
        return net
    context, target = np.concatenate([contexts(d) for d in documents]), np.concatenate(documents)
    adam = Adam(net)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(target), BATCH)
        adam.move(context[pick], target[pick], 0.02 * min(1, 2 * (1 - step / (steps + 1))))
    return net


def encoded(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """From ``row, doc_id, text``: ``n_tokens``, ``cls`` (a byte a word), ``inside`` (sum of log P(word | class) but for the counts of other words) and ``others`` (hashes of the words that aren't frequent)."""
    sent = docs.sparkSession.sparkContext.broadcast(lex)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexi = sent.value
        for b in slices(batches, most=1 << 20):
            own = [hashes(t) for t in b.column("text").to_pylist()]
            size = np.array([len(h) for h in own], np.int64)
            h = np.concatenate(own) if own else np.empty(0, np.int64)
            cls, inside, known = lexi.find(h)
            ends, raw = np.cumsum(size), cls.astype(np.uint8).tobytes()
            total = [inside[e - k : e].sum() for e, k in zip(ends, size, strict=True)]
            offsets = np.append(0, np.append(0, np.cumsum(~known))[ends]).astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[~known]))
            rows = pa.array([raw[e - k : e] for e, k in zip(ends.tolist(), size.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(size), rows, pa.array(total, pa.float64()), others], ["row", "doc_id", "n_tokens", "cls", "inside", "others"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_tokens long, cls binary, inside double, others array<long>")


def classes_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8).astype(np.int64) for x in column.to_pylist()]


def train_on_all(docs: DataFrame, net: Network) -> Network:
    """Train ``net`` further on every word of every document (``cls``): each partition by itself; their weights are averaged by their words."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = sent.value
        own = Network(start.inputs.copy(), start.bias.copy(), start.weights.copy(), start.base.copy())
        part = TaskContext.get().partitionId()
        adam, rng, seen = Adam(own), np.random.default_rng(part), 0

        def learn(parts: list[np.ndarray]) -> int:
            cls = np.concatenate(parts)
            context = np.concatenate([contexts(c) for c in parts])
            for pick in np.array_split(rng.permutation(len(cls)), -(-len(cls) // BATCH)):
                adam.move(context[pick], cls[pick], RATE / (1 + adam.step / 100) ** 0.5)
            return len(cls)

        held, total = [], 0
        for b in slices(batches, "cls", 1 << 18):
            new = [c for c in classes_of(b.column("cls")) if len(c)]
            held += new
            total += sum(map(len, new))
            if total >= POOL:
                seen += learn(held)
                held, total = [], 0
        if held:
            seen += learn(held)
        if seen:
            weights = np.concatenate([p.ravel() for p in adam.params]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([part % SLOTS]), pa.array([part]), pa.array([seen]), pa.array([(weights * seen).tobytes()], pa.binary())], ["slot", "part", "n", "x"])

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        x = np.sum([np.frombuffer(v, np.float64) for v in rows.column("x").to_pylist()], axis=0)
        return pa.table({"slot": rows.column("slot")[:1], "n": pa.array([sum(rows.column("n").to_pylist())]), "x": pa.array([x.tobytes()], pa.binary())})

    got = sorted(docs.select("cls").mapInArrow(run, "slot long, part long, n long, x binary").groupBy("slot").applyInArrow(add, "slot long, n long, x binary").collect())
    if not got:
        return net
    x = (np.sum([np.frombuffer(r["x"], np.float64) for r in got], axis=0) / sum(r["n"] for r in got)).astype(np.float32)
    shapes = [p.shape for p in (net.inputs, net.bias, net.weights, net.base)]
    return Network(*[v.reshape(s) for v, s in zip(np.split(x, np.cumsum([int(np.prod(s)) for s in shapes])[:-1]), shapes, strict=True)])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean_log_likelihood`` of every document, from its whole text.

    Texts without words (null, empty) have the sum 0 and a null mean; equal texts have equal scores; repeated rows stay;
    an empty table gives none; other columns are ignored. ``fit_docs`` documents start the training, all go on with it.
    """
    spark = docs.sparkSession
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = stage(count_words(own))
    known = stage(encoded(own, lexicon(counts)))  # with a number a row, from one reading
    n = known.count()
    share = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) * F.lit(n) < F.lit(fit_docs << 30)
    got = known.where(share).select("cls").limit(2 * fit_docs + 100).toArrow()  # rows have numbers of their own: about fit_docs
    found = sorted(got.column("cls").to_pylist())
    order = np.random.default_rng(1).permutation(len(found))
    sample, used = [], 0
    for i in order:
        if used < FIT_WORDS:
            sample.append(np.frombuffer(found[i], np.uint8)[: FIT_WORDS - used].astype(np.int64))
            used += len(sample[-1])
    sent = spark.sparkContext.broadcast(train_on_all(known, train(sample)))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in slices(batches, "cls", 1 << 18):
            own = classes_of(b.column("cls"))
            cls = np.concatenate(own) if own else np.empty(0, np.int64)
            context = np.concatenate([contexts(c) for c in own]) if own else np.empty((0, 2 * SPAN), np.int64)
            logs = np.empty(len(cls))
            for lo in range(0, len(cls), 2048):
                logs[lo : lo + 2048] = net.log_probability(context[lo : lo + 2048], cls[lo : lo + 2048])
            ends = np.cumsum([len(c) for c in own])
            total = np.array([logs[e - len(c) : e].sum() for e, c in zip(ends, own, strict=True)], np.float64) + b.column("inside").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("n_tokens"), pa.array(total)], ["row", "doc_id", "n_tokens", "x"])

    scored = known.select("row", "doc_id", "n_tokens", "cls", "inside").mapInArrow(run, "row long, doc_id long, n_tokens long, x double")
    # whole numbers, so that the sum doesn't depend on the order; a count of 1 adds nothing
    more = known.select("row", F.explode("others").alias("word")).join(counts.where("n > 1"), "word").groupBy("row").agg(F.sum(F.round(F.log("n") * (1 << 32)).cast("long")).alias("more"))
    total = F.col("x") + F.coalesce("more", F.lit(0)) / F.lit(float(1 << 32))
    out = scored.join(more, "row", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
