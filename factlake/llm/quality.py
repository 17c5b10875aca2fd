"""Ordinal cumulative-link regression on graded ratings over hashed text features.

P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector for all grades and ordered thresholds. Features are
binary: hashed words (letters only, lower case) and, in steps of a power of two, the rates of signs, capitals,
digits and repeated words and the number of words. The fit takes a bounded sample of rated documents to the driver;
every document is scored in parallel from its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import mix, slices, table, word_hashes

#: Rated documents that the fit takes at most, chosen by a hash of the id; buckets of the hash; features kept.
FIT_ROWS, BUCKETS, KEEP = 16_000, 1 << 20, 2048
GRADES = 3
_SIGNS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_TO_BLANK = bytes(32 if i < 48 or 58 <= i < 65 or 91 <= i < 97 or 123 <= i < 128 else i for i in range(256))


def _step(x: float) -> int:
    return int(np.ceil(np.log2(x * 256 + 1)))


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text (null: empty)."""
    raw = (text or "").encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    words = raw.lower().translate(_TO_BLANK).split()
    hashed = np.unique(word_hashes(words))
    n = max(1, len(words))
    shape = [(1, 0, min(20, len(words).bit_length())), (2, 0, _step(counts[65:91].sum() / n)), (3, 0, _step(counts[48:58].sum() / n)), (4, 0, _step(1 - len(hashed) / n))]
    shape += [(5, c, _step(counts[c] / n)) for c in _SIGNS if counts[c]]
    coded = np.array([a << 40 | b << 20 | c for a, b, c in shape], np.uint64)
    return np.unique((np.concatenate([hashed, mix(coded)]) % np.uint64(BUCKETS)).astype(np.int32))


@dataclass
class CumulativeLink:
    """``index``: place of each bucket among the weights, or -1; ``theta``: ascending thresholds."""

    index: np.ndarray
    weights: np.ndarray
    theta: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, given the linear score."""
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - x[:, None], -30, 30)))

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(rows))
        for i, r in enumerate(rows):
            at = self.index[r]
            out[i] = self.weights[at[at >= 0]].sum()
        return out


def fit(rows: list[np.ndarray], grades: np.ndarray, keep: int = KEEP, penalty: float = 0.3, steps: int = 150) -> CumulativeLink:
    """Fit by accelerated gradient descent on the penalised likelihood.

    The ``keep`` features whose frequency differs most between the grades are used. Without rows, or with one grade only,
    all weights are 0 and the thresholds follow the (smoothed) shares of the grades.
    """
    n, y = len(rows), np.asarray(grades, np.int64)
    share = (np.bincount(y, minlength=GRADES) + 1) / (n + GRADES)
    cut = np.cumsum(share)[:-1]
    index = np.full(BUCKETS, -1, np.int32)
    none = CumulativeLink(index, np.zeros(1), np.log(cut / (1 - cut)))
    if len(np.unique(y)) < 2:
        return none
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.concatenate(rows)
    seen = np.bincount(col, minlength=BUCKETS)
    z = np.zeros(BUCKETS)
    for g in range(GRADES):
        m = int((y == g).sum())
        if 0 < m < n:
            own = np.bincount(col[y[row] == g], minlength=BUCKETS)
            p = (seen + 1) / (n + 2)
            z = np.maximum(z, np.abs(own / m - (seen - own) / (n - m)) / np.sqrt(p * (1 - p) * (1 / m + 1 / (n - m))) * (seen >= 4))
    top = np.flatnonzero(z > 4)
    top = top[np.argsort(-z[top], kind="stable")][:keep]
    if not len(top):
        return none
    index[top] = np.arange(len(top))
    here = index[col] >= 0
    row, col = row[here], index[col[here]]
    w, theta = np.zeros(len(top)), np.linspace(-1, 1, GRADES - 1)
    vw, vt, mw, mt = np.zeros_like(w), np.zeros_like(theta), np.zeros_like(w), np.zeros_like(theta)
    for step in range(1, steps + 1):
        x = np.bincount(row, weights=w[col], minlength=n)
        low = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(x[:, None] - theta[None, :], -30, 30))), np.ones((n, 1))], axis=1)
        up, down = low[np.arange(n), y + 1], low[np.arange(n), y]
        p = np.maximum(up - down, 1e-9)
        du, dd = up * (1 - up), down * (1 - down)
        gx = (du - dd) / p
        gw = np.bincount(col, weights=gx[row], minlength=len(top)) + penalty * w
        gt = np.array([-(((y == k) * du - (y == k + 1) * dd) / p).sum() for k in range(GRADES - 1)])
        mw, mt = 0.9 * mw + 0.1 * gw, 0.9 * mt + 0.1 * gt
        vw, vt = 0.99 * vw + 0.01 * gw**2, 0.99 * vt + 0.01 * gt**2
        rate = 0.1 * min(1, 2 * (1 - step / (steps + 1)))
        w -= rate * (mw / (1 - 0.9**step)) / (np.sqrt(vw / (1 - 0.99**step)) + 1e-9)
        theta = np.sort(theta - rate * (mt / (1 - 0.9**step)) / (np.sqrt(vt / (1 - 0.99**step)) + 1e-9))
    return CumulativeLink(index, w, theta)


def rated(docs: DataFrame, ratings: DataFrame, id_col: str, text_col: str, fit_rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of at most ``fit_rows`` rated documents."""
    own = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where(f"doc_id IS NOT NULL AND grade BETWEEN 0 AND {GRADES - 1}")
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(fit_rows)  # its size is bounded by fit_rows
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array([features(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["grade", "x"])

    got = texts.join(F.broadcast(chosen), "doc_id").mapInArrow(run, "grade int, x binary").limit(4 * fit_rows).toArrow()  # more only if ids repeat
    pairs = sorted(zip(got.column("grade").to_pylist(), got.column("x").to_pylist(), strict=True))
    return [np.frombuffer(x, np.int32) for _, x in pairs], np.array([g for g, _ in pairs], np.int64)


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> CumulativeLink:
    """Fit on ``ratings`` (``doc_id, grade`` with grades 0, 1, 2); null or other grades and documents that aren't there are left out."""
    return fit(*rated(docs, ratings, id_col, text_col, fit_rows))


def grade(docs: DataFrame, model: CumulativeLink, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds ``expected_grade``, ``p_top`` (probability of the highest grade) and ``keep`` (``p_top >= threshold``) to documents.

    A model without weights (no ratings, one grade only, no telling feature) knows nothing against any document: all are kept.
    Other columns stay as they are, but those of these three names are replaced. Null text counts as empty; repeated rows
    get equal scores; an empty table gives none.
    """
    names = ("expected_grade", "p_top", "keep")
    rest = [c for c in docs.columns if c.lower() not in names]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS + KEEP numbers
    plain = docs.select(*[F.col(f"`{c}`") for c in rest])
    if text_col not in rest:
        raise ValueError(f"no column {text_col}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        blank = not (m.index >= 0).any()
        for b in slices(batches, text_col):
            tails = m.tails(m.score([features(t) for t in b.column(text_col).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array((tails[:, -1] >= threshold) | blank)], [*b.schema.names, *names])

    from pyspark.sql import types as T

    schema = T.StructType([*plain.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    return plain.mapInArrow(run, schema)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Graded ratings from labels: one grade for quality, one for not being toxic (null: not)."""
    return labels.where("quality IS NOT NULL").select("doc_id", (F.col("quality").cast("int") + 1 - F.coalesce(F.col("toxic").cast("int"), F.lit(0))).alias("grade"))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ratings_of(table(spark, sf_dir, "labels")))
    return grade(docs.select("doc_id", "text"), model).drop("text")
