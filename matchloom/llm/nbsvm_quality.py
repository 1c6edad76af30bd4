"""Quality classifier: naive Bayes support vectors.

Features are indicators of runs of one to three words, and of runs of one to
three word shapes (the sequence of a word's capitals, small letters, digits and
other characters, each kind once where it repeats; a word that repeats the one
before it has a shape of its own). Each indicator is scaled by the log ratio of
its smoothed rates in the two classes, and a linear model is fitted on the
scaled indicators by dual coordinate descent on the hinge loss. Margins become
probabilities by a logistic curve fitted on cross-validated margins, weighted to
the class shares of all labelled rows.

Nulls: a null text is the empty text, which has no feature and scores the
curve's value for the offset; with no labelled rows every score is 0.5. A null id is kept. Repeated rows
score alike. Ties: no row's score depends on another's. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, distinct, fold, labelled_sample, mapped, mix, platt, range_hashes, words_of

BITS = 20
PARTS, HELD = 3, 1
#: Most training rows of either class, and the longest of them in bytes.
PER_CLASS, MAX_BYTES = 1500, 200_000
REPEAT = np.uint64(0x5BD1E995)
#: What a byte is in a word's shape: digit, capital, other letter (all bytes outside ASCII), or itself.
KIND = np.arange(256, dtype=np.uint8)
KIND[48:58], KIND[65:91], KIND[97:123], KIND[128:] = 1, 2, 3, 3


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Document index and feature of every distinct n-gram of every text, sorted."""
    words = words_of(texts)
    doc, word = words.doc, words.hash
    # The shape of a word: its kinds of bytes, each run of one kind as one.
    kind = KIND[words.data]
    fresh = np.ones(len(kind), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[words.start] = True
    place = np.concatenate(([0], np.cumsum(fresh)))
    form = range_hashes(kind[fresh], place[words.start], place[words.end])
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    form = np.where(same, REPEAT, form)
    keys = []
    for number, part in enumerate((word, form)):
        run = part
        for n in (1, 2, 3):
            if n > 1:
                if len(part) < n:
                    break
                run = run[:-1] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :]
            inside = doc[: len(run)] == doc[n - 1 :]
            gram = (mix(run ^ np.uint64((2 * n + number) << 50)) >> np.uint64(64 - BITS)).astype(np.int64)
            keys.append((doc[: len(run)] << BITS | gram)[inside])
    found = distinct(np.concatenate(keys))
    return found >> BITS, found & ((1 << BITS) - 1)


class Rows:
    """The distinct features of documents, one after the other in one array, so that all of it is given back at once."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray):
        self.flat, self.ends = flat, ends
        self.starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends

    @classmethod
    def of(cls, texts: list[bytes], part: int = 200) -> Rows:
        flat, sizes = [], []
        for k in range(0, len(texts), part):
            doc, feature = features(pa.array(texts[k : k + part], pa.large_binary()))
            flat.append(feature.astype(np.int32))
            sizes.append(np.bincount(doc, minlength=len(texts[k : k + part])))
        return cls(np.concatenate(flat), np.cumsum(np.concatenate(sizes)))

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i] : self.ends[i]]

    def chosen(self, use: np.ndarray, known: np.ndarray) -> Rows:
        """The rows ``use`` with the known features only."""
        own = [self[i] for i in use]
        flat = np.concatenate(own)
        keep = known[flat]
        owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
        return Rows(flat[keep], np.cumsum(np.bincount(owner[keep], minlength=len(own))))


def descend(rows: Rows, y: np.ndarray, scale: np.ndarray, c: float, epochs: int, seed: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights over scaled indicators, offset, and the dual variables (0 to c), by dual coordinate descent on the hinge loss."""
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(y))
    values = scale[rows.flat]
    owner = np.repeat(np.arange(len(y)), rows.ends - rows.starts)
    diagonal = np.bincount(owner, values * values, len(y)) + 1
    order = np.arange(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        most = 0.0
        for i in order:
            at, v = rows[i], values[rows.starts[i] : rows.ends[i]]
            g = y[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - g / diagonal[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                bias += step
                alpha[i] = new
                most = max(most, abs(g))
        if most < 1e-3:
            break
    return w, bias, alpha


def fit(sample: list[tuple[bytes, int]], totals: tuple[int, int], c: float = 0.05, epochs: int = 30, min_rows: int = 3):
    """Weights of the features in use (ids, values), offset, and the curve's slope and offset."""
    y = np.array([v for _, v in sample], np.int64)
    if len(set(y.tolist())) < 2:
        level = 0.5 if not len(y) else (0.05 if y[0] == 0 else 0.95)
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, 1.0, float(np.log(level / (1 - level)))
    rows = Rows.of([t for t, _ in sample])
    sign = np.where(y > 0, 1.0, -1.0)

    def learn(use: np.ndarray) -> tuple[np.ndarray, float]:
        counts = [np.bincount(np.concatenate([rows[i] for i in use[y[use] == k]]), minlength=1 << BITS) for k in (0, 1)]
        n = [max((y[use] == k).sum(), 1) for k in (0, 1)]
        rate = [(counts[k] + 0.5) / (n[k] + 1) for k in (0, 1)]
        scale = np.where(counts[0] + counts[1] >= min_rows, np.log(rate[1] / rate[0]), 0.0)
        w, bias, _ = descend(rows.chosen(use, scale != 0), sign[use], scale, c, epochs, 7)
        return w * scale, bias

    rng = np.random.default_rng(5)
    part = rng.permutation(len(y)) % 3
    margins = np.zeros(len(y))
    for k in range(3):
        use = np.flatnonzero(part != k)
        if len(set(y[use].tolist())) < 2:
            continue
        w, bias = learn(use)
        for i in np.flatnonzero(part == k):
            margins[i] = w[rows[i]].sum() + bias
    w, bias = learn(np.arange(len(y)))
    share = np.array(totals, float) / max(sum(totals), 1)
    weight = share[y] / np.array([max((y == k).sum(), 1) for k in (0, 1)])[y] * len(y)
    slope, offset = platt(margins, y.astype(float), weight)
    used = np.flatnonzero(w)
    return used, w[used].astype(np.float32), bias, slope, offset


def scorer(model) -> Callable:
    """A function for mapInArrow from (doc_id, __held, text) to (doc_id, held_out, score)."""

    def score(batches):
        used, values, bias, slope, offset = model
        w = np.zeros(1 << BITS)
        w[used] = values
        for part, texts in chunks(batches):
            doc, feature = features(texts)
            margin = np.bincount(doc, w[feature], len(texts)) + bias
            p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p)], ["doc_id", "held_out", "score"])

    return score


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES):
    """Model of ``labels.quality`` from a bounded, class-wise sample of the rows outside the held-out fold."""
    return fit(*labelled_sample(docs, labels, "quality", PARTS, HELD, per_class, max_bytes))


def quality_scores(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    model = train(docs, labels, **bounds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", PARTS) == HELD).alias("held_out"), "text")
    return mapped(rows, scorer(model), "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def keep_good(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts (score of 0.5 or more), all their columns as they were."""
    model = train(docs, labels, **bounds)
    names = docs.columns

    def accept(batches):
        used, values, bias, slope, offset = model
        w = np.zeros(1 << BITS)
        w[used] = values
        for part, texts in chunks(batches):
            doc, feature = features(texts)
            margin = np.bincount(doc, w[feature], len(texts)) + bias
            yield part.filter(pa.array(slope * margin + offset >= 0))

    return mapped(docs.select(names), accept, docs.schema)
