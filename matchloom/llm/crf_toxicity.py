"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters and digits in lower case (signs outside ASCII
separate them too). The labels mark documents, so the tokens of the training
sample are labelled first: a word, or a word beginning of three to six bytes,
whose rate of documents is far higher among toxic ones labels its tokens of
toxic documents. A two-state chain is then fitted to these tokens by its
likelihood (gradients from forward-backward, Adam steps), over features of the
token, its beginning, its end and its neighbours. The marginals of the whole
text give spans of offending tokens (code points), and three summaries of them
give the document's score by a logistic curve fitted on sampled documents that
the chain was not fitted to.

Forward-backward runs over all tokens of a batch of texts at once: every token
is a 2x2 matrix, products over stretches of tokens are taken side by side, the
stretches are joined in the same way, and the states are then filled in. So one
very long text costs no more than many short ones.

Nulls: a null text is the empty text; texts without tokens get the score of
documents without evidence. With labels of one class only, every score is a
constant below or above 0.5. A null id is kept. Repeated rows score alike. Ties:
no row's score depends on another's. Empty tables give empty results. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, BYTE, Words, chunks, fold, labelled_sample, logistic, mapped, mix, words_of

BITS = 18
PARTS, HELD = 5, 0
#: Most training rows of either class, and the longest of them in bytes.
PER_CLASS, MAX_BYTES = 1200, 100_000
#: Tokens in a stretch whose matrices are multiplied one after the other.
STRETCH = 64
#: Bytes of a token's beginnings and ends that are features, and of the beginnings that may mark a token as toxic.
BEGINNINGS, ENDS, MARKS = (2, 3, 4, 5), (2, 3, 4), (3, 4, 5, 6)
#: Entries of a worker's table of words already weighed, as a power of two.
KNOWN_BITS = 17


def tokens(texts: pa.Array) -> Words:
    """The tokens of a large_binary column. Lower case is taken code point by code point, so offsets in code points hold."""
    return words_of(pc.cast(pc.utf8_lower(pc.cast(texts, pa.large_string())), pa.large_binary()), ALNUM, signs=True)


def edge_hashes(words: Words, at: np.ndarray, sizes: tuple[int, ...], end: bool = False) -> list[np.ndarray]:
    """Hashes of the first (last) bytes of the tokens ``at``; 0 for tokens that are not longer than that."""
    length = words.end[at] - words.start[at]
    edge = words.end[at] - 1 if end else words.start[at]
    value, out = np.zeros(len(at), np.uint64), []
    for k in range(max(sizes, default=0)):
        place = np.clip(edge - k if end else edge + k, 0, max(len(words.data) - 1, 0))
        value = value * np.uint64(0x100000001B3) + BYTE[words.data[place]]
        if k + 1 in sizes:
            out.append(np.where(length > k + 1, mix(value ^ np.uint64((k + 1) << 56 | end << 60)) | np.uint64(1), np.uint64(0)))
    return out


def traits(words: Words, at: np.ndarray) -> np.ndarray:
    """Features of the tokens ``at``, a row each: nine for the token itself, two for the one after it, two for the one before.

    A beginning or end that is the whole token is no feature of its own; its place holds the number 2**BITS.
    """
    whole = words.hash[at] | np.uint64(1)
    starts = edge_hashes(words, at, BEGINNINGS)
    length = mix(np.minimum(words.end[at] - words.start[at], 12).astype(np.uint64) + np.uint64(77))
    here = [whole, *starts, *edge_hashes(words, at, ENDS, end=True), length]
    columns = [(h, 0) for h in here] + [(h, side) for side in (1, 2) for h in (whole, starts[BEGINNINGS.index(4)])]
    out = np.empty((len(at), len(columns)), np.int64)
    for c, (h, side) in enumerate(columns):
        number = (mix(h + np.uint64(side * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - BITS)).astype(np.int64)
        out[:, c] = np.where(h == 0, 1 << BITS, number)
    return out


#: The columns of ``traits`` that speak for the token itself, the next one and the one before.
SIDES = (slice(0, 9), slice(9, 11), slice(11, 13))


class Emissions:
    """The three scores of a token under given weights; those of tokens seen last are kept."""

    def __init__(self, weights: np.ndarray):
        self.weights = np.append(weights, 0.0)
        self.known = np.zeros(1 << KNOWN_BITS, np.uint64)
        self.scores = np.zeros((1 << KNOWN_BITS, 3))

    def of(self, words: Words) -> np.ndarray:
        slot = (words.hash >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)
        out = self.scores[slot]
        fresh = np.flatnonzero(self.known[slot] != words.hash)
        for start in range(0, len(fresh), 1 << 16):
            at = fresh[start : start + (1 << 16)]
            own = self.weights[traits(words, at)]
            out[at] = np.stack([own[:, side].sum(1) for side in SIDES], 1)
        self.known[slot[fresh]] = words.hash[fresh]
        self.scores[slot[fresh]] = out[fresh]
        return out


def emit(scores: np.ndarray, group: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds of the toxic state at every token, from the token and its neighbours in the same group."""
    out = scores[:, 0] + bias
    inside = group[1:] == group[:-1]
    out[1:] += np.where(inside, scores[:-1, 1], 0)
    out[:-1] += np.where(inside, scores[1:, 2], 0)
    return out


def states(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Odds y / x of the pairs (x, y) -> (a x + b y, c x + d y), taken one after the other from (1, 1), after each step."""
    n = len(a)
    width = min(n, STRETCH)
    rows = -(-n // width) if n else 0
    out = np.empty(rows * width)
    if not n:
        return out
    # Step k of every stretch side by side; the last stretch is filled up with steps that change nothing.
    side = np.empty((4, width, rows))
    for i, (x, rest) in enumerate(((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0))):
        side[i] = np.append(x, np.full(rows * width - n, rest)).reshape(rows, width).T
    odds = np.ones(rows)
    if rows > 1:
        p, q, r, s = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
        for k in range(width):
            ak, bk, ck, dk = side[:, k]
            p, q, r, s = ak * p + bk * r, ak * q + bk * s, ck * p + dk * r, ck * q + dk * s
            if k % 4 == 3:
                scale = 1 / (p + q + r + s)
                p, q, r, s = p * scale, q * scale, r * scale, s * scale
        scale = 1 / (p + q + r + s)
        odds[1:] = states(p[:-1] * scale[:-1], q[:-1] * scale[:-1], r[:-1] * scale[:-1], s[:-1] * scale[:-1])
    wide = out.reshape(rows, width)
    for k in range(width):
        ak, bk, ck, dk = side[:, k]
        odds = np.clip((ck + dk * odds) / (ak + bk * odds), 1e-100, 1e100)
        wide[:, k] = odds
    return out[:n]


def marginals(emission: np.ndarray, group: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Chance of the toxic state at every token by forward-backward; with ``pairs`` also the summed chances of moves.

    Tokens of one ``group`` stand together and are a chain; ``move`` holds the log weights of moves from state i to j.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    e, t = np.exp(np.clip(emission, -30, 30)), np.exp(np.clip(move, -15, 15))
    first = np.append(True, group[1:] != group[:-1])
    last = np.append(first[1:], True)
    one = np.ones(n)
    ahead = states(np.where(first, one, t[0, 0]), np.where(first, one, t[1, 0]), e * np.where(first, one, t[0, 1]), e * np.where(first, one, t[1, 1]))
    after = np.append(e[1:], 1.0)
    way = (np.where(last, one, t[0, 0]), np.where(last, one, t[0, 1] * after), np.where(last, one, t[1, 0]), np.where(last, one, t[1, 1] * after))
    back = states(*(x[::-1] for x in way))[::-1]
    odds = np.clip(ahead * back, 1e-100, 1e100)
    chance = odds / (1 + odds)
    moves = np.zeros((2, 2))
    if pairs:
        at = np.flatnonzero(~first)
        r, b = ahead[at - 1], back[at] * e[at]
        w = np.stack([np.full(len(at), t[0, 0]), t[0, 1] * b, t[1, 0] * r, t[1, 1] * r * b])
        moves = (w / w.sum(0)).sum(1).reshape(2, 2)
    return chance, moves


def telling(key: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The keys that far more of the toxic documents have: eight times the rate, and a likelihood ratio above 20."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    kinds, which = np.unique(key[once], return_inverse=True)
    toxic = y[doc[once]]
    c, other = (np.bincount(which, toxic == k, len(kinds)) for k in (1, 0))
    n = [max(int((y == k).sum()), 1) for k in (0, 1)]
    both = c + other
    ratio = np.zeros(len(kinds))
    for own, k in ((c, 1), (other, 0)):
        ratio += np.where(own > 0, own * np.log(np.maximum(own, 1) / (both * n[k] / sum(n))), 0)
    return kinds[(c >= 3) & (c * n[0] >= 8 * other * n[1]) & (2 * ratio > 20)]


def label_tokens(words: Words, y: np.ndarray) -> np.ndarray:
    """1 for the tokens of toxic documents that carry a mark of toxic documents, else 0.

    Words are weighed first; beginnings are then weighed on the words that are left.
    """
    marked = np.isin(words.hash, telling(words.hash, words.doc, y))
    rest = np.flatnonzero(~marked)
    starts = edge_hashes(words, rest, MARKS)
    key, doc = np.concatenate(starts), np.tile(words.doc[rest], len(starts))
    found = telling(key[key > 0], doc[key > 0], y)
    for own in edge_hashes(words, np.arange(len(words.hash)), MARKS):
        marked |= np.isin(own, found)
    return (marked & (y[words.doc] == 1)).astype(float)


def fit_chain(words: Words, y: np.ndarray, steps: int = 45, piece: int = 48, penalty: float = 2e-6):
    """Feature weights, bias and move weights of the chain. Documents are cut into pieces of ``piece`` tokens for this."""
    lengths = words.lengths
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    group = words.doc * (int(lengths.max(initial=0)) // piece + 1) + (np.arange(len(words.doc)) - starts[words.doc]) // piece
    _, first, ids = np.unique(words.hash, return_index=True, return_inverse=True)
    table = traits(words, first)
    spread = [table[:, side] for side in SIDES]
    inside = group[1:] == group[:-1]
    observed = np.array([[((y[:-1] == i) & (y[1:] == j) & inside).sum() for j in (0, 1)] for i in (0, 1)], float)
    none, size = 1 << BITS, (1 << BITS) + 6
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    w[none + 1] = -4.0
    for step in range(1, steps + 1):
        scores = np.stack([w[f].sum(1) for f in spread], 1)[ids]
        p, moves = marginals(emit(scores, group, w[none + 1]), group, w[-4:].reshape(2, 2), pairs=True)
        gap = p - y
        by = [np.bincount(ids, gap, len(table)), np.bincount(ids[:-1], gap[1:] * inside, len(table)), np.bincount(ids[1:], gap[:-1] * inside, len(table))]
        g = np.zeros(size)
        for f, x in zip(spread, by, strict=True):
            g[: none + 1] += np.bincount(f.ravel(), np.repeat(x, f.shape[1]), none + 1)
        g[none] = 0
        g[none + 1] = gap.sum()
        g[-4:] = (moves - observed).ravel()
        g = g / len(y) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (1 - 0.6 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) * (np.abs(g) > 0)
    return w[:none], float(w[none + 1]), w[-4:].reshape(2, 2)


def summary(chance: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: log-odds of the strongest token, log of the expected number of toxic tokens, and their log share."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    top = np.full(len(lengths), 1e-6)
    total = np.bincount(doc, chance, len(lengths))
    if len(chance):
        some = lengths > 0
        top[some] = np.maximum(np.maximum.reduceat(chance, (np.cumsum(lengths) - lengths)[some]), 1e-6)
    top = np.minimum(top, 1 - 1e-6)
    return np.stack([np.log(top / (1 - top)), np.log(total + 0.05), np.log((total + 0.05) / (lengths + 5))], 1)


def fit(sample: list[tuple[bytes, int]], totals: tuple[int, int]):
    """Weights in use (ids, values), bias, moves, slopes over the summaries and the curve's offset."""
    y = np.array([v for _, v in sample], np.int64)
    if len(set(y.tolist())) < 2:
        level = 0.5 if not len(y) else (0.05 if y[0] == 0 else 0.95)
        return np.zeros(0, np.int64), np.zeros(0), 0.0, np.zeros((2, 2)), np.zeros(3), float(np.log(level / (1 - level)))
    half = np.random.default_rng(3).random(len(y)) < 0.7
    if min(half.sum(), (~half).sum()) < 20 or len(set(y[half].tolist())) < 2 or len(set(y[~half].tolist())) < 2:
        half[:] = True
    some = lambda use: tokens(pa.array([sample[i][0] for i in use], pa.large_binary()))
    chosen = np.flatnonzero(half)
    rest = np.flatnonzero(~half) if not half.all() else chosen
    # Marks are weighed on the whole sample; the chain sees the chosen documents only.
    words = some(range(len(y)))
    tags = label_tokens(words, y)[half[words.doc]]
    words = some(chosen)
    w, bias, move = fit_chain(words, tags) if len(words.hash) else (np.zeros(1 << BITS), 0.0, np.zeros((2, 2)))
    words = some(rest)
    chance, _ = marginals(emit(Emissions(w).of(words), words.doc, bias), words.doc, move)
    x = summary(chance, words.lengths)
    share = np.array(totals, float) / max(sum(totals), 1)
    weight = share[y[rest]] / np.array([max((y[rest] == k).sum(), 1) for k in (0, 1)])[y[rest]] * len(rest)
    slopes, offset = logistic(x, y[rest].astype(float), weight)
    used = np.flatnonzero(w)
    return used, w[used], bias, move, slopes, offset


def spans_of(words: Words, found: np.ndarray) -> pa.Array:
    """Per text, starts and ends of the tokens ``found`` in code points, as flat lists."""
    at = np.flatnonzero(found)
    points = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80))).astype(np.int32)
    base = points[words.offsets[words.doc[at]]]
    flat = np.stack([points[words.start[at]] - base, points[words.end[at]] - base], 1).ravel()
    sizes = 2 * np.bincount(words.doc[at], minlength=len(words.offsets) - 1)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))


def scorer(model):
    """A function for mapInArrow from (doc_id, held_out, text) to (doc_id, held_out, score, spans)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, values, bias, move, slopes, offset = model
        w = np.zeros(1 << BITS)
        w[used] = values
        table = Emissions(w)
        for part, texts in chunks(batches):
            words = tokens(texts)
            chance, _ = marginals(emit(table.of(words), words.doc, bias), words.doc, move)
            level = np.clip(summary(chance, words.lengths) @ slopes + offset, -30, 30)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(1 / (1 + np.exp(-level))), spans_of(words, chance >= 0.5)],
                ["doc_id", "held_out", "score", "spans"],
            )

    return score


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (flat list of starts and ends, code points) for every row."""
    model = fit(*labelled_sample(docs, labels, "toxic", PARTS, HELD, per_class, max_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", PARTS) == HELD).alias("held_out"), "text")
    out = mapped(rows, scorer(model), "doc_id long, held_out boolean, score double, spans array<int>")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
