"""Substring deduplication by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the
run of ``MINIMISER`` words in it with the smallest hash, the leftmost one of
equals. Consecutive windows with the same minimiser (at the same place) travel
together, as one packed string of their words, to the bucket of the minimiser;
equal windows have equal minimisers, so they meet there. Each distinct packed
string comes once, with the number of its copies, so a passage that a third of
all documents share is added up before it is sent. In the bucket, windows are
sorted by a hash, and neighbours are compared word for word.

Most minimisers occur once, and their windows cannot repeat. So minimisers are
counted first, and a filter of fixed size (``FILTER_BITS`` bits, 8 MB) that
holds all repeated ones goes to the workers; only super-k-mers it lets through
are packed and sent. A filter that fills up lets more through; the result stays
the same. A second small filter holds the minimisers of more than ``LARGE``
super-k-mers (the ends of a common passage, with what follows it in every
document). Their buckets would grow with the corpus, so their windows go on
alone, each to its equals.

Windows are judged on the input. Every word under a repeated window is
removed, the first copy included.

Nulls: a null text has no words. A null id is kept. Rows that repeat are rows
of their own: their windows repeat one another. Texts of fewer words than a
window keep all of them. Empty tables give empty results. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, distinct, mapped, mix, polynomial, ragged, row_key, saved, text_chunks

WINDOW = 35
MINIMISER = 8
FILTER_BITS = 1 << 26
PROBES = 4
#: Super-k-mers of a minimiser from which on its bucket is dealt out, and the bits of the filter of such minimisers.
LARGE, LARGE_BITS = 16384, 1 << 22


def runs(flat: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of consecutive documents: document, first word in it, number of windows, minimiser.

    ``flat`` holds the words' hashes and ``lengths`` the documents' numbers of words.
    """
    starts, doc = ragged(lengths)
    m = min(MINIMISER, window)
    grams = polynomial(flat, m)
    span = window - m + 1
    n = len(flat) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    # Leftmost smallest of ``span`` consecutive values, by doubling.
    best, at = grams, np.arange(len(grams), dtype=np.int64)
    width = 1
    while width < span:
        step = min(width, span - width)
        left, right = best[:-step], best[step:]
        later = right < left
        best, at = np.where(later, right, left), np.where(later, at[step:], at[:-step])
        width += step
    whole = doc[:n] == doc[window - 1 :]
    fresh = np.ones(n, bool)
    fresh[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1]) | (doc[1:n] != doc[: n - 1])
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, n))
    keep = whole[first]
    first, size = first[keep], size[keep]
    return doc[first], first - starts[doc[first]], size, best[first]


def minimisers(window: int):
    """A function for mapInArrow from (text) to the minimiser of every super-k-mer."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes(2)
        for _, texts in text_chunks(batches):
            split = [t.split() for t in texts]
            lengths = np.array([len(w) for w in split], np.int64)
            found = runs(words.of([x for w in split for x in w]), lengths, window)[3]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])

    return find


def probes(h: np.ndarray, bits: int) -> np.ndarray:
    """Places of a filter that stand for each hash, one row per probe."""
    a, b = mix(h ^ np.uint64(0xA0761D6478BD642F)), mix(h ^ np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(PROBES)])


def held(filled: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter may hold."""
    at = probes(h, len(filled) << 6)
    return ((filled[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(0)


def places(large: int):
    """A function for mapInArrow from (h, c) to (which filter, word of it, its bits)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            h, c = part.column(0).to_numpy().view(np.uint64), part.column(1).to_numpy()
            for which, some, size in ((0, h, FILTER_BITS), (1, h[c > large], LARGE_BITS)):
                at = distinct(probes(some, size).ravel())
                if not len(at):
                    continue
                word, bit = at >> np.uint64(6), np.left_shift(np.uint64(1), at & np.uint64(63))
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                bits = np.bitwise_or.reduceat(bit, first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), which, np.int32)), pa.array(word[first].astype(np.int64)), pa.array(bits.view(np.int64))],
                    ["which", "word", "bits"],
                )

    return find


def packer(window: int, filters):
    """A function for mapInArrow from (__k1, __k2, text) to packed super-k-mers that may hold repeated windows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (filled, large) = WordHashes(2), filters.value
        for part, texts in text_chunks(batches):
            split = [t.split() for t in texts]
            lengths = np.array([len(w) for w in split], np.int64)
            doc, first, size, h = runs(words.of([x for w in split for x in w]), lengths, window)
            maybe = held(filled, h)
            doc, first, size, h = doc[maybe], first[maybe], size[maybe], h[maybe]
            packed = [
                b" ".join(split[d][a : a + n + window - 1]) for d, a, n in zip(doc.tolist(), first.tolist(), size.tolist(), strict=True)
            ]
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(rows),
                    part.column(1).take(rows),
                    pa.array(first.astype(np.int32)),
                    pa.array(h.view(np.int64)),
                    pa.array(packed, pa.binary()),
                    pa.array(held(large, h)),
                ],
                ["__k1", "__k2", "first", "h", "packed", "crowded"],
            )

    return pack


def repeated(groups: np.ndarray, packed: list[bytes], copies: np.ndarray, window: int) -> list[np.ndarray]:
    """For packed strings of whole buckets (``groups``): the places of their windows that occur more than once."""
    split = [p.split() for p in packed]
    kinds: dict[bytes, int] = {}
    ids = np.fromiter((kinds.setdefault(w, len(kinds)) for s in split for w in s), np.int64, sum(map(len, split)))
    lengths = np.array([len(s) for s in split], np.int64)
    starts, owner = ragged(lengths)
    code = polynomial(mix(ids.astype(np.uint64) + np.uint64(1)), window)
    at = np.flatnonzero(owner[: len(code)] == owner[window - 1 :]) if len(code) else np.zeros(0, np.int64)
    group, code = groups[owner[at]], code[at]
    order = np.lexsort((code, group))
    at, group, code = at[order], group[order], code[order]
    many = copies[owner[at]] > 1
    same = np.zeros(len(at), bool)
    same[1:] = (group[1:] == group[:-1]) & (code[1:] == code[:-1])
    pairs = np.flatnonzero(same)
    equal = np.ones(len(pairs), bool)
    for k in range(window):  # neighbours of one hash, word for word
        equal &= ids[at[pairs] + k] == ids[at[pairs - 1] + k]
    twice = many.copy()
    if equal.all():
        # A window of several copies also counts for its equals with one copy.
        twice[pairs] = twice[pairs - 1] = True
    else:  # two windows of one hash differ: such runs are told apart by their words
        heads = np.flatnonzero(~same)
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(at)).tolist(), strict=True):
            seen: dict[bytes, list[int]] = {}
            for i in range(a, b):
                seen.setdefault(ids[at[i] : at[i] + window].tobytes(), []).append(i)
            for own in seen.values():
                if len(own) > 1:
                    twice[own] = True
    out: list[list[int]] = [[] for _ in packed]
    hit = np.sort(at[twice])
    for o, place in zip(owner[hit].tolist(), (hit - starts[owner[hit]]).tolist(), strict=True):
        out[o].append(place)
    return [np.array(x, np.int64) for x in out]


def cover(places_: np.ndarray, window: int) -> list[int]:
    """Ends (flat list of starts and ends) of the words under windows at the sorted places."""
    if not len(places_):
        return []
    gap = np.flatnonzero(np.diff(places_) > window) + 1
    firsts = places_[np.concatenate(([0], gap))]
    lasts = places_[np.concatenate((gap - 1, [len(places_) - 1]))] + window
    return np.stack([firsts, lasts], 1).ravel().tolist()


def counter(window: int, most: int = 4 << 20):
    """A function for mapInArrow over (h, packed, copies) sorted by h, whole buckets in one partition."""

    def flush(keys: list[int], packed: list[bytes], copies: list[int]) -> pa.RecordBatch:
        spans = [cover(x, window) for x in repeated(np.array(keys, np.int64), packed, np.array(copies), window)] if keys else []
        keep = [i for i, s in enumerate(spans) if s]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([keys[i] for i in keep], pa.int64()),
                pa.array([packed[i] for i in keep], pa.binary()),
                pa.array([spans[i] for i in keep], pa.list_(pa.int32())),
            ],
            ["h", "packed", "spans"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        packed: list[bytes] = []
        copies: list[int] = []
        size = 0
        for part in batches:
            for h, p, c in zip(*(column.to_pylist() for column in part.columns), strict=True):
                if size > most and keys[-1] != h:  # a bucket has ended
                    yield flush(keys, packed, copies)
                    keys, packed, copies, size = [], [], [], 0
                keys.append(h)
                packed.append(p)
                copies.append(c)
                size += len(p)
        yield flush(keys, packed, copies)

    return count


def single(window: int):
    """A function for mapInArrow from (h, p, packed, copies) to the windows of each string (h, p, place, words, copies)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows, places_, out = [], [], []
            for i, packed in enumerate(part.column(2).to_pylist()):
                words = packed.split()
                n = len(words) - window + 1
                rows += [i] * n
                places_ += range(n)
                out += [b" ".join(words[a : a + window]) for a in range(n)]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(take), part.column(1).take(take), pa.array(places_, pa.int32()), pa.array(out, pa.binary()), part.column(3).take(take)],
                ["h", "p", "place", "words", "copies"],
            )

    return split


def remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) to the words kept and removed."""
    for part, texts in text_chunks(batches):
        ids, spans = part.column(0), part.column(2).to_pylist()
        total, gone, kept = [], [], []
        for text, own in zip(texts, spans, strict=True):
            words = text.split()
            total.append(len(words))
            if own:
                out = np.zeros(len(words) + 1, np.int64)
                flat = np.array([x for s in own for x in s], np.int64)
                np.add.at(out, flat[::2], 1)
                np.add.at(out, flat[1::2], -1)
                stay = np.cumsum(out)[:-1] == 0
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``remover``, with the SHA-256 of the kept words in place of the words."""
    for part in remover(batches):
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in part.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, large: int = LARGE) -> DataFrame:
    """__k1, __k2 and spans (lists of word positions, start and end in turn) of the rows with repeated windows."""
    spark = docs.sparkSession
    keyed = docs.select(*row_key(), "text")
    counts = mapped(keyed.select("text"), minimisers(window), "h long").groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    bits = mapped(counts, places(large), "which int, word long, bits long").groupBy("which", "word").agg(F.bit_or("bits").alias("bits"))
    filters = np.zeros(FILTER_BITS >> 6, np.uint64), np.zeros(LARGE_BITS >> 6, np.uint64)
    for part in bits.toArrow().to_batches():  # 2**20 + 2**16 rows at most, whatever the corpus
        which, word, value = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_numpy().view(np.uint64)
        for i in (0, 1):
            filters[i][word[which == i]] = value[which == i]
    schema = "__k1 long, __k2 long, first int, h long, packed binary, crowded boolean"
    sent = saved(mapped(keyed, packer(window, spark.sparkContext.broadcast(filters)), schema))

    def distinct(of: str) -> DataFrame:
        return sent.where(of).groupBy("h", "packed").agg(F.count("*").alias("copies"))

    buckets = distinct("not crowded").repartition("h").sortWithinPartitions("h").select("h", "packed", "copies")
    few = mapped(buckets, counter(window), "h long, packed binary, spans array<int>").select("h", F.xxhash64("packed").alias("p"), "spans")
    alone = mapped(
        distinct("crowded").select("h", F.xxhash64("packed").alias("p"), "packed", "copies"),
        single(window),
        "h long, p long, place int, words binary, copies long",
    )
    twice = saved(alone.groupBy("words").agg(F.sum("copies").alias("n")).where("n > 1").select("words"))
    many = alone.join(twice, "words", "left_semi").groupBy("h", "p").agg(F.flatten(F.collect_list(F.array("place", F.col("place") + window))).alias("spans"))
    found = saved(few.union(many))
    return (
        sent.select("__k1", "__k2", "first", "h", F.xxhash64("packed").alias("p"))
        .join(found, ["h", "p"])
        .select("__k1", "__k2", F.transform("spans", lambda x: x + F.col("first")).alias("s"))
        .groupBy("__k1", "__k2")
        .agg(F.collect_set("s").alias("spans"))
    )


def _removed(docs: DataFrame, window: int, function, schema: str) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key())
    joined = rows.join(repeated_spans(docs, window), ["__k1", "__k2"], "left").select("doc_id", "text", "spans")
    return mapped(joined, function, schema)


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) for every row of ``docs``."""
    return _removed(docs, window, remover, "doc_id long, n_words long, n_removed long, kept string")


def removed_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of ``docs``."""
    return _removed(docs, window, hashed, "doc_id long, n_words long, n_removed long, kept_sha256 string")
