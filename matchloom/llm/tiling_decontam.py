"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits in lower case (signs outside ASCII
separate them too). Runs of five words that a document shares with a benchmark
item are the seeds: a rolling hash of the document's words (Karp-Rabin) is
looked up among the items' hashes, and the words' own hashes are compared.
Items are found by their rarest seeds only: a document that covers enough of an
item has so many of its seeds that it must have one of these, and an opening
that many items share brings up none of them. Seeds on one diagonal join into matches; the longest match
whose words are still free is marked first, matches that overlap marked words
are cut to what is free of them, and so on until none of five words is left.
An item is leaked when the marked tiles cover enough of its words, in whatever
order the document has them.

The benchmark is read in blocks of bounded size; each block is sent to the
workers, and the documents pass by once per block.

Nulls: null or short texts match nothing. An item of fewer than five words is
one tile: it is leaked where all its words stand in a row; an item without words
is never leaked. Null ids are kept. Rows that repeat are judged alike. Ties: of
equally long matches the one first in the document, then in the item, is marked
first. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Words, binary, chunks, distinct, mapped, mix, polynomial, saved, words_of

TILE = 5
#: Least share of an item's words under tiles.
COVERAGE = 0.6
#: Bytes of benchmark text sent to the workers at one time.
BLOCK_BYTES = 8 << 20


def tokens(texts: pa.Array) -> Words:
    return words_of(pc.cast(pc.utf8_lower(pc.cast(texts, pa.large_string())), pa.large_binary()), ALNUM, signs=True)


def tiles(pairs, n_left: int, n_right: int, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy tiling from all positions (i, j) at which ``least`` words agree: tiles (i, j, length), no word in two."""
    i, j = np.array(pairs, np.int64).reshape(-1, 2).T
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    fresh = np.ones(len(i), bool)
    fresh[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
    first = np.flatnonzero(fresh)
    length = np.diff(np.append(first, len(i))) + least - 1
    heap = list(zip((-length).tolist(), i[first].tolist(), j[first].tolist(), strict=True))
    heapq.heapify(heap)
    left, right, out = bytearray(n_left), bytearray(n_right), []
    while heap:
        length, i, j = heapq.heappop(heap)
        length = -length
        free = [not (left[i + k] or right[j + k]) for k in range(length)]
        if all(free):
            left[i : i + length] = right[j : j + length] = b"\1" * length
            out.append((i, j, length))
            continue
        k = 0
        while k < length:  # cut to the free runs
            if not free[k]:
                k += 1
                continue
            e = k
            while e < length and free[e]:
                e += 1
            if e - k >= least:
                heapq.heappush(heap, (-(e - k), i + k, j + k))
            k = e
    return out


def blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items' ids and texts, ``limit`` bytes of text (one item at least) at a time."""
    now, size = [], 0
    for row in items.toLocalIterator():
        text = (row["text"] or "").encode()
        if now and size + len(text) > limit:
            yield now
            now, size = [], 0
        now.append((row["item_id"], text))
        size += len(text)
    if now:
        yield now


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every run of ``n`` words inside one text, and the run's hash."""
    runs = polynomial(words.hash, n)
    at = np.flatnonzero(words.doc[: len(runs)] == words.doc[n - 1 :]) if len(runs) else np.zeros(0, np.int64)
    return at, runs[at]


class Index:
    """The items of a block: their words' hashes, and for each length of seeds the rarest seeds by which items are found."""

    def __init__(self, block: list[tuple[int, bytes]], coverage: float):
        words = tokens(pa.array([t for _, t in block], pa.large_binary()))
        self.ids = [i for i, _ in block]
        self.sizes = words.lengths
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hash = words.hash
        self.seed = np.minimum(self.sizes, TILE)
        # The seed that begins at each word, as far as the item has one there.
        self.run, self.begins = np.zeros(len(self.hash), np.uint64), np.zeros(len(self.hash), bool)
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(self.seed[self.seed > 0]).tolist():
            at, runs = grams(words, n)
            own = self.seed[words.doc[at]] == n
            self.run[at[own]], self.begins[at[own]] = runs[own], True
            item, runs = words.doc[at][own], runs[own]
            _, which, often = np.unique(runs, return_inverse=True, return_counts=True)
            order = np.lexsort((runs, often[which], item))
            item, runs = item[order], runs[order]
            many = np.bincount(item, minlength=len(block))
            # Fewest seeds that can cover enough; one of them is among the rarest that are left when so many are taken away.
            need = np.maximum(np.ceil(np.ceil(coverage * self.sizes - 1e-9) / n), 1).astype(np.int64)
            nth = np.arange(len(item)) - (np.cumsum(many) - many)[item]
            keep = nth <= (many - need)[item]
            item, runs = item[keep], runs[keep]
            order = np.argsort(runs, kind="stable")
            self.keys[n] = runs[order], item[order]

    def words_of(self, item: int) -> np.ndarray:
        return self.hash[self.starts[item] : self.starts[item] + self.sizes[item]]


def shared(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Positions (i, j) at which ``n`` words of both agree."""
    a, b = polynomial(left, n), polynomial(right, n)
    order = np.argsort(a, kind="stable")
    low, high = np.searchsorted(a[order], b, side="left"), np.searchsorted(a[order], b, side="right")
    j = np.repeat(np.arange(len(b)), high - low)
    nth = np.arange(len(j)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    i = order[low[j] + nth] if len(j) else np.zeros(0, np.int64)
    same = np.ones(len(i), bool)
    for k in range(n):
        same &= left[i + k] == right[j + k]
    return np.stack([i[same], j[same]], 1)


def reachable(index: Index, words: Words, doc: np.ndarray, item: np.ndarray, coverage: float, most: int = 1 << 20) -> np.ndarray:
    """Which pairs of a document and an item have seeds that cover enough of the item, in whatever way they overlap."""
    of = np.zeros(len(words.offsets) - 1, bool)
    of[doc] = True
    known = []
    for n in index.keys:
        at, runs = grams(words, n)
        some = of[words.doc[at]]
        known.append(mix(runs[some] ^ mix(words.doc[at[some]].astype(np.uint64) + np.uint64(1))))
    known = distinct(np.concatenate(known))
    out = np.zeros(len(doc), bool)
    ends = np.cumsum(index.sizes[item])
    for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(ends // most)) + 1):
        size = index.sizes[item[part]]
        first = np.cumsum(size) - size
        at = np.repeat(index.starts[item[part]] - first, size) + np.arange(size.sum())
        key = mix(index.run[at] ^ mix(np.repeat(doc[part], size).astype(np.uint64) + np.uint64(1)))
        hit = index.begins[at] & (known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key)
        covered, wide = hit.copy(), np.repeat(index.seed[item[part]], size)
        for k in range(1, TILE):
            covered[k:] |= (hit & (wide > k))[:-k]
        out[part] = np.add.reduceat(covered, first, dtype=np.int64) >= coverage * size
    return out


def finder(index: Index, coverage: float):
    """A function for mapInArrow from (doc_id, text) to the leaks found."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words = tokens(texts)
            starts = np.cumsum(words.lengths) - words.lengths
            met = []
            for n, (keys, items) in index.keys.items():
                at, runs = grams(words, n)
                low, high = np.searchsorted(keys, runs, side="left"), np.searchsorted(keys, runs, side="right")
                some = np.flatnonzero(high > low)
                count = (high - low)[some]
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                met.append(np.repeat(words.doc[at[some]], count) * len(index.ids) + items[np.repeat(low[some], count) + nth])
            ids = part.column(0).to_pylist()
            rows = []
            pairs = distinct(np.concatenate(met)) if met else np.zeros(0, np.int64)
            if len(pairs):
                pairs = pairs[reachable(index, words, *np.divmod(pairs, len(index.ids)), coverage)]
            for pair in pairs.tolist():
                d, item = divmod(pair, len(index.ids))
                size, n = int(index.sizes[item]), int(index.seed[item])
                own = words.hash[starts[d] : starts[d] + words.lengths[d]]
                places = shared(own, index.words_of(item), n)
                if not len(places):
                    continue
                found = tiles(places, len(own), size, n)
                covered = sum(length for _, _, length in found)
                if covered >= coverage * size:
                    rows.append((ids[d], index.ids[item], covered, size, len(found)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)],
                ["doc_id", "item_id", "covered", "n_words", "n_tiles"],
            )

    return find


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, covered and n_words (words of the item), n_tiles and coverage of every leaked item, by row of ``docs``."""
    spark: SparkSession = docs.sparkSession
    schema = "doc_id long, item_id long, covered long, n_words long, n_tiles int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], schema)
    found = []
    for block in blocks(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), block_bytes):
        found.append(mapped(rows, finder(Index(block, coverage), coverage), schema))
    for one in found:
        out = one if len(found) == 1 else out.union(saved(one))
    return out.withColumn("coverage", F.col("covered") / F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that leak no item, all columns as they were."""
    names = docs.columns
    for block in blocks(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), block_bytes):
        find = finder(Index(block, coverage), coverage)

        def keep(batches: Iterator[pa.RecordBatch], find=find) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = binary(batch.column(batch.schema.get_field_index("text"))).cast(pa.large_string())
                probe = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), text], ["doc_id", "text"])
                bad = np.zeros(batch.num_rows, bool)
                for hits in find(iter([probe])):
                    bad[hits.column(0).to_numpy()] = True
                yield batch.filter(pa.array(~bad))

        docs = mapped(docs.select(names), keep, docs.schema)
    return docs
