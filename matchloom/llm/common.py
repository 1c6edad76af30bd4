"""Helpers shared by the training-data operators.

Text is always handled whole.  A null text counts as the empty text.  Words
are maximal runs of anything but ASCII white space (space, tab to carriage
return); ``bytes.split`` cuts UTF-8 text in exactly that way.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as a regular expression.
SPACE = r"[\x20\x09-\x0D]"
#: Text that is worked on at one time in a Python worker, in bytes.
CHUNK_BYTES = 1 << 19
#: Rows and bytes that Spark hands a Python worker at one time, at most.
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20
#: Stands for a null doc_id where rows are matched by key.
NO_ID = -(2**63)


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="matchloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def saved(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again.

    Cuts the lineage, so that a lost executor costs a reread and not a rerun,
    and makes values that depend on the run (such as partition ids) fixed.
    """
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/matchloom/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded size, as texts may be long."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, most)
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two longs for a row: hash of its text, and its id. Rows that agree in both are copies of one row."""
    return [
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__k1"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("__k2"),
    ]


def binary(column: pa.Array) -> pa.Array:
    """UTF-8 bytes of a string column, nulls as empty."""
    return pc.fill_null(pc.cast(column, pa.large_binary()), b"")


def give_back() -> None:
    """Return free memory of the worker to the system; workers live on for other tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with about ``limit`` bytes of text each, and the texts as large_binary."""
    for number, batch in enumerate(batches):
        if number % 8 == 7:
            give_back()
        if not batch.num_rows:
            continue
        column = binary(batch.column(batch.schema.get_field_index(text)))
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        group = ends // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(start, end - start), column.slice(start, end - start)
    give_back()


def text_chunks(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """As ``chunks``, with the texts as a list of bytes."""
    for part, column in chunks(batches, text, limit):
        yield part, column.to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Words of more bytes are hashed on their own; text is hashed in pieces of about ``PIECE`` bytes.
LONG_WORD, PIECE = 1 << 16, 1 << 18
#: A random odd base of the rolling hash with its inverse (mod 2**64), and what each byte stands for.
BASE = 0x9E3779B97F4A7C15 & ~7 | 5
INVERSE = pow(BASE, -1, 1 << 64)
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words, and bytes that may stand in runs of letters and digits.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Powers:
    """Powers of the base and of its inverse; not sent to workers, which build their own."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __reduce__(self):
        return Powers, ()

    def both(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.up):
            self.up = np.multiply.accumulate(np.append(np.uint64(1), np.full(PIECE, BASE, np.uint64)))
            self.down = np.multiply.accumulate(np.append(np.uint64(1), np.full(PIECE, INVERSE, np.uint64)))
        return self.up, self.down


POWERS = Powers()


@dataclass
class Words:
    """The words of some texts: the texts' bytes on end, and each word's text, first byte, end and hash."""

    data: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_binary column without nulls on end, and where each value starts (and the last one ends)."""
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return whole, at - at[0]


def punctuation(data: np.ndarray) -> np.ndarray:
    """Bytes of signs outside ASCII: U+0080 to U+00BF but for letters, U+2000 to U+207F, and U+3000 to U+303F."""
    out = np.zeros(len(data), bool)
    two = np.flatnonzero(data[:-1] == 0xC2)
    two = two[~np.isin(data[two + 1], (0xAA, 0xB5, 0xBA))]
    three = np.flatnonzero((data[:-2] == 0xE2) | (data[:-2] == 0xE3))
    after = data[three + 1]
    three = three[(after == 0x80) | (after == 0x81) & (data[three] == 0xE2)]
    for at, n in ((two, 2), (three, 3)):
        for k in range(n):
            out[at + k] = True
    return out


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each range (ordered, apart from each other), whatever stands around it."""
    out = np.zeros(len(start), np.uint64)
    first = 0
    while first < len(start):
        last = max(int(np.searchsorted(end, start[first] + PIECE, side="right")), first + 1)
        base, size = int(start[first]), int(end[last - 1] - start[first])
        if size > PIECE:  # one word alone
            size = 0
        else:
            up, down = POWERS.both()
            total = np.zeros(size + 1, np.uint64)
            np.cumsum(BYTE[data[base : base + size]] * up[:size], out=total[1:])
            a, b = start[first:last] - base, end[first:last] - base
            out[first:last] = (total[b] - total[a]) * down[a]
        first = last
    for k in np.flatnonzero(end - start > LONG_WORD).tolist():
        import xxhash

        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes())
    return mix(out)


def words_of(column: pa.Array, within: np.ndarray = NOT_SPACE, lower: bool = False, signs: bool = False) -> Words:
    """Maximal runs of the bytes ``within`` in the texts of a large_binary column without nulls.

    The hash of a word is that of its bytes alone: differences of a rolling hash over the whole piece, moved back to
    the word's start. ``lower`` takes A-Z as a-z; with ``signs``, signs outside ASCII separate words too.
    """
    data, offsets = flat_bytes(column)
    if lower:
        data = LOWER[data]
    inside = within[data]
    if signs:
        inside &= ~punctuation(data)
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, offsets, doc, start, end, range_hashes(data, start, end))


class WordHashes(dict):
    """64-bit hashes of words, each computed once; emptied when it has ``most`` entries."""

    def __init__(self, seed: int = 0, most: int = 50_000):
        super().__init__()
        import xxhash

        self.seed, self.most, self.hash = seed, most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        value = self.hash(word, self.seed)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def polynomial(x: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15 | 1) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values of ``x`` (mod 2**64); len(x) - n + 1 of them."""
    if len(x) < n:
        return np.zeros(0, np.uint64)
    out = x[: len(x) - n + 1].copy()
    for j in range(1, n):
        out *= np.uint64(base)
        out += x[j : len(x) - n + 1 + j]
    return mix(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting (numpy's own way hashes them, which takes longer)."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of consecutive groups of these lengths, and the group of every element."""
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    return starts.astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    parts: int,
    held: int,
    per_class: int,
    max_bytes: int,
) -> tuple[list[tuple[bytes, int]], tuple[int, int]]:
    """At most ``per_class`` texts of either class for training, and how many rows of ``docs`` each class has.

    Only labelled rows outside the held-out fold (crc32 of the id modulo
    ``parts`` equal to ``held``) with texts of at most ``max_bytes`` are used.
    Labels meet the documents first, so that no pick is lost; then rows are
    picked by a hash of the id. Of rows that share an id, the one whose text
    has the smallest hash counts. Null labels and ids are left out; an id that
    is labelled twice counts with the larger label.
    """
    spark = docs.sparkSession
    known = (
        labels.select(F.col("doc_id").cast("long").alias("__id"), (F.col(label) > 0).cast("int").alias("__y"))
        .where("__id is not null and __y is not null")
        .where(fold("__id", parts) != held)
        .groupBy("__id")
        .agg(F.max("__y").alias("__y"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce("text", F.lit("")).alias("__text"))
    texts = texts.where((F.octet_length("__text") <= max_bytes) & F.col("__id").isNotNull())
    keyed = texts.select("__id", F.xxhash64("__text").alias("__k"))
    rows = saved(keyed.join(known, "__id").groupBy("__id", "__y").agg(F.min("__k").alias("__k")))
    totals = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    picked: list[tuple[int, int, int]] = []
    for y in (0, 1):
        some = rows.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
        picked += [(r["__id"], y, r["__k"]) for r in some.collect()]
    if not picked:
        return [], (0, 0)
    chosen = spark.createDataFrame(picked, "__id long, __y int, __k long")  # at most 2 * per_class rows
    found = (
        texts.withColumn("__k", F.xxhash64("__text"))
        .join(F.broadcast(chosen), ["__id", "__k"])
        .dropDuplicates(["__id"])
        .select("__id", "__text", "__y")
        .collect()
    )
    found.sort(key=lambda r: r["__id"])
    return [(r["__text"].encode(), r["__y"]) for r in found], (totals.get(0, 0), totals.get(1, 0))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, float]:
    """Slopes and offset of the weighted logistic curve over the columns of ``x`` (Newton steps on scaled columns)."""
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack(((x - centre) / spread, np.ones(len(x))))
    w, n = np.zeros(z.shape[1]), max(weight.sum(), 1e-9)
    keep = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * np.maximum(p * (1 - p), 1e-4) / n)[:, None]).T @ z + keep
        step = np.clip(np.linalg.solve(h, z.T @ (weight * (p - y)) / n + keep @ w), -2, 2)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / spread
    return slopes, float(w[-1] - slopes @ centre)


def platt(margins: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of the weighted logistic curve from margins to labels (Newton, lightly regularised)."""
    a, b, n = 1.0, 0.0, max(weight.sum(), 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = weight * (p - y) / n
        h = weight * np.maximum(p * (1 - p), 1e-4) / n
        ga, gb = (g * margins).sum() + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = (h * margins**2).sum() + 1e-3, (h * margins).sum(), h.sum() + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = max(a - np.clip(da, -2, 2), 1e-3), b - np.clip(db, -5, 5)
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)
