"""Sharding by sampled splitters.

Rows are ordered by a key of 63 bits: the checksum of the text, then a hash of
the id, then one of the row's number, so that equal texts lie side by side and a
large group of them, even of rows that repeat, can still be divided. A sample of keys, drawn with chances in proportion to the
rows' sizes, gives the quantile boundaries of many small ranges. Every range is
then weighed on all rows; one that holds over twice its share is sampled again
and subdivided. Running sums inside the ranges, on top of the sums of the
ranges before, place every row exactly: shard i takes the rows whose middle
byte lies in the i-th part of all bytes. Rows of equal texts are placed by the
middle byte of them all, whatever ranges they lie in, and so stay together,
unless they hold more than ``GROUP`` of a shard; then they are cut like other rows. So two shards differ
by a few hundredths at most, or one row's size (law ``bytes``), and slots count
the rows of a shard in key order.

Nulls: a null text has no bytes (checksum 0); a null id is kept. Rows that
repeat are rows of their own. Ties: rows of one key come in the order of id, size
and row number. An empty table gives an empty result. Columns of
the input named shard or slot are replaced where the operator adds its own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SHARDS = 8
#: Rows in a range on average, and the least and most ranges; samples drawn for each.
RANGE_ROWS, RANGES, DRAWS = 2000, (64, 8192), 16
#: A range of more than this many times its share is subdivided.
OVERFULL = 2.0
#: Largest share of a shard that rows of equal texts hold and still are kept together.
GROUP = 0.02
#: Bits of a key that do not come from the text, and those of them that do not come from the id.
LOW, LAST = 31, 16


def size_of(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def checksum(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def key_of(row: str, doc_id: str = "doc_id", text: str = "text") -> Column:
    some = lambda h, bits: h.bitwiseAND(F.lit((1 << bits) - 1))
    own = F.shiftleft(some(F.xxhash64(F.col(doc_id).cast("long"), F.lit(17)), LOW - LAST), LAST)
    return F.shiftleft(checksum(text), LOW).bitwiseOR(own).bitwiseOR(some(F.xxhash64(F.col(row), F.lit(23)), LAST))


def quantiles(keys: np.ndarray, weights: np.ndarray, parts: int) -> list[int]:
    """Keys that cut the weighted sample into ``parts`` of about equal weight."""
    if not len(keys) or parts < 2:
        return []
    order = np.argsort(keys, kind="stable")
    total = np.cumsum(weights[order])
    at = np.searchsorted(total, total[-1] * np.arange(1, parts) / parts)
    return [int(k) for k in keys[order][np.minimum(at, len(keys) - 1)]]


def place(bounds: list[int]):
    """Number of the range of a key: how many boundaries lie below it."""
    cuts = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def number(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(np.int64), side="left").astype(np.int32))

    return number


def splitters(slim: DataFrame, rows: int, total: int) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Boundaries of the ranges, and bytes and rows in each of them (8192 ranges at first, and their subdivisions)."""
    ranges = min(max(math.ceil(rows / RANGE_ROWS), RANGES[0]), RANGES[1])
    share = total / ranges

    def draw(of: DataFrame, turn: int, unit: float) -> tuple[np.ndarray, np.ndarray]:
        """A key for every ``unit`` bytes on average; rows larger than that are always drawn, with their weight."""
        u = F.shiftrightunsigned(F.xxhash64("key", "__row", F.lit(turn)), 11).cast("double") * F.lit(2.0**-53)
        got = of.where(u * F.lit(unit) < F.col("size")).select("key", F.greatest(F.col("size") / F.lit(unit), F.lit(1.0)).alias("w")).collect()
        return np.array([r["key"] for r in got], np.int64), np.array([r["w"] for r in got])

    keys, weights = draw(slim, 0, share / DRAWS)
    # Ranges end where a checksum ends, as long as they are not overfull.
    bounds = sorted({k | ((1 << LOW) - 1) for k in quantiles(keys, weights, ranges)})
    turn = 0
    while True:
        placed = slim.withColumn("range", place(bounds)("key"))
        weighed = {
            r["range"]: (r["bytes"], r["rows"])
            for r in placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        }
        full = [k for k, (b, _) in weighed.items() if b > OVERFULL * share]
        if not full:
            return bounds, weighed
        turn += 1
        keys, weights = draw(placed.where(F.col("range").isin(full)), turn, share / DRAWS)
        own = np.searchsorted(np.array(bounds, np.int64), keys, side="left")
        more = set()
        for k in full:
            mine = own == k
            more |= set(quantiles(keys[mine], weights[mine], math.ceil(weighed[k][0] / share) + 1))
        if more <= set(bounds):  # one key alone fills the range, or one large row
            return bounds, weighed
        bounds = sorted(set(bounds) | more)


def shards(docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """__row, doc_id, size, text_crc32, shard and slot for every row of ``docs`` (with the column __row, a number for each row)."""
    slim = saved(docs.select("__row", F.col("doc_id").cast("long").alias("doc_id"), size_of().alias("size"), key_of("__row").alias("key")))
    figures = slim.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    rows, total = figures["n"], figures["b"]
    bounds, weighed = splitters(slim, rows, total) if rows else ([], {})
    before, at, first = {}, 0, 0
    for k in sorted(weighed):
        before[k] = (at, first)
        at, first = at + weighed[k][0], first + weighed[k][1]
    spark = docs.sparkSession
    starts = spark.createDataFrame([(k, *v) for k, v in before.items()], "range int, __bytes long, __rows long")
    own = Window.partitionBy("range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "__row")
    alike = Window.partitionBy("range", "text_crc32")
    placed = saved(
        slim.withColumn("text_crc32", F.shiftright("key", LOW))
        .withColumn("range", place(bounds)("key"))
        .withColumn("__at", F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__nth", F.row_number().over(own))
        .withColumn("__from", F.min("__at").over(alike))
        .withColumn("__alike", F.sum("size").over(alike))
        .join(F.broadcast(starts), "range")
        .select("__row", "doc_id", "size", "text_crc32", (F.col("__bytes") + F.col("__at")).alias("at"), (F.col("__bytes") + F.col("__from")).alias("start"),
                F.col("__alike").alias("alike"), (F.col("__rows") + F.col("__nth") - 1).alias("rank"))
    )
    # Texts that a boundary cuts (fewer than there are boundaries) are weighed over all their ranges.
    cut = [(k >> LOW,) for k in bounds if k & ((1 << LOW) - 1) != (1 << LOW) - 1]
    torn = F.broadcast(spark.createDataFrame(sorted(set(cut)), "text_crc32 long"))
    parts = placed.join(torn, "text_crc32").groupBy("text_crc32").agg(F.min("start").alias("s"), F.sum("size").alias("a")).collect()
    whole = F.broadcast(spark.createDataFrame([tuple(r) for r in parts], "text_crc32 long, __s long, __a long"))
    start, extent = F.coalesce("__s", "start"), F.coalesce("__a", "alike")
    kept = extent <= GROUP * total / count
    twice = 2 * F.when(kept, start).otherwise(F.col("at")) + F.when(kept, extent).otherwise(F.col("size"))
    out = placed.join(whole, "text_crc32", "left").withColumn("shard", F.least(F.floor(twice * count / F.lit(2 * max(total, 1))), F.lit(count - 1)).cast("int"))
    heads = out.groupBy("shard").agg(F.min("rank").alias("__head")).collect()
    heads = F.broadcast(spark.createDataFrame([tuple(r) for r in heads], "shard int, __head long"))
    return out.join(heads, "shard").select("__row", "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("__head")).alias("slot"))


def shard_rows(docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of ``docs``."""
    rows = docs.select("doc_id", "text").withColumn("__row", F.monotonically_increasing_id())
    return shards(rows, count).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def sharded(docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """``docs`` with the columns shard and slot added."""
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    # Written with their numbers, which are then the same wherever they are read.
    rows = saved(docs.select(*names).withColumn("__row", F.monotonically_increasing_id()))
    places = shards(rows, count).select("__row", "shard", "slot")
    # One way at every size, as in the mix.
    return rows.join(saved(places).hint("merge"), "__row").select(*names, "shard", "slot")
