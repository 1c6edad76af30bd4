"""Mixing sources to target weights by pivotal dependent rounding.

Every row of a source is to be taken the same number of times on average, its
source's target over its source's size. The whole part is given to every row;
the fractions are rounded dependently: two rows meet, and words are moved from
one to the other, at random in either direction with chances that keep both
expectations, until one of them is integral. That row is settled; the other
meets the next one. Words are moved, not copies, so a source's taken words
stay at its target but for its very last row. Groups of bounded size settle
their own rows and hand one open row each to the next level, as a reduction
tree: a level has a fixed share of the groups of the level before, whatever a
source's share of the rows is. Rows are numbered in the order of text and id, and
dealt to groups by a hash of that number, so rows that repeat are spread like any
others, and the rows of a group are around ``FANIN``.

Random numbers are hashes of a seed, the rows' keys and their numbers, so reruns
agree. Ties: rows that agree in id, text and source are interchangeable.
Everything here is DataFrame operations.

Nulls: a null text has no words and is never taken; a null source is a source
of its own, after all others. A null id is kept. Rows that repeat are rows of
their own. Empty tables give empty results; with no words at all the targets
are zero. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, SPACE, row_key, saved
from .ordering import running_sums

WEIGHTS = (1, 2, 3)
MOST = 3
#: Rows that meet in one group of the reduction tree, on average.
FANIN = 64
#: Parts into which the rows of a source are dealt for joins with its figures.
SALTS = 32
SEED = 20240817


def words(text: str) -> Column:
    """Number of words of a text column, 0 for null."""
    inner = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, f"{SPACE}+"))).cast("long")


def targets(sizes: DataFrame, parts: int = 8) -> DataFrame:
    """source, source_size, target for a table of sources (source, source_size).

    Shares go by weight; where a share exceeds ``MOST`` times the source's size it stops there, and the excess is
    shared again. Sources in the order of their ceilings per weight: those at their ceiling come first, and the level
    of the rest follows from running sums.
    """
    ranked = running_sums(sizes, [F.col("source").asc_nulls_last()], {"rank": "1L"}, parts)
    weighed = ranked.select("source", "source_size", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long").alias("w"))
    whole = saved(weighed.withColumn("ratio", MOST * F.col("source_size") / F.col("w")))
    order = [F.col("ratio"), F.col("source").asc_nulls_last()]
    summed = running_sums(whole, order, {"size_before": "source_size", "w_before": "w"}, parts)
    total = whole.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    # The level if exactly the sources before this one are at their ceilings; it holds from the first whose ratio is not below it.
    level = (F.lit(total["size"] or 0) - MOST * F.col("size_before")) / (F.lit(total["w"] or 0) - F.col("w_before"))
    held = summed.withColumn("level", level).where("ratio >= level").agg(F.min(F.struct("ratio", "level")).alias("h")).first()
    share = F.col("w") * F.lit(held["h"]["level"] if held["h"] else 0.0)
    return whole.select("source", "source_size", F.least((MOST * F.col("source_size")).cast("double"), share).alias("target"))


def chance(*keys: Column) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *keys), 11)).cast("double") * F.lit(2.0**-53)


def settle(rows: DataFrame, group: list[str], last: bool) -> DataFrame:
    """One level: rows (source, key1, key2, key3, size, p, ...) of each group meet in turn; result has ``open`` on the row left over."""
    item = F.struct("size", "key1", "key2", "key3", "p", "row", "doc_id", "base", "source_size", "target")
    ordered = F.reverse(F.array_sort(F.collect_list(item)))  # large ones first, so that a small one is left over
    kind = "struct<size:bigint,key1:bigint,key2:bigint,key3:bigint,p:double,row:bigint,doc_id:bigint,base:bigint,source_size:bigint,target:double>"

    def meet(state: Column, x: Column) -> Column:
        a, done = state["held"], state["done"]
        up = F.least((1 - a["p"]) * a["size"], x["p"] * x["size"])  # words that a could gain
        down = F.least((1 - x["p"]) * x["size"], a["p"] * a["size"])  # words that x could gain
        gain = chance(a["key1"], a["key2"], a["key3"], x["key1"], x["key2"], x["key3"]) * (up + down) < down
        full_a = (1 - a["p"]) * a["size"] <= x["p"] * x["size"]
        full_x = (1 - x["p"]) * x["size"] <= a["p"] * a["size"]
        put = lambda row, p: row.withField("p", p)
        settled = F.when(gain, F.when(full_a, put(a, F.lit(1.0))).otherwise(put(x, F.lit(0.0)))).otherwise(
            F.when(full_x, put(x, F.lit(1.0))).otherwise(put(a, F.lit(0.0)))
        )
        held = F.when(
            gain,
            F.when(full_a, put(x, F.greatest(x["p"] - up / x["size"], F.lit(0.0)))).otherwise(put(a, F.least(a["p"] + up / a["size"], F.lit(1.0)))),
        ).otherwise(
            F.when(full_x, put(a, F.greatest(a["p"] - down / a["size"], F.lit(0.0)))).otherwise(put(x, F.least(x["p"] + down / x["size"], F.lit(1.0))))
        )
        first = a.isNull()
        return F.struct(
            F.when(first, x).otherwise(held).cast(kind).alias("held"),
            F.when(first, done).otherwise(F.array_append(done, settled.cast(kind))).cast(f"array<{kind}>").alias("done"),
        )

    start = F.struct(F.lit(None).cast(kind).alias("held"), F.array().cast(f"array<{kind}>").alias("done"))
    end = rows.groupBy(*group).agg(ordered.alias("items")).select(*group, F.aggregate("items", start, meet).alias("s"))
    left = F.col("s.held")
    if last:
        won = (chance(left["key1"], left["key2"], left["key3"]) < left["p"]).cast("double")
        both = F.array_append(F.col("s.done"), left.withField("p", won).cast(kind))
        return end.select("source", "bucket", F.explode(both).alias("x"), F.lit(False).alias("open"))
    tagged = F.concat(
        F.transform("s.done", lambda x: F.struct(x.alias("x"), F.lit(False).alias("open"))),
        F.array(F.struct(left.alias("x"), F.lit(True).alias("open"))),
    )
    return end.select("source", "bucket", F.explode(tagged).alias("y")).select("source", "bucket", "y.x", "y.open")


def _mixture(docs: DataFrame, fanin: int) -> DataFrame:
    """As ``mixture``, with the column __row of ``docs`` carried along."""
    rows = saved(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words("text").alias("size"), *row_key(), "__row")
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The place of a row among all rows; rows that agree in everything else come in any order.
    numbered = running_sums(rows, ["__k1", "__k2", F.col("source").asc_nulls_first(), "__row"], {"__n": "1L"}, parts)
    figures = targets(saved(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    # Equal keys on both sides with a salt, so that a source with most of the rows is dealt to many tasks.
    salted = numbered.withColumn("__salt", F.pmod("__n", F.lit(SALTS)))
    wide = figures.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).withColumnRenamed("source", "__s")
    joined = salted.join(wide, (F.col("source").eqNullSafe(F.col("__s"))) & (salted["__salt"] == wide["__salt"])).drop(salted["__salt"]).drop("__salt", "__s")
    copies = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    given = saved(joined.withColumn("__c", copies).withColumn("base", F.floor("__c")).withColumn("p", F.col("__c") - F.col("base")))
    result = lambda p: [
        "doc_id", "source", "size", "source_size", "target", ((F.col("base") + p) * F.col("size")).cast("long").alias("taken"), "__row",
    ]
    out = [given.where("p = 0").select(*result(F.lit(0)))]
    buckets = max(1, math.ceil(given.count() / fanin))
    level = given.where("p > 0").select(
        "source", F.col("__k1").alias("key1"), F.col("__k2").alias("key2"), F.col("__n").alias("key3"), "size", "p", F.col("__row").alias("row"),
        "doc_id", "base", "source_size", "target", F.pmod(F.xxhash64("__n", F.lit(SEED)), F.lit(buckets)).alias("bucket"),
    )
    while True:
        met = saved(settle(level, ["source", "bucket"], buckets == 1))
        flat = met.select("source", "bucket", "x.*", "open")
        out.append(flat.where("not open").withColumn("__row", F.col("row")).select(*result(F.col("p").cast("long"))))
        if buckets == 1:
            break
        buckets = math.ceil(buckets / fanin)
        level = flat.where("open").drop("open").withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
    whole = out[0]
    for part in out[1:]:
        whole = whole.union(part)
    return whole


def mixture(docs: DataFrame, fanin: int = FANIN) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for every row of ``docs``."""
    return _mixture(docs.select("doc_id", "source", "text").withColumn("__row", F.monotonically_increasing_id()), fanin).drop("__row")


def mixed(docs: DataFrame, fanin: int = FANIN) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns as they were."""
    names = docs.columns
    # Written with their numbers, which are then the same wherever they are read.
    rows = saved(docs.withColumn("__row", F.monotonically_increasing_id()))
    times = (F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    taken = saved(_mixture(rows, fanin).select("__row", times.alias("__times")).where("__times > 0"))
    # One way at every size: the texts are dealt out by their numbers, however few rows the other side has.
    return rows.join(taken.hint("merge"), "__row").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(names)
