"""Relational glue: id lists, set operations on pairs, checked joins, samples, margins, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def explode_ids(rows: DataFrame, key: str, csv: str, into: str) -> DataFrame:
    """One row for each distinct id of a comma-separated list."""
    return rows.select(key, F.explode(F.array_distinct(T.id_list(csv))).alias(into))


def collapse_ids(all_keys: DataFrame, pairs: DataFrame, key: str, item: str, into: str, order: str | None = None) -> DataFrame:
    """A comma-separated list of each key's ids, the empty string for keys without any; first mention counts.

    ``order`` names the column by which ids are mentioned (default: the id itself).
    """
    rank = order or item
    first = pairs.groupBy(key, item).agg(F.min(rank).alias("__rank"))
    lists = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__rank", item))).alias("__l"))
    joined = all_keys.select(key).distinct().join(lists, key, "left")
    return joined.select(key, F.coalesce(F.array_join(F.transform("__l", lambda x: x[item].cast("string")), ","), F.lit("")).alias(into))


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails if a key repeats on either side or is missing on one."""
    for side in (left, right):
        if side.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"keys {keys} repeat")
    both = left.join(right, keys)
    if not left.count() == right.count() == both.count():
        raise ValueError(f"keys {keys} differ between the sides")
    return both


def lookup(rows: DataFrame, names: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    """``rows`` with ``value`` of the key, the default for keys that are missing."""
    return rows.join(names.select(key, value).dropDuplicates([key]), key, "left").fillna({value: default})


def check_subset(part: DataFrame, whole: DataFrame, keys: list[str]) -> None:
    """Raises if a pair of ``part`` is not in ``whole``."""
    if part.join(whole, keys, "left_anti").limit(1).count():
        raise ValueError("matches that are no candidates")


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows that depend on nothing but the keys and the seed."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def crosstab(rows: DataFrame, down: str, across: str, values: list[str]) -> DataFrame:
    """Counts of ``across`` by ``down`` with margins, one column per value and ``All``."""
    cube = rows.groupBy(F.coalesce(F.col(down), F.lit("")).alias(down), across).count()
    table = cube.groupBy(down).pivot(across, values).agg(F.sum("count"))
    total = cube.groupBy(F.lit("All").alias(down)).pivot(across, values).agg(F.sum("count"))
    filled = table.union(total.select(table.columns)).fillna(0, values)
    return filled.withColumn("All", sum((F.col(v) for v in values[1:]), F.col(values[0])))


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: rows, nulls, empty strings, distinct values and repeats."""
    one = rows.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("column").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("v").isNull()).alias("nulls"),
        F.count_if(F.col("v") == "").alias("empty"),
        F.countDistinct("v").alias("distinct_values"),
        (F.count("v") - F.countDistinct("v")).alias("repeats"),
    )


def describe(rows: DataFrame, value: Column, by: list[str], points: dict[str, float]) -> DataFrame:
    """Count, mean, least, largest and exact percentiles (linear between ranks) of a value by group."""
    named = rows.withColumn("__v", value.cast("double"))
    return named.groupBy(*by).agg(
        F.count("__v").alias("n"),
        F.round(F.avg("__v"), 6).alias("mean"),
        F.min("__v").alias("least"),
        F.max("__v").alias("largest"),
        *[F.round(F.percentile("__v", p), 6).alias(name) for name, p in points.items()],
    )


def missing_columns(rows: DataFrame, expected: list[str]) -> tuple[list[str], list[str]]:
    """Columns that are expected but missing, and those that are not expected."""
    return sorted(set(expected) - set(rows.columns)), sorted(set(rows.columns) - set(expected))


def truth_problems(truth: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts of links (left_id, right_id) whose ends are unknown or that repeat."""
    known_left, known_right = left.select("left_id").distinct(), right.select("right_id").distinct()
    counts = [
        truth.join(known_left, "left_id", "left_anti").agg(F.lit("unknown left").alias("problem"), F.count("*").alias("links")),
        truth.join(known_right, "right_id", "left_anti").agg(F.lit("unknown right").alias("problem"), F.count("*").alias("links")),
        truth.groupBy("left_id", "right_id").count().where("count > 1").agg(F.lit("repeated").alias("problem"), F.count("*").alias("links")),
    ]
    return counts[0].union(counts[1]).union(counts[2])
