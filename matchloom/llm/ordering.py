"""Running sums over a whole table in an order, without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved


def running_sums(rows: DataFrame, order: list[str | Column], sums: dict[str, str], parts: int) -> DataFrame:
    """``rows`` with the sum of each expression over all rows before this one, in the order given.

    ``sums`` maps new columns to expressions of whole numbers. The rows are range-partitioned by the order and
    written; each partition adds up its own rows, and the partitions' totals (``parts`` rows at most) are carried over.
    """
    names = rows.columns
    ranged = saved(
        rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    )
    totals = ranged.groupBy("__part").agg(*[F.sum(F.expr(e)).alias(f"__t_{c}") for c, e in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("__part", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in sums])
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = ranged.select("*", *[F.coalesce(F.sum(F.expr(e)).over(own), F.lit(0)).alias(f"__o_{c}") for c, e in sums.items()])
    return added.join(F.broadcast(carried), "__part").select(
        *names, *[(F.col(f"__o_{c}") + F.col(f"__b_{c}")).alias(c) for c in sums]
    )
