"""The star-schema tables in the roles of registries and truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import registry
from ..sources.io import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.replace("n_name", F.lit("_"), F.lit(" ")).alias("place"), F.col("r_name").alias("country"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source 1: a record for every customer."""
    rows = table(spark, sf_dir, "customer").join(places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    number = F.floor("c_acctbal").cast("string")
    return rows.select(
        F.concat(F.lit("S1-"), "c_custkey").alias("entity_id"), F.col("c_name").alias("business_name"),
        F.concat_ws(" ", number, "place", "c_mktsegment").alias("business_address"), "country",
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source 2: a record for every supplier."""
    rows = table(spark, sf_dir, "supplier").join(places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    number = F.floor("s_acctbal").cast("string")
    return rows.select(
        F.concat(F.lit("S2-"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("business_name"),
        F.concat_ws(" ", number, "place").alias("business_address"), "country",
    )


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both registries, normalized once and written, as every channel and what follows reads them several times.

    Source rows are dealt out before they are normalized: a small file is read by one task or two.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left, right = (stored(registry(rows(spark, sf_dir).repartition(parts, "entity_id"))) for rows in (customers, suppliers))
    return left, right


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links (q_id, c_id): equal keys of one region, or one nation and balances less than 25 apart."""
    c = table(spark, sf_dir, "customer").join(places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    s = table(spark, sf_dir, "supplier").join(places(spark, sf_dir).select("n_nationkey", F.col("country").alias("there")), F.col("s_nationkey") == F.col("n_nationkey"))
    ids = [F.concat(F.lit("S1-"), "c_custkey").alias("q_id"), F.concat(F.lit("S2-"), "s_suppkey").alias("c_id")]
    same = c.join(s, F.col("c_custkey") == F.col("s_suppkey")).where("country = there").select(*ids)
    near = c.join(s, F.col("c_nationkey") == F.col("s_nationkey")).where("abs(c_acctbal - s_acctbal) < 25").select(*ids)
    return same.union(near).distinct()


def truth_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source1_entity_id and matched_entity_ids, as a truth file has them."""
    from ..operators.relational import collapse_ids

    every = customers(spark, sf_dir).select(F.col("entity_id").alias("q_id"))
    return collapse_ids(every, truth(spark, sf_dir), "q_id", "c_id", "matched_entity_ids").withColumnRenamed("q_id", "source1_entity_id")
