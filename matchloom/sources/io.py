"""Reading and writing registries, truth, indexes and results.

Everything that is read as text has no nulls afterwards: a missing value is the
empty string.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

REGISTRY = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")


def strings(names: tuple[str, ...]) -> ty.StructType:
    return ty.StructType([ty.StructField(n, ty.StringType()) for n in names])


def read_delimited(spark: SparkSession, path: str, columns: tuple[str, ...], sep: str = "\t") -> DataFrame:
    """All columns as strings, missing ones as empty. Columns are found by the header's names; fails if the header differs."""
    rows = (
        spark.read.option("sep", sep).option("header", True).option("quote", "" if sep == "\t" else '"').option("enforceSchema", False)
        .schema(strings(columns)).csv(path)
    )
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, REGISTRY)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, TRUTH)


def read_bundle(spark: SparkSession, folder: str, train: bool = True) -> dict[str, DataFrame]:
    """source1 to source3, and the truth for training."""
    names = {f"source{i}": f"{folder}/source{i}.tsv" for i in (1, 2, 3)}
    out = {n: read_registry(spark, p) for n, p in names.items()}
    return out | ({"truth": read_truth(spark, f"{folder}/ground_truth.tsv")} if train else {})


def read_splits(spark: SparkSession, path: str, ids: str | None = None) -> DataFrame:
    """id and split (train or val) of a split file, whatever it calls its columns."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    known = {c.lower(): c for c in rows.columns}
    id_column = ids or next(known[c] for c in ("entity_id", "source1_entity_id") if c in known)
    split = next(known[c] for c in ("split", "set", "partition") if c in known)
    name = F.lower(F.trim(split))
    return rows.select(F.col(id_column).alias("id"), F.when(name.isin("val", "valid", "validation", "dev"), "val").otherwise("train").alias("split"))


def write_delimited(rows: DataFrame, path: str, sep: str = "\t") -> None:
    rows.write.mode("overwrite").option("sep", sep).option("header", True).option("quote", "" if sep == "\t" else '"').option("emptyValue", "").csv(path)


def write_lists(rows: DataFrame, key: str, ids: str, path: str) -> None:
    """A key and its comma-separated ids, tab-separated with a header."""
    write_delimited(rows.select(key, ids), path)


def write_parquet(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """zstd Parquet, in folders by the columns ``by``; only folders that the rows touch are replaced."""
    writer = rows.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_parts(spark: SparkSession, pattern: str, base: str | None = None) -> DataFrame:
    """All Parquet files that a pattern such as ``pairs/*/*`` matches, as one table."""
    reader = spark.read.option("mergeSchema", False)
    return (reader.option("basePath", base) if base else reader).parquet(pattern)


def unfinished(keys: DataFrame, spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Those of ``keys`` that no row written at ``path`` has: what is left to do after a stop."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return keys.join(spark.read.parquet(path).select(*by).distinct(), by, "left_anti") if there else keys


def write_json(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)



def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Meta data and statistics as ``write_json`` leaves them; a field that is missing is null."""
    return spark.read.schema(schema).json(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path in the folder that driver and executors share (spark.checkpoint.dir); a local one on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="matchloom-")
    return f"{base.rstrip('/')}/matchloom/{uuid.uuid4().hex}"


def stored(rows: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """The same rows, written to the shared folder and read again (by the session ``spark``, if one is given): computed once, and a lost executor costs a reread."""
    path = shared_folder(rows.sparkSession)
    rows.write.option("compression", "zstd").parquet(path)
    return (spark or rows.sparkSession).read.schema(rows.schema).parquet(path)


def apart(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session on the same executors that has the settings of ``spark`` but for ``settings``, which no other plan sees."""
    other = spark.newSession()
    for name, value in (spark.conf.getAll | settings).items():
        if other.conf.isModifiable(name):
            other.conf.set(name, value)
    return other
