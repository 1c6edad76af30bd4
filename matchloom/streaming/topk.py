"""Top-k candidates of a stream of scored pairs.

The state is each query's best ``k`` pairs. Merging keeps a pair's larger score
and cuts to ``k``; this is associative and commutative, so the state after a
stream equals the batch result, however the stream was cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.retrieval import merge_top_k

SCHEMA = "q_id string, c_id string, score double"


class TopKTable:
    """A table of best pairs in a folder that all machines share: a version for each micro-batch, written under its number.

    A batch starts from the newest whole version before it. So a batch that is repeated after a stop gives the same
    version again, and a new object on the same folder goes on where the last one ended. Two versions are kept.
    """

    def __init__(self, path: str, k: int):
        self.path, self.k = path.rstrip("/"), k

    def folder(self, spark):
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self, spark) -> list[int]:
        """Numbers of the versions written to their end, in order."""
        root, files = self.folder(spark)
        if not files.exists(root):
            return []
        whole = spark._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in files.listStatus(root)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName()[1:].isdigit() and files.exists(whole(p, "_SUCCESS")))

    def read(self, spark, before: int | None = None) -> DataFrame:
        numbers = [n for n in self.versions(spark) if before is None or n < before]
        return spark.read.schema(SCHEMA).parquet(f"{self.path}/v{numbers[-1]}") if numbers else spark.createDataFrame([], SCHEMA)

    def merge(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        merge_top_k(self.read(spark, number), batch, self.k).write.mode("overwrite").parquet(f"{self.path}/v{number}")
        _, files = self.folder(spark)
        for old in self.versions(spark)[:-2]:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}"), True)

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stateful_top_k(stream: DataFrame, k: int) -> DataFrame:
    """The same with state kept per query by the engine: emits a query's best pairs whenever they change."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best: dict[str, float] = dict(zip(*state.get, strict=True)) if state.exists else {}
        for rows in batches:
            for c, s in zip(rows.c_id, rows.score, strict=True):
                best[c] = max(s, best.get(c, s))
        kept = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        state.update(([c for c, _ in kept], [s for _, s in kept]))
        yield pd.DataFrame({"q_id": [key[0]] * len(kept), "c_id": [c for c, _ in kept], "score": [s for _, s in kept]})

    return stream.groupBy("q_id").applyInPandasWithState(step, SCHEMA, "ids array<string>, scores array<double>", "update", "NoTimeout")
