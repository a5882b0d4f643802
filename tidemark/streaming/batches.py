"""Micro-batches written as folders that readers see only once they are committed.

A batch may break between two writes. So its rows go to folders of its own, and its
row in the manifest is written last. Readers take the folders that the manifest lists; what
a broken batch left behind is overwritten by its retry and never seen before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def each_batch(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Drain through a function of (batch, batch id)."""
    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    store, path = _path(spark, folder)
    return store.exists(path)


def delete(spark: SparkSession, folder: str) -> None:
    store, path = _path(spark, folder)
    store.delete(path, True)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    store, path = _path(spark, folder)
    return [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []


MANIFEST = "counts MAP<STRING, BIGINT>"


def commit(spark: SparkSession, manifest: str, batch_id: int, **counts: int) -> None:
    """List a batch: from here on readers see its folders. A retry lists it anew."""
    spark.createDataFrame([(counts,)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{manifest}/batch={batch_id}")


def committed(spark: SparkSession, manifest: str) -> DataFrame:
    """(batch, counts) of the listed batches."""
    if not exists(spark, manifest):
        return spark.createDataFrame([], f"{MANIFEST}, batch BIGINT")
    return spark.read.schema(f"{MANIFEST}, batch BIGINT").parquet(manifest)


def read_committed(spark: SparkSession, folder: str, manifest: str, schema: str) -> DataFrame:
    """The rows of ``folder/batch=N`` of the listed batches only."""
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch BIGINT").parquet(folder)
    return rows.join(committed(spark, manifest).select("batch"), "batch", "left_semi").drop("batch")
