"""Replay of landed captures by event time, through an index of what each file can hold.

The index has one row for each capture file: how many rows, and the range of their offsets and event
times. Disorder in the log makes the ranges of neighbouring files overlap, and that is all it does: a
window opens the files whose range meets it, and files that landed since the index was last brought up to date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.log import RAW_SCHEMA, REPLAY_PADDING_SECONDS, in_window
from tidemark.streaming.batches import exists

INDEX = "file STRING, bytes BIGINT, rows BIGINT, min_offset BIGINT, max_offset BIGINT, min_dt TIMESTAMP, max_dt TIMESTAMP"


def event_time(value: Column) -> Column:
    """Event time of a payload, NULL where it cannot be read."""
    return F.try_to_timestamp(F.try_variant_get(F.try_parse_json(value), "$.meta.dt", "string"))


def capture_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of a capture folder; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """The index as it stands; empty before the first :func:`index_captures`."""
    if not exists(spark, index):
        return spark.createDataFrame([], INDEX)
    # A file that was indexed twice, by two writers at once, stands once.
    return spark.read.schema(INDEX).parquet(index).dropDuplicates(["file"])


def index_captures(spark: SparkSession, folder: str, index: str) -> DataFrame:
    """Add the files of ``folder`` that the index does not know, and return it. Each file is read once in its life.

    Payloads without a readable event time count as rows and widen no range: no window asks for them.
    """
    new = _unknown(spark, folder, index)
    if new:
        rows = spark.read.schema(RAW_SCHEMA).json(new).select("offset", event_time(F.col("value")).alias("dt"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        found = rows.groupBy("file", "bytes").agg(
            F.count(F.lit(1)).alias("rows"), F.min("offset").alias("min_offset"), F.max("offset").alias("max_offset"), F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt")
        )
        # A file without rows gives none; its name is kept so that it is not opened again.
        listed = capture_files(spark, folder).where(F.col("file").isin(new)) if len(new) <= 1000 else capture_files(spark, folder)
        whole = listed.join(found.drop("bytes"), "file", "left").na.fill(0, ["rows"])
        known = read_index(spark, index).select("file")
        whole.join(known, "file", "left_anti").coalesce(1).write.mode("append").parquet(index)
    return read_index(spark, index)


def _unknown(spark: SparkSession, folder: str, index: str) -> list[str]:
    """Files that landed since. Names only, as many as have landed."""
    known = read_index(spark, index).select("file")
    return [r.file for r in capture_files(spark, folder).select("file").join(known, "file", "left_anti").orderBy("file").collect()]


def files_of_window(spark: SparkSession, folder: str, index: str, since: str, until: str) -> list[str]:
    """The files that can hold an event of [since, until): by the index, and those it does not know."""
    at = lambda s: F.lit(s).cast("timestamp")
    held = read_index(spark, index).where((F.col("max_dt") >= at(since)) & (F.col("min_dt") < at(until)))
    return [r.file for r in held.select("file").orderBy("file").collect()] + _unknown(spark, folder, index)


def replay(spark: SparkSession, folder: str, index: str, since: str, until: str) -> DataFrame:
    """(offset, value, dt) of the raw events with since <= event time < until, from the files that can hold them."""
    files = files_of_window(spark, folder, index, since, until)
    if not files:
        return spark.createDataFrame([], f"{RAW_SCHEMA}, dt TIMESTAMP")
    at = lambda s: F.lit(s).cast("timestamp")
    rows = spark.read.schema(RAW_SCHEMA).json(files).withColumn("dt", event_time(F.col("value")))
    return in_window(rows, at(since), at(until))


def replay_offsets(spark: SparkSession, folder: str, index: str, first: int, last: int) -> DataFrame:
    """(offset, value) of the offsets first..last, both included, from the files that can hold them."""
    held = read_index(spark, index).where((F.col("max_offset") >= first) & (F.col("min_offset") <= last))
    files = [r.file for r in held.select("file").orderBy("file").collect()] + _unknown(spark, folder, index)
    if not files:
        return spark.createDataFrame([], RAW_SCHEMA)
    return spark.read.schema(RAW_SCHEMA).json(files).where(F.col("offset").between(first, last))


def is_complete(index: DataFrame, until: str, padding_seconds: int = REPLAY_PADDING_SECONDS) -> Column:
    """Whether the log has passed the end of a window by the padding, so that stragglers have landed.

    A single-row value; an empty index has passed nothing.
    """
    end = F.lit(until).cast("timestamp") + F.expr(f"INTERVAL {padding_seconds} SECONDS")
    return index.agg(F.coalesce(F.max("max_dt") >= end, F.lit(False))).scalar()
