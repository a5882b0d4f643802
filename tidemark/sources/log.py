"""The raw log: captures, Kafka topics, replay slices, and keyed sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How far past the end of a replay window a topic must be read, since events
# arrive slightly out of order.
REPLAY_PADDING_SECONDS = 120
RAW_SCHEMA = "offset BIGINT, value STRING"


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as raw payloads; blank lines skipped. ``path`` may be a glob."""
    return spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))


def kafka_options(brokers: str, topics: list[str], **extra: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": brokers, "subscribe": ",".join(topics), **extra}


def _from_kafka(df: DataFrame) -> DataFrame:
    return df.select(
        "topic",
        "partition",
        "offset",
        F.col("key").cast("string").alias("id"),
        F.col("value").cast("string").alias("value"),
        F.col("timestamp").alias("arrived"),
    )


def read_topic(
    spark: SparkSession, brokers: str, topics: list[str], since_ms: int | None = None, until_ms: int | None = None
) -> DataFrame:
    """Bounded read of whole topics, or of the part that can hold a replay window."""
    extra = {"startingOffsets": "earliest", "endingOffsets": "latest"}
    if since_ms is not None:
        extra = {"startingTimestamp": str(since_ms), "startingOffsetsByTimestampStrategy": "latest"}
    if until_ms is not None:
        extra["endingTimestamp"] = str(until_ms + REPLAY_PADDING_SECONDS * 1000)
    return _from_kafka(spark.read.format("kafka").options(**kafka_options(brokers, topics, **extra)).load())


def read_topic_offsets(spark: SparkSession, brokers: str, topic: str, first: int, last: int, partition: int = 0) -> DataFrame:
    """Offsets first..last, both included."""
    at = lambda n: f'{{"{topic}":{{"{partition}":{n}}}}}'
    extra = {"startingOffsets": at(first), "endingOffsets": at(last + 1)}
    return _from_kafka(spark.read.format("kafka").options(**kafka_options(brokers, [topic], **extra)).load())


def stream_topic(spark: SparkSession, brokers: str, topics: list[str], per_batch: int = 1_000_000) -> DataFrame:
    """Unbounded read; ``per_batch`` bounds the intake of one micro-batch."""
    extra = {"startingOffsets": "earliest", "maxOffsetsPerTrigger": str(per_batch), "failOnDataLoss": "true"}
    return _from_kafka(spark.readStream.format("kafka").options(**kafka_options(brokers, topics, **extra)).load())


def stream_files(spark: SparkSession, folder: str, schema: str, fmt: str = "json", per_batch: int = 1, glob: str | None = None) -> DataFrame:
    """Files landing in a folder, a bounded number per micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder)


def in_window(df: DataFrame, since: Column, until: Column, time: str = "dt") -> DataFrame:
    """Replay window by event time: since <= time < until."""
    return df.where((F.col(time) >= since) & (F.col(time) < until))


def in_offsets(df: DataFrame, first: int | Column, last: int | Column) -> DataFrame:
    """Replay range by offset, both ends included."""
    return df.where(F.col("offset").between(first, last))


def tail(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` offsets of each partition.

    Offsets of a partition are dense, so its high mark decides; no partition is
    sorted. The high marks are one row per log partition; Spark's size check decides on a broadcast.
    """
    high = df.groupBy("partition").agg(F.max("offset").alias("__high"))
    return df.join(high, "partition").where(F.col("offset") > F.col("__high") - n).drop("__high")


def last_per_partition(df: DataFrame) -> DataFrame:
    row = F.struct(*df.columns)
    return df.groupBy("partition").agg(F.max_by(row, "offset").alias("__row")).select("__row.*")


def resume_point(written: DataFrame, partitions: int) -> DataFrame:
    """The source offset below which everything is known to be written.

    The smallest of the partitions' last source offsets, and NULL while any
    partition has none.
    """
    last = written.groupBy("partition").agg(F.max("source_offset").alias("last"))
    return last.agg(
        F.when(F.count("last") >= partitions, F.min("last")).alias("resume_offset"),
        F.count("last").alias("partitions_seen"),
    )


def keyed(df: DataFrame, key: str = "rev_id") -> DataFrame:
    """(key, value) for a Kafka sink: readers drop repeats by key."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def spread(df: DataFrame, partitions: int, key: str = "rev_id") -> DataFrame:
    """Spread a table over as many partitions as the topic it goes to has, by key."""
    return df.repartition(partitions, key)
