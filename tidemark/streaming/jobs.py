"""Structured Streaming forms of the same steps."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import parse
from tidemark.operators.audit import gap_runs
from tidemark.operators.scan import offset_bucket
from tidemark.session import stored
from tidemark.streaming.batches import commit, each_batch, read_committed
from tidemark.streaming.labelling import label_stream, read_labels  # noqa: F401

GRACE = "10 minutes"


def without_copies(stream: DataFrame, key: str = "meta_id", time: str = "dt", delay: str = GRACE) -> DataFrame:
    """Drop repeated events. The memory is bounded by event time and survives restarts."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, time: str, width: str, delay: str = GRACE, slide: str | None = None, **conditions: Column) -> DataFrame:
    """(window_start, all, <conditions>) per tumbling or sliding window, emitted once closed."""
    frame = F.window(time, width, slide) if slide else F.window(time, width)
    figures = [F.count("*").alias("all"), *[F.count_if(c).alias(n) for n, c in conditions.items()]]
    return stream.withWatermark(time, delay).groupBy(frame).agg(*figures).select(
        F.col("window.start").alias("window_start"), "all", *conditions
    )


def missing_minutes(per_minute: DataFrame, seconds: int = 60) -> DataFrame:
    """Runs of minutes without any event, from closed minute counts: (gap_from, gap_to)."""
    minutes = per_minute.select((F.unix_seconds("window_start") / seconds).cast("bigint").alias("offset"))
    runs = gap_runs(minutes)
    return runs.select(
        F.timestamp_seconds(F.col("gap_from") * seconds).alias("gap_from"),
        F.timestamp_seconds((F.col("gap_to") + 1) * seconds).alias("gap_to"),
    )


def to_table(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Drain what is there into Parquet, exactly once, and stop. Run again to resume."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start(path)


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """``to_table`` to the end, then the table."""
    query = to_table(stream, path, checkpoint)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


READABLE = "offset BIGINT, meta_id STRING, stream STRING, dt TIMESTAMP, value STRING"
DEAD = "key STRING, reason STRING, source_offset BIGINT, raw STRING"


def split_sink(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Readable events and dead letters of one raw stream to ``folder/readable`` and ``folder/dead``.

    Both parts of a batch become visible together, when it is committed; see :func:`read_split`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse.parse(batch).persist()
        try:
            good = parse.readable(parsed).select(*[c.split()[0] for c in READABLE.split(", ")])
            good.write.mode("overwrite").parquet(f"{folder}/readable/batch={batch_id}")
            parse.dead_letters(parsed).write.mode("overwrite").parquet(f"{folder}/dead/batch={batch_id}")
        finally:
            parsed.unpersist()
        commit(batch.sparkSession, f"{folder}/manifest", batch_id)

    return each_batch(stream, checkpoint, write)


def read_split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Readable events and dead letters of all committed batches."""
    return tuple(read_committed(spark, f"{folder}/{part}", f"{folder}/manifest", schema) for part, schema in (("readable", READABLE), ("dead", DEAD)))


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str = "source_offset") -> StreamingQuery:
    """Append only rows whose source offset the table does not hold yet, one for each offset.

    For tables also fed by replays, where a checkpoint alone does not know what exists. The
    table is partitioned by runs of offsets (``<key>_run``); a batch reads only the runs
    that its own offsets fall into.
    """
    run = f"{key}_run"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        fresh = stored(parse.first_by_key(batch, key, key).withColumn(run, offset_bucket(F.col(key))), "fresh")
        lo, hi = fresh.agg(F.min(run), F.max(run)).first()
        if lo is None:
            return
        try:
            table = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            seen = table.where(F.col(run).between(lo, hi)).select(key)
            # Materialised first: the plan reads the table it appends to.
            fresh = stored(fresh.join(seen, key, "left_anti"), "fresh")
        fresh.write.mode("append").partitionBy(run).parquet(path)

    return each_batch(stream, checkpoint, write)
