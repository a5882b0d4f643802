"""What running streams report about themselves, kept as a table of one row for each micro-batch.

A listener files every progress report as it comes. Read back, the reports give the counters of
a stage (rows read, written, skipped, and too late for their window), and the lag of a consumer: what its
source held and what it had committed at the end of each batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidemark.operators.audit import observed
from tidemark.operators.scan import running

READ, WRITTEN = "read", "written"
_REPORT = (
    "id STRING, runId STRING, name STRING, batchId BIGINT, timestamp STRING, numInputRows BIGINT, "
    "durationMs MAP<STRING, BIGINT>, eventTime MAP<STRING, STRING>, "
    "stateOperators ARRAY<STRUCT<operatorName: STRING, numRowsTotal: BIGINT, numRowsDroppedByWatermark: BIGINT>>, "
    "sources ARRAY<STRUCT<description: STRING, startOffset: STRING, endOffset: STRING, latestOffset: STRING, numInputRows: BIGINT>>, "
    "observedMetrics MAP<STRING, MAP<STRING, BIGINT>>"
)
#: Partition offsets of a topic source, such as {"edits": {"0": 12, "1": 7}}.
_TOPICS = "MAP<STRING, MAP<STRING, BIGINT>>"
DAY_SECONDS = 86_400


class ProgressLog(StreamingQueryListener):
    """Files the progress reports of queries below ``folder``, one small file for each batch.

    A report is filed under its run and batch, so one that comes twice stands once. ``query`` limits the
    log to one query's name. Use as a context: reports that are on their way are waited for.
    """

    def __init__(self, spark: SparkSession, folder: str, query: str | None = None):
        self.spark, self.folder, self.query = spark, folder, query
        self.ended: set[str] = set()

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        # Reports reach a listener through Spark's own queue, after the query that caused them.
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        report = event.progress
        if self.query is None or report.name == self.query:
            self._file(f"{report.runId}-{report.batchId}.json", report.json)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def _file(self, name: str, text: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        store = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = store.create(path, True)
        try:
            out.write(bytearray(" ".join(text.split("\n")).encode()))
        finally:
            out.close()


def reports_of(query: StreamingQuery) -> list[str]:
    """The last reports of a query as JSON, as many as Spark keeps, for queries nobody listened to."""
    return [" ".join(p.json.split("\n")) for p in query.recentProgress]


def parsed_reports(json: DataFrame) -> DataFrame:
    """Reports (column ``value``) as (query, run, batch, started, ended, rows, late, watermark, sources, observed).

    ``late`` counts rows that a stateful operator dropped as older than the watermark, summed over operators.
    """
    r = F.from_json("value", _REPORT)
    c = F.col("r")
    started = F.to_timestamp(c["timestamp"])
    return json.select(r.alias("r")).where(c["batchId"].isNotNull()).select(
        F.coalesce(c["name"], c["id"]).alias("query"),
        c["runId"].alias("run"),
        c["batchId"].alias("batch"),
        started.alias("started"),
        F.timestamp_micros(F.unix_micros(started) + F.coalesce(c["durationMs"]["triggerExecution"], F.lit(0)) * 1000).alias("ended"),
        c["numInputRows"].alias("rows"),
        F.aggregate(c["stateOperators"], F.lit(0).cast("bigint"), lambda n, o: n + F.coalesce(o["numRowsDroppedByWatermark"], F.lit(0))).alias("late"),
        F.to_timestamp(c["eventTime"]["watermark"]).alias("watermark"),
        c["sources"].alias("sources"),
        c["observedMetrics"].alias("observed"),
    )


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    return parsed_reports(spark.read.text(folder))


def count_read(stream: DataFrame) -> DataFrame:
    """Mark what enters a stage; see :func:`stage_counts`."""
    return observed(stream, READ)


def count_written(stream: DataFrame) -> DataFrame:
    """Mark what leaves a stage."""
    return observed(stream, WRITTEN)


def stage_counts(progress: DataFrame) -> DataFrame:
    """(query, batch, read, written, skipped, late) for each batch with rows, of a stage between the two marks.

    A batch without rows only moves time. Of a batch that was tried twice the last run counts.
    """
    read, written = F.col("observed")[READ]["rows"], F.col("observed")[WRITTEN]["rows"]
    last = F.max_by(F.struct("rows", "late", read.alias("read"), written.alias("written")), "started").alias("r")
    found = progress.groupBy("query", "batch").agg(last).where("r.rows > 0")
    written = F.coalesce("r.written", F.lit(0))
    return found.select("query", "batch", F.col("r.read").alias("read"), written.alias("written"), (F.col("r.read") - written - F.col("r.late")).alias("skipped"), F.col("r.late").alias("late"))


def late_rows(progress: DataFrame) -> DataFrame:
    """(query, batch, rows, late): rows of each batch, and those of them too late for any state."""
    last = F.max_by(F.struct("rows", "late"), "started").alias("r")
    return progress.groupBy("query", "batch").agg(last).where("r.rows > 0").select("query", "batch", "r.rows", "r.late")


def _total(offsets: Column) -> Column:
    """Sum of a topic source's partition offsets."""
    by_topic = F.map_values(F.from_json(offsets, _TOPICS))
    return F.aggregate(
        F.flatten(F.transform(by_topic, lambda m: F.map_values(m))), F.lit(0).cast("bigint"), lambda n, o: n + o
    )


def source_lag(progress: DataFrame) -> DataFrame:
    """(query, batch, ended, committed, available, lag) of topic sources: messages handled and held, over all partitions.

    Both come from the same report, so the lag is exact at the batch's start and needs no clock.
    """
    source = progress.select("query", "batch", "ended", F.explode("sources").alias("s"))
    sums = source.select("query", "batch", "ended", _total(F.col("s.endOffset")).alias("c"), _total(F.col("s.latestOffset")).alias("a"))
    sums = sums.groupBy("query", "batch", "ended").agg(F.sum("c").alias("committed"), F.sum("a").alias("available"))
    return sums.withColumn("lag", F.col("available") - F.col("committed"))


def completions(progress: DataFrame) -> DataFrame:
    """(at, n): rows committed and when, for :func:`lag_over_time`."""
    return progress.where("rows > 0").select(F.col("ended").alias("at"), F.col("rows").alias("n"))


def lag_over_time(arrivals: DataFrame, done: DataFrame) -> DataFrame:
    """(at, step, lag): what had arrived and was not yet committed, after each arrival and each batch.

    Both inputs are (at, n), rows counted in groups as they landed or were committed, so their number is that
    of landings and batches; the running sum over them is cut into days.
    """
    both = arrivals.select("at", F.col("n").cast("bigint").alias("d")).unionByName(done.select("at", (-F.col("n")).cast("bigint").alias("d")))
    moments = both.groupBy("at").agg(F.sum("d").alias("d"))
    return running(
        moments,
        bucket=F.floor(F.unix_seconds("at") / DAY_SECONDS).cast("bigint"),
        order=[F.col("at")],
        values={"lag": ("sum", F.col("d")), "step": ("sum", F.lit(1).cast("bigint"))},
        inclusive=True,
    ).select("at", "step", "lag")
