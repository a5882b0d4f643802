"""Account facts as of each edit while edits stream in, each fact looked up once and kept.

An edit may take a fact up to a TTL old. So the facts that can matter to it were recorded in one of
two cells of time, each as long as the TTL: its own up to the edit, and the one before. What has been
asked is kept by user and cell with the time up to which it was asked, what was answered as versions with
their time. A batch asks for what no earlier one has: new users, new cells, and the rest of a cell
that has gone on since. Both tables are filed by day, so a batch reads the days of its own edits.

A replay finds all its cells asked, looks nothing up, and sees what the first run saw.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.enrich import attach_accounts_as_of
from tidemark.session import stored
from tidemark.streaming.batches import children, commit, committed, each_batch, read_committed

TTL_SECONDS = 3_600
DAY_SECONDS = 86_400
ASKED = "user STRING, cell BIGINT, until BIGINT"
VERSIONS = "user STRING, as_of TIMESTAMP, registration TIMESTAMP, editcount BIGINT"


def snapshot_lookup(snapshots: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A lookup in a table of versioned snapshots (user, as_of, registration, editcount)."""

    def look_up(wanted: DataFrame) -> DataFrame:
        # ``wanted``: (user, after, until) in seconds; versions with after < as_of <= until answer it.
        at = F.unix_seconds("as_of")
        facts = snapshots.select("user", "as_of", "registration", F.col("editcount").cast("bigint").alias("editcount"))
        return facts.join(wanted, "user").where((at > F.col("after")) & (at <= F.col("until"))).select("user", "as_of", "registration", "editcount")

    return look_up


def _day(seconds: Column) -> Column:
    return F.floor(seconds / DAY_SECONDS).cast("bigint")


def _days(spark: SparkSession, folder: str, schema: str, lo: int, hi: int) -> DataFrame:
    """What is filed under the days lo..hi."""
    held = [f"{folder}/{n}" for n in children(spark, folder) if n.startswith("day=") and lo <= int(n[4:]) <= hi]
    return spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)


def _wanted(keys: DataFrame, ttl: int) -> DataFrame:
    """(user, cell, until): the cells that edits (user, t) need, and up to when."""
    own = keys.select("user", F.floor(F.col("t") / ttl).cast("bigint").alias("cell"), F.col("t").alias("until"))
    before = own.select("user", (F.col("cell") - 1).alias("cell"), (F.col("cell") * ttl - 1).alias("until"))
    return own.unionByName(before).groupBy("user", "cell").agg(F.max("until").alias("until"))


def enrich_stream(
    edits: DataFrame, lookup: Callable[[DataFrame], DataFrame], folder: str, answers: str, checkpoint: str, ttl_seconds: int = TTL_SECONDS
) -> StreamingQuery:
    """Write ``edits`` with ``account`` and ``account_as_of`` to ``folder``, equal to the as-of join with all that ``lookup`` knows.

    ``lookup`` maps (user, after, until), in seconds, to the versions (user, as_of, registration, editcount) recorded in that
    time. What it answered is kept in ``answers``, which other runs may share. Times are whole seconds: a
    version counts from its second on.
    """

    def write(batch: DataFrame, b: int) -> None:
        spark = batch.sparkSession
        rows = stored(batch, "stream-edits")
        keys = rows.where("user_class = 'registered' AND user IS NOT NULL AND dt IS NOT NULL").select("user", F.unix_seconds("dt").alias("t"))
        lo, hi, n = keys.agg(F.min("t"), F.max("t"), F.count(F.lit(1))).first()
        asked = 0
        versions = spark.createDataFrame([], VERSIONS)
        if lo is not None:
            first, last = (lo - 2 * ttl_seconds) // DAY_SECONDS, hi // DAY_SECONDS
            known = _days(spark, f"{answers}/asked", ASKED, first, last).groupBy("user", "cell").agg(F.max("until").alias("known"))
            wanted = _wanted(keys, ttl_seconds).join(known, ["user", "cell"], "left").where("known IS NULL OR known < until")
            counted = Observation()
            after = F.coalesce("known", F.col("cell") * ttl_seconds - 1)
            wanted = stored(wanted.select("user", "cell", after.alias("after"), "until").observe(counted, F.count(F.lit(1)).alias("n")), "account-questions")
            asked = counted.get["n"]
            if asked:
                # Versions first: a cell that is marked as asked has its answers.
                found = lookup(wanted.select("user", "after", "until"))
                found.withColumn("day", _day(F.unix_seconds("as_of"))).write.mode("append").partitionBy("day").parquet(f"{answers}/versions")
                marks = wanted.select("user", "cell", "until", _day(F.col("cell") * ttl_seconds).alias("day"))
                marks.write.mode("append").partitionBy("day").parquet(f"{answers}/asked")
            versions = _days(spark, f"{answers}/versions", VERSIONS, first, last).join(keys.select("user").distinct(), "user", "left_semi")
        enriched = attach_accounts_as_of(rows, versions, ttl=f"{ttl_seconds} seconds")
        enriched.write.mode("overwrite").parquet(f"{folder}/edits/batch={b}")
        commit(spark, f"{folder}/manifest", b, edits=n, asked=asked)

    return each_batch(edits, checkpoint, write)


def read_enriched(spark: SparkSession, folder: str, edits: DataFrame) -> DataFrame:
    """The enriched edits of all committed batches; ``edits`` is the stream or table they came from, for its schema."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edits.schema)
    return read_committed(spark, f"{folder}/edits", f"{folder}/manifest", f"{own}, account STRUCT<registration: TIMESTAMP, editcount: BIGINT>, account_as_of TIMESTAMP")


def lookups(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, edits, asked): questions that each committed batch had to ask."""
    return committed(spark, f"{folder}/manifest").select("batch", F.col("counts")["edits"].alias("edits"), F.col("counts")["asked"].alias("asked"))
