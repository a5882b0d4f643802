"""The same steps as Structured Streaming queries over the tables as landed files.

Each runs to the end of what is there and returns the table it wrote.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidemark.catalog import bindings as b
from tidemark.catalog.label_queries import LONG_SQL, RULES, SHORT, SHORT_SQL
from tidemark.catalog.label_queries import Q as LABEL_QUERIES
from tidemark.catalog.log_queries import DLQ
from tidemark.catalog.sql import ACCOUNTS, FACTS, LOG, query
from tidemark.operators import audit, enrich, parse
from tidemark.operators.scan import offset_bucket
from tidemark.session import configure, scratch, stored
from tidemark.sources import log
from tidemark.streaming import enriching, jobs, progress

Q: dict = {}
AS_OF_SQL = LABEL_QUERIES["accounts_as_of_edit"][1]
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def register(name: str, sql: str | None):
    def add(fn):
        Q[name] = (fn, sql)
        return fn

    return add


def event_stream(spark, sf):
    stream = log.stream_files(configure(spark), sf, EVENTS, fmt="parquet", glob="events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def land(rows, key, last, folder, parts, files):
    """Yield after each part of ``rows`` has landed in ``folder``: runs of ``key`` of equal width, each as the same number of JSON files.

    File streams read by modification time, so parts must be written one after another.
    """
    piece = F.least(F.floor(F.col(key) * parts * files / (last + 1)), F.lit(parts * files - 1)).cast("int")
    rows = stored(rows.withColumn("piece", piece), "rendered")
    for part in range(parts):
        of_part = rows.where(F.floor(F.col("piece") / files) == part)
        of_part.repartitionById(files, F.col("piece") % files).drop("piece").write.mode("append").json(folder)
        yield part


def landed_log(spark, sf, parts: int = 4, files: int = 4):
    """The raw log landed part by part, then read as a stream of one part per micro-batch. It is rendered once."""
    folder = scratch(spark, "landed")
    last = b.load(spark, sf, "events").agg(F.max("event_id")).scalar()
    for _ in land(b.raw_log(spark, sf).select("offset", "value"), "offset", last, folder, parts, files):
        pass
    return log.stream_files(spark, folder, log.RAW_SCHEMA, per_batch=files)


def run(stream, name):
    return jobs.drain(stream, scratch(stream.sparkSession, name), scratch(stream.sparkSession, f"{name}-state"))


LAST = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTES"


@register("stream_counts_per_minute", f"""SELECT epoch_us(date_trunc('minute', ts)) // 1000000 AS start_s, count(*) AS "all", count(*) FILTER (event_type = 'purchase') AS purchases
FROM events GROUP BY 1 HAVING to_timestamp(epoch_us(date_trunc('minute', any_value(ts))) / 1000000)::TIMESTAMP + INTERVAL 1 MINUTE <= {LAST}""".replace("to_timestamp(epoch_us(date_trunc('minute', any_value(ts))) / 1000000)::TIMESTAMP", "date_trunc('minute', min(ts))"))
def stream_counts_per_minute(spark, sf):
    counted = jobs.counts(event_stream(spark, sf), "ts", "1 minute", purchases=F.col("event_type") == "purchase")
    return run(counted, "counts").select(F.unix_seconds("window_start").alias("start_s"), "all", "purchases")


@register("stream_counts_sliding", f"""SELECT epoch_us(w) // 1000000 AS start_s, count(*) AS "all" FROM (SELECT date_trunc('minute', ts) - to_minutes(i) AS w FROM events, range(0, 5) r(i))
GROUP BY w HAVING w + INTERVAL 5 MINUTES <= {LAST}""")
def stream_counts_sliding(spark, sf):
    """Five-minute windows every minute: the streaming form of a trailing rate."""
    counted = jobs.counts(event_stream(spark, sf), "ts", "5 minutes", slide="1 minute")
    return run(counted, "sliding").select(F.unix_seconds("window_start").alias("start_s"), "all")


@register("stream_without_copies", "SELECT event_id, epoch_us(ts) // 1000 AS ts_ms FROM events")
def stream_without_copies(spark, sf):
    """Every 20th event delivered three times; each id comes out once."""
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("event_id") % 20 == 0, 2).otherwise(0))).alias("copy")
    once = jobs.without_copies(event_stream(spark, sf).select("event_id", "ts", copies), "event_id", "ts")
    return run(once.select("event_id", F.unix_millis("ts").alias("ts_ms")), "once")


@register("stream_edits", query(LOG, "SELECT rev_id, title, user_class, timestamp FROM edits"))
def stream_edits(spark, sf):
    """Parse and project in a stream, exactly once into Parquet."""
    edits = parse.edits(parse.parse(landed_log(spark, sf)))
    return run(edits.select("rev_id", "title", "user_class", "timestamp"), "edits")


@register("stream_edits_with_accounts", query(f"{LOG}, {ACCOUNTS}", "SELECT rev_id, user_class, found, CAST(epoch(registration) AS BIGINT) AS registered_s, editcount, CASE WHEN found THEN true END AS dated FROM enriched"))
def stream_edits_with_accounts(spark, sf):
    """Accounts joined as a static table while edits stream in, stored with the time of what was seen."""
    edits = enrich.attach_accounts(parse.edits(parse.parse(landed_log(spark, sf))), b.accounts(spark, sf))
    a = F.col("account")
    rows = edits.select("rev_id", "user_class", a.isNotNull().alias("found"), F.unix_seconds(a["registration"]).alias("registered_s"), a["editcount"].alias("editcount"), "account_as_of")
    return run(rows, "enriched").select("rev_id", "user_class", "found", "registered_s", "editcount", F.when(F.col("account_as_of").isNotNull(), True).alias("dated"))


@register("stream_dead_letters", query(FACTS, "SELECT CASE WHEN state = 'ok' THEN 'readable' ELSE 'dead' END AS sink, count(*) AS n FROM facts GROUP BY 1"))
def stream_dead_letters(spark, sf):
    """One parse, two sinks, written per batch."""
    folder = split_log(spark, sf)
    counts = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("sink"), "n")
    good, dead = jobs.read_split(spark, folder)
    return counts(good, "readable").unionByName(counts(dead, "dead"))


def split_log(spark, sf):
    folder = scratch(spark, "split")
    jobs.split_sink(landed_log(spark, sf), folder, scratch(spark, "split-state")).awaitTermination()
    return folder


@register("stream_split_rows", query(FACTS, f"""SELECT off AS "offset", CASE WHEN state = 'ok' THEN 'rc-' || off END AS meta_id, CASE WHEN state = 'ok' THEN dt_ms END AS dt_ms, reason
FROM facts LEFT JOIN (SELECT source_offset, reason FROM ({DLQ})) d ON d.source_offset = off"""))
def stream_split_rows(spark, sf):
    """Every row of the log is in exactly one of the two sinks, with its time or the reason it cannot be read."""
    good, dead = jobs.read_split(spark, split_log(spark, sf))
    rows = good.select("offset", "meta_id", F.unix_millis("dt").alias("dt_ms"), F.lit(None).cast("string").alias("reason"))
    none = F.lit(None)
    return rows.unionByName(dead.select(F.col("source_offset").alias("offset"), none.cast("string").alias("meta_id"), none.cast("bigint").alias("dt_ms"), "reason"))


@register("stream_accounts_as_of", f"SELECT *, true AS asked_once FROM ({AS_OF_SQL})")
def stream_accounts_as_of(spark, sf):
    """Accounts as of each streamed edit, asked for once: a replay over the kept answers asks nothing and sees the same."""
    edits = parse.edits(parse.parse(landed_log(spark, sf)))
    look_up, answers = enriching.snapshot_lookup(b.account_snapshots(spark, sf)), scratch(spark, "answers")
    runs = []
    for _ in range(2):
        folder = scratch(spark, "enriched")
        enriching.enrich_stream(edits, look_up, folder, answers, scratch(spark, "enriched-state")).awaitTermination()
        runs.append(folder)
    asked = [enriching.lookups(spark, f).agg(F.sum("asked")).first()[0] for f in runs]
    rows = enriching.read_enriched(spark, runs[1], edits)
    return rows.select("rev_id", F.unix_seconds("account_as_of").alias("as_of_s"), F.col("account.editcount").alias("editcount"), F.lit(asked[0] > 0 and asked[1] == 0).alias("asked_once"))


@register("stream_resumed_counts", query(FACTS, "SELECT count(*) AS handled, max(off) + 1 AS expected, CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS missing, CAST(NULL AS BIGINT) AS first_gap, true AS ok FROM facts"))
def stream_resumed_counts(spark, sf):
    """Stopped after half of the files and resumed from its checkpoint: every offset exactly once."""
    folder, out, state = (scratch(spark, n) for n in ("landed", "resumed", "resumed-state"))
    raw = b.raw_log(spark, sf).select("offset", "value")
    half = b.load(spark, sf, "events").agg(F.floor(F.max("event_id") / 2)).scalar()
    for part in (raw.where(F.col("offset") <= half), raw.where(F.col("offset") > half)):
        part.write.mode("append").json(folder)
        jobs.to_table(log.stream_files(spark, folder, log.RAW_SCHEMA, per_batch=3), out, state).awaitTermination()
    end = b.load(spark, sf, "events").agg(F.max("event_id") + 1).scalar()
    return audit.exactly_once(spark.read.parquet(out).select("offset"), 0, end)


def streamed_labels(spark, sf, rules):
    folder = scratch(spark, "labels")
    jobs.label_stream(landed_log(spark, sf), folder, scratch(spark, "labels-state"), rules).awaitTermination()
    rows = jobs.read_labels(spark, folder)
    return rows.select("rev_id", F.unix_millis("edit_time").alias("edit_ms"), "label", F.unix_millis("reverted_at").alias("tag_ms"))


STREAMED = "SELECT rev_id, edit_ms, label, CASE WHEN label = 'reverted' THEN tag_ms END AS tag_ms FROM labels_"


@register("stream_labels_72h", query(f"{LOG}, {LONG_SQL}", STREAMED))
def stream_labels_72h(spark, sf):
    """All four labels as windows close over several micro-batches, outages included."""
    return streamed_labels(spark, sf, RULES)


@register("stream_labels_2h", query(f"{LOG}, {SHORT_SQL}", STREAMED))
def stream_labels_2h(spark, sf):
    return streamed_labels(spark, sf, SHORT)


@register(
    "stream_missing_minutes",
    f"""WITH m AS (SELECT DISTINCT epoch_us(ts) // 60000000 AS m FROM events WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= {LAST}),
n AS (SELECT m, lead(m) OVER (ORDER BY m) AS next FROM m) SELECT (m + 1) * 60 AS from_s, next * 60 AS to_s FROM n WHERE next > m + 1""",
)
def stream_missing_minutes(spark, sf):
    """Minutes without any event, from the streamed minute counts."""
    counted = run(jobs.counts(event_stream(spark, sf), "ts", "1 minute"), "minutes")
    gaps = jobs.missing_minutes(counted)
    return gaps.select(F.unix_seconds("gap_from").alias("from_s"), F.unix_seconds("gap_to").alias("to_s"))


@register("stream_append_of_new_offsets", "SELECT event_id AS source_offset, user_id FROM events")
def stream_append_of_new_offsets(spark, sf):
    """A replay over a table that already holds a part of its rows adds only the others."""
    out, state = scratch(spark, "appended"), scratch(spark, "appended-state")
    rows = b.load(spark, sf, "events").select(F.col("event_id").alias("source_offset"), "user_id")
    held = rows.where("source_offset % 3 = 0").withColumn("source_offset_run", offset_bucket(F.col("source_offset")))
    held.write.partitionBy("source_offset_run").parquet(out)
    stream = event_stream(spark, sf).select(F.col("event_id").alias("source_offset"), "user_id")
    jobs.append_new(stream, out, state).awaitTermination()
    return spark.read.parquet(out).select("source_offset", "user_id")


@register("stream_stage_counters", query(LOG, """SELECT part AS batch, count(*) AS read, count(rev_id) AS written, count(*) - count(rev_id) AS skipped, CAST(0 AS BIGINT) AS late
FROM (SELECT least(floor(event_id * 16.0 / (SELECT max(event_id) + 1 FROM events)), 15)::BIGINT // 4 AS part, event_id FROM events) e LEFT JOIN edits ON rev_id = event_id GROUP BY 1"""))
def stream_stage_counters(spark, sf):
    """What the parse stage read, wrote, skipped and came too late for, one row for each micro-batch, from its progress reports."""
    reports = scratch(spark, "progress")
    with progress.ProgressLog(spark, reports):
        raw = progress.count_read(landed_log(spark, sf))
        run(progress.count_written(parse.edits(parse.parse(raw))).select("rev_id"), "counted")
    return progress.stage_counts(progress.read_progress(spark, reports)).select("batch", "read", "written", "skipped", "late")


LATE_PARTS = """WITH e AS (SELECT event_id, least(floor(event_id * 16.0 / (SELECT max(event_id) + 1 FROM events)), 15)::BIGINT // 4 AS part, ts FROM events),
p AS (SELECT *, CASE WHEN part >= 2 AND event_id % 50 = 3 THEN ts - INTERVAL 5 DAYS * part ELSE ts END AS seen FROM e),
m AS (SELECT part, max(max(seen)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 10 MINUTES AS mark FROM p GROUP BY part)"""


@register("stream_late_rows", f"""{LATE_PARTS} SELECT part AS batch, count(*) AS rows, count(*) FILTER (epoch_us(seen) // 1000 <= epoch_us(mark) // 1000) AS late FROM p JOIN m USING (part) GROUP BY 1""")
def stream_late_rows(spark, sf):
    """Rows behind the watermark are dropped and counted: every 50th event of the later half comes days late.

    A batch holds its rows against the watermark that the batch before it ran with.
    """
    folder, reports = scratch(spark, "landed"), scratch(spark, "progress")
    rows = b.load(spark, sf, "events").select("event_id", "ts")
    last = rows.agg(F.max("event_id")).scalar()
    part = F.floor(F.least(F.floor(F.col("event_id") * 16 / (last + 1)), F.lit(15)) / 4)
    behind = F.when((part >= 2) & (F.col("event_id") % 50 == 3), part * 5 * 86_400_000_000).otherwise(0)
    for _ in land(rows.select("event_id", (F.unix_micros("ts") - behind).alias("us")), "event_id", last, folder, 4, 4):
        pass
    stream = log.stream_files(spark, folder, "event_id BIGINT, us BIGINT", per_batch=4).select("event_id", F.timestamp_micros("us").alias("ts"))
    with progress.ProgressLog(spark, reports):
        run(jobs.without_copies(stream, "event_id", "ts"), "in-time")
    return progress.late_rows(progress.read_progress(spark, reports)).select("batch", "rows", "late")


@register("stream_backlog", """WITH n AS (SELECT least(floor(event_id * 16.0 / (SELECT max(event_id) + 1 FROM events)), 15)::BIGINT // 4 AS part, count(*) AS n FROM events GROUP BY 1),
s AS (SELECT part + 1 AS step, n AS d FROM n UNION ALL SELECT part + 5, -n FROM n), a AS (SELECT count(*) AS c FROM events)
SELECT step, CAST(sum(d) OVER (ORDER BY step) AS BIGINT) AS lag, a.c AS handled, true AS exactly_once FROM s, a""")
def stream_backlog(spark, sf):
    """A consumer that takes one part per micro-batch starts behind four landings: its lag rises, drains to nothing, and each offset was handled once."""
    folder, reports = scratch(spark, "landed"), scratch(spark, "progress")
    out, state = scratch(spark, "handled"), scratch(spark, "handled-state")
    rows = b.load(spark, sf, "events").select(F.col("event_id").alias("offset"))
    last = rows.agg(F.max("offset")).scalar()
    landings = []
    for _ in land(rows, "offset", last, folder, 4, 4):
        landed = spark.read.schema("offset BIGINT").json(folder).count()
        landings.append((datetime.now(timezone.utc), landed - sum(n for _, n in landings)))
    with progress.ProgressLog(spark, reports):
        jobs.to_table(log.stream_files(spark, folder, "offset BIGINT", per_batch=4), out, state).awaitTermination()
    lag = progress.lag_over_time(spark.createDataFrame(landings, "at timestamp, n bigint"), progress.completions(progress.read_progress(spark, reports)))
    audited = audit.exactly_once(spark.read.parquet(out), 0, last + 1).select("handled", F.col("ok").alias("exactly_once"))
    return lag.select("step", "lag").join(audited)
