"""Reading, checking and cutting the raw log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import bindings as b
from tidemark.catalog.sql import FACTS, LOG, RUNS, query
from tidemark.functions import change
from tidemark.operators import audit, parse
from tidemark.plans.jobs import through_table
from tidemark.session import scratch
from tidemark.sources import log, replay, tables

Q: dict = {}


def register(name: str, sql: str | None):
    def add(fn):
        Q[name] = (fn, sql)
        return fn

    return add


def ms(c):
    return F.unix_millis(c)


@register(
    "envelope_check",
    query(FACTS, "SELECT state = 'ok' OR state IN ('other stream', 'bad field') AS valid, count(*) AS n FROM facts GROUP BY 1"),
)
def envelope_check(spark, sf):
    return parse.with_envelope(b.raw_log(spark, sf)).groupBy("valid").agg(F.count("*").alias("n"))


@register(
    "change_events",
    query(
        LOG,
        """SELECT off, dt_ms, CASE event_type WHEN 'signup' THEN 'new' WHEN 'purchase' THEN 'log' ELSE 'edit' END AS type, wiki,
  namespace, title, usr AS user_name, bot, CASE WHEN k % 3 = 0 THEN true WHEN k % 3 = 2 THEN false END AS minor,
  CASE WHEN k % 11 <> 0 THEN 'note ' || k END AS comment, dt_ms // 1000 AS timestamp,
  CASE WHEN event_type <> 'purchase' THEN off END AS rev_id FROM log WHERE event_type <> 'error'""",
    ),
)
def change_events(spark, sf):
    c = F.col("change")
    return parse.readable(b.parsed_log(spark, sf)).where(c.isNotNull()).select(
        F.col("offset").alias("off"), ms("dt").alias("dt_ms"), c["type"].alias("type"), c["wiki"].alias("wiki"),
        c["namespace"].alias("namespace"), c["title"].alias("title"), c["user"].alias("user_name"), c["bot"].alias("bot"),
        c["minor"].alias("minor"), c["comment"].alias("comment"), c["timestamp"].alias("timestamp"), c["rev_id"].alias("rev_id"),
    )


@register(
    "tag_change_events",
    query(
        LOG,
        """SELECT off, target AS rev_id, target_ms AS rev_ms, wiki, namespace,
  CASE k % 4 WHEN 0 THEN 'visualeditor,mw-undo' WHEN 1 THEN 'mw-reverted' WHEN 2 THEN 'visualeditor,mw-reverted' ELSE 'mw-reverted,mw-rollback' END AS tags,
  CASE k % 4 WHEN 0 THEN 'visualeditor,mw-undo' WHEN 1 THEN 'mw-reverted' WHEN 2 THEN 'mw-reverted' ELSE 'mw-rollback' END AS added,
  CASE k % 4 WHEN 0 THEN 'mw-undo' WHEN 1 THEN 'mw-reverted' WHEN 2 THEN 'mw-reverted' ELSE 'mw-rollback' END AS added_revert_tags,
  k % 4 IN (1, 2) AS reverts FROM log WHERE event_type = 'error'""",
    ),
)
def tag_change_events(spark, sf):
    rows = parse.readable(b.parsed_log(spark, sf)).where("tags IS NOT NULL").select("offset", "tags.*")
    added = change.added_tags(F.col("tags"), F.col("prior_tags"))
    return rows.withColumn("added_", added).select(
        F.col("offset").alias("off"), "rev_id", ms("rev_timestamp").alias("rev_ms"), "wiki", "namespace",
        F.array_join("tags", ",").alias("tags"), F.array_join("added_", ",").alias("added"),
        F.array_join(change.revert_tags(F.col("added_")), ",").alias("added_revert_tags"),
        change.is_reverted(F.col("added_")).alias("reverts"),
    )


@register(
    "user_classes",
    query(
        LOG,
        """SELECT CASE WHEN bot THEN 'bot' WHEN usr IS NULL THEN 'unknown' WHEN user_id % 6 = 1 THEN 'temporary' WHEN user_id % 6 = 0 THEN 'ip'
  ELSE 'registered' END AS user_class, count(*) AS n FROM log WHERE event_type <> 'error' GROUP BY 1""",
    ),
)
def user_classes(spark, sf):
    c = F.col("change")
    return (
        parse.readable(b.parsed_log(spark, sf)).where(c.isNotNull())
        .groupBy(change.user_class(c["user"], c["bot"]).alias("user_class")).agg(F.count("*").alias("n"))
    )


EDIT_COLUMNS = ["rev_id", "wiki", "title", "timestamp", "user_class", "user_name", "minor", "is_new", "length_old", "length_new", "comment", "meta_id"]


@register("edits_parsed", query(LOG, "SELECT rev_id, wiki, title, timestamp, user_class, usr AS user_name, minor, is_new, length_old, length_new, comment, meta_id FROM edits"))
def edits_parsed(spark, sf):
    return parse.edits(b.parsed_log(spark, sf)).withColumnRenamed("user", "user_name").select(EDIT_COLUMNS)


@register(
    "edits_by_namespace_scope",
    query(LOG, "SELECT wiki, namespace, event_type IN ('click', 'view', 'signup') AND namespace = 0 AS classifiable, count(*) AS n FROM log WHERE event_type <> 'error' GROUP BY ALL"),
)
def edits_by_namespace_scope(spark, sf):
    c = F.col("change")
    return (
        parse.readable(b.parsed_log(spark, sf)).where(c.isNotNull())
        .groupBy(c["wiki"].alias("wiki"), c["namespace"].alias("namespace"), change.is_classifiable(c["type"], c["namespace"]).alias("classifiable"))
        .agg(F.count("*").alias("n"))
    )


@register("page_deletions", query(LOG, "SELECT off, dt_ms, title FROM deletions"))
def page_deletions(spark, sf):
    return parse.page_deletions(b.parsed_log(spark, sf)).select(F.col("offset").alias("off"), ms("dt").alias("dt_ms"), "title")


DLQ = """SELECT CASE WHEN state = 'cut' THEN 'offset-' || off WHEN state = 'bad id' THEN CAST(off AS VARCHAR) ELSE 'rc-' || off END AS key,
  CASE state WHEN 'cut' THEN 'not JSON' WHEN 'other stream' THEN 'unknown stream: other.stream'
    WHEN 'bad id' THEN (CASE WHEN event_type = 'error' THEN 'tags-change' ELSE 'recentchange' END) || ' schema: meta.id'
    ELSE CASE WHEN event_type = 'error' THEN 'tags-change schema: rev_timestamp' ELSE 'recentchange schema: type' END END AS reason,
  off AS source_offset FROM facts WHERE state <> 'ok'"""


@register("dead_letters", query(FACTS, DLQ))
def dead_letters(spark, sf):
    return parse.dead_letters(b.parsed_log(spark, sf)).drop("raw")


@register("dead_letters_by_reason", query(FACTS, f"SELECT reason, count(*) AS n FROM ({DLQ}) GROUP BY 1"))
def dead_letters_by_reason(spark, sf):
    return parse.dead_letters(b.parsed_log(spark, sf)).groupBy("reason").agg(F.count("*").alias("n"))


@register(
    "prefiltered_tag_changes",
    query(LOG, "SELECT count(*) AS n, min(target) AS first_rev, max(target) AS last_rev FROM log WHERE event_type = 'error' AND wiki = 'enwiki'"),
)
def prefiltered_tag_changes(spark, sf):
    raw = parse.mentions(b.raw_log(spark, sf), '"database":"enwiki"')
    rev = F.col("tags.rev_id")
    return parse.parse(raw).where("tags IS NOT NULL").agg(F.count("*").alias("n"), F.min(rev).alias("first_rev"), F.max(rev).alias("last_rev"))


@register("deduplicated_log", query(FACTS, "SELECT off * 3 AS off, 'rc-' || off AS meta_id, dt_ms FROM facts WHERE state NOT IN ('cut', 'bad id')"))
def deduplicated_log(spark, sf):
    valid = parse.with_envelope(b.raw_log_with_copies(spark, sf)).where("valid").select("offset", "value")
    parsed = parse.parse(valid).select("offset", "meta_id", "dt")
    return parse.first_by_key(parsed, "meta_id", "offset").select(F.col("offset").alias("off"), "meta_id", ms("dt").alias("dt_ms"))


@register(
    "ingest_counts",
    query(
        FACTS,
        """SELECT CAST(sum(copies) AS BIGINT) AS received, CAST(sum(copies) FILTER (bad) AS BIGINT) AS invalid, count(*) FILTER (NOT bad) AS written,
  CAST(sum(copies - 1) FILTER (NOT bad) AS BIGINT) AS duplicates
FROM (SELECT CASE WHEN off % 20 = 0 THEN 3 ELSE 1 END AS copies, state IN ('cut', 'bad id') AS bad FROM facts)""",
    ),
)
def ingest_counts(spark, sf):
    raw = parse.with_envelope(b.raw_log_with_copies(spark, sf))
    with_id = raw.withColumn("meta_id", F.get_json_object("value", "$.meta.id"))
    return audit.ingest_counts(with_id)


@register("replay_window", query(LOG, "SELECT off, dt_ms FROM log WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:30:00'"))
def replay_window(spark, sf):
    at = lambda s: F.lit(s).cast("timestamp")
    rows = log.in_window(parse.readable(b.parsed_log(spark, sf)), at("2024-01-10 06:00:00"), at("2024-01-12 18:30:00"))
    return rows.select(F.col("offset").alias("off"), ms("dt").alias("dt_ms"))


@register("replay_through_index", query(LOG, """SELECT off, dt_ms, true AS complete,
  (SELECT count(DISTINCT file) FROM piece WHERE file IN (SELECT p.file FROM piece p JOIN facts f USING (off) WHERE f.state <> 'cut' GROUP BY p.file HAVING max(f.ts) >= TIMESTAMP '2024-01-10 06:00:00' AND min(f.ts) < TIMESTAMP '2024-01-12 18:30:00')) AS files
FROM log WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:30:00'""").replace("WITH ", "WITH piece AS (SELECT event_id AS off, event_id * 32 // (SELECT max(event_id) + 1 FROM events) AS file FROM events), ", 1))
def replay_through_index(spark, sf):
    """The same window from captures landed as 32 files: only the files that can hold it are opened."""
    since, until = "2024-01-10 06:00:00", "2024-01-12 18:30:00"
    folder, index = scratch(spark, "capture"), scratch(spark, "capture-index")
    last = b.load(spark, sf, "events").agg(F.max("event_id")).scalar()
    raw = b.raw_log(spark, sf).select("offset", "value").withColumn("file", F.floor(F.col("offset") * 32 / (last + 1)).cast("int"))
    raw.repartitionById(32, F.col("file")).drop("file").write.json(folder)
    known = replay.index_captures(spark, folder, index)
    rows = parse.readable(parse.parse(replay.replay(spark, folder, index, since, until).select("offset", "value")))
    files = len(replay.files_of_window(spark, folder, index, since, until))
    return rows.select(F.col("offset").alias("off"), ms("dt").alias("dt_ms"), replay.is_complete(known, until).alias("complete"), F.lit(files).cast("bigint").alias("files"))


@register("replay_offsets", query(FACTS, "SELECT rev_id, off FROM (SELECT *, off AS rev_id FROM facts) WHERE off BETWEEN (SELECT max(event_id) // 4 FROM events) AND (SELECT max(event_id) // 2 FROM events) AND state = 'ok' AND wiki = 'enwiki' AND namespace = 0 AND event_type IN ('click', 'view', 'signup')"))
def replay_offsets(spark, sf):
    last = b.load(spark, sf, "events").agg(F.max("event_id"))
    quarter, half = (last.select(F.floor(F.col("max(event_id)") / n)).scalar() for n in (4, 2))
    part = log.in_offsets(b.raw_log(spark, sf), quarter, half)
    return parse.edits(parse.parse(part)).select("rev_id", F.col("offset").alias("off"))


def partitioned_log(spark, sf):
    """Six log partitions, each with dense offsets of its own."""
    e = F.col("event_id")
    return b.load(spark, sf, "events").withColumn("partition", (e % 6).cast("int")).withColumn("offset", F.floor(e / 6).cast("bigint"))


PARTS = "parts AS (SELECT *, CAST(event_id % 6 AS INTEGER) AS part, event_id // 6 AS off FROM events)"


@register("tail_of_partitions", query(PARTS, "SELECT part, off, event_id FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY off DESC) AS n FROM parts) WHERE n <= 20"))
def tail_of_partitions(spark, sf):
    return log.tail(partitioned_log(spark, sf), 20).select(F.col("partition").alias("part"), F.col("offset").alias("off"), "event_id")


@register("last_of_partitions", query(PARTS, "SELECT part, max(off) AS off, max(event_id) AS event_id FROM parts GROUP BY 1"))
def last_of_partitions(spark, sf):
    rows = partitioned_log(spark, sf).select("partition", "offset", "event_id")
    return log.last_per_partition(rows).select(F.col("partition").alias("part"), F.col("offset").alias("off"), "event_id")


@register("resume_point", "SELECT min(last) AS resume_offset, count(*) AS partitions_seen FROM (SELECT user_id % 6 AS p, max(event_id) AS last FROM events GROUP BY 1)")
def resume_point(spark, sf):
    written = b.load(spark, sf, "events").select((F.col("user_id") % 6).alias("partition"), F.col("event_id").alias("source_offset"))
    return log.resume_point(written, 6)


@register("resume_point_with_empty_partition", "SELECT CAST(NULL AS BIGINT) AS resume_offset, count(DISTINCT user_id % 6) AS partitions_seen FROM events")
def resume_point_with_empty_partition(spark, sf):
    written = b.load(spark, sf, "events").select((F.col("user_id") % 6).alias("partition"), F.col("event_id").alias("source_offset"))
    return log.resume_point(written, 7)


@register("keyed_sink_messages", query(LOG, "SELECT CAST(rev_id AS VARCHAR) AS key, title, timestamp, user_class FROM edits"))
def keyed_sink_messages(spark, sf):
    """Edits as (key, value) messages, spread by key, read back from their JSON."""
    edits = parse.edits(b.parsed_log(spark, sf)).select("rev_id", "title", "timestamp", "user_class")
    messages = log.keyed(log.spread(edits, 6))
    fields = F.from_json("value", "title STRING, timestamp BIGINT, user_class STRING")
    return messages.select("key", fields.alias("v")).select("key", "v.*")


@register("capture_files", query(FACTS, "SELECT off, state = 'cut' AS unreadable FROM facts"))
def capture_files(spark, sf):
    """The raw log written as JSON lines with blank lines between, and read back."""
    raw = b.raw_log(spark, sf)
    lines = raw.select(F.explode(F.array(F.to_json(F.struct("offset", "value")), F.lit(""))).alias("value"))
    path = scratch(spark, "capture")
    lines.write.text(path)
    back = log.read_capture(spark, path).select(F.from_json("value", log.RAW_SCHEMA).alias("r")).select("r.*")
    return back.select(F.col("offset").alias("off"), F.try_parse_json("value").isNull().alias("unreadable"))


@register("csv_round_trip", r"SELECT doc_id, md5(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^[ \t\n]+', ''), '[ \t\n]+$', '')) AS text_md5, lang FROM documents")
def csv_round_trip(spark, sf):
    docs = b.load(spark, sf, "documents").select("doc_id", "text", "lang")
    back = through_table(docs, "csv", tables.write_csv, lambda s, p: tables.read_csv(s, p, "doc_id BIGINT, text STRING, lang STRING"))
    text = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return back.select("doc_id", F.md5(text).alias("text_md5"), "lang")


@register("csv_sheet_with_quotes", "SELECT conv_id, turn, '\"' || role || '\", said' AS quoted, role || chr(10) || conv_id AS two_lines, coalesce(NULLIF(CASE WHEN turn % 2 = 0 THEN '' ELSE 'x' END, ''), '') AS maybe_empty FROM conversations")
def csv_sheet_with_quotes(spark, sf):
    rows = b.load(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.lit('"'), "role", F.lit('", said')).alias("quoted"),
        F.concat("role", F.lit("\n"), "conv_id").alias("two_lines"), F.when(F.col("turn") % 2 == 0, "").otherwise("x").alias("maybe_empty"),
    )
    schema = "conv_id BIGINT, turn BIGINT, quoted STRING, two_lines STRING, maybe_empty STRING"
    return through_table(rows, "sheet", tables.write_csv, lambda s, p: tables.read_csv(s, p, schema))


@register("both_streams_of_one_log", query(LOG, "SELECT CASE WHEN event_type = 'error' THEN 'mediawiki.revision-tags-change' ELSE 'mediawiki.recentchange' END AS stream, count(*) AS n, min(dt_ms) AS first_ms, max(dt_ms) AS last_ms FROM log GROUP BY 1"))
def both_streams_of_one_log(spark, sf):
    rows = parse.readable(b.parsed_log(spark, sf))
    return rows.groupBy("stream").agg(F.count("*").alias("n"), ms(F.min("dt")).alias("first_ms"), ms(F.max("dt")).alias("last_ms"))


_ROW_SHA = """sha256('{"lang":' || CASE WHEN lang IS NULL THEN 'null' ELSE '"' || lang || '"' END || ',"n_chars":' || n_chars
  || ',"rev_id":' || doc_id || ',"text":"' || replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(13), chr(92) || 'r') || '"}')"""
_PART_SUMS = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS HUGEINT)) AS VARCHAR)" for i in range(8))


@register("content_fingerprint", f"SELECT count(*) AS rows, sha256(concat_ws(',', {_PART_SUMS})) AS digest FROM (SELECT {_ROW_SHA} AS h FROM documents)")
def content_fingerprint(spark, sf):
    rows = b.load(spark, sf, "documents").select(F.col("doc_id").alias("rev_id"), "lang", "n_chars", "text")
    return tables.fingerprint(rows)


@register("frozen_set", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def frozen_set(spark, sf):
    """Freeze a table with its manifest, verify it on reading, and summarise it."""
    path = scratch(spark, "set")
    tables.freeze(b.load(spark, sf, "documents"), path, name="documents")
    return tables.thaw(spark, path).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@register("exactly_once_audit", query(FACTS, "SELECT count(*) AS handled, max(off) + 1 AS expected, CAST(0 AS BIGINT) AS duplicates, max(off) + 1 - count(*) AS missing, (SELECT min(off) FROM facts WHERE state <> 'ok') AS first_gap, false AS ok FROM facts WHERE state = 'ok'"))
def exactly_once_audit(spark, sf):
    handled = parse.readable(b.parsed_log(spark, sf)).select("offset")
    end = b.load(spark, sf, "events").agg(F.max("event_id") + 1).scalar()
    return audit.exactly_once(handled, 0, end)


@register(
    "exactly_once_audit_of_copies",
    "SELECT CAST(sum(CASE WHEN event_id % 20 = 0 THEN 3 ELSE 1 END) AS BIGINT) AS handled, max(event_id) + 1 AS expected, CAST(sum(CASE WHEN event_id % 20 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS missing, CAST(1 AS BIGINT) AS first_gap, false AS ok FROM events",
)
def exactly_once_audit_of_copies(spark, sf):
    handled = b.raw_log_with_copies(spark, sf).select(F.floor(F.col("offset") / 3).alias("offset"))
    end = b.load(spark, sf, "events").agg(F.max("event_id") + 1).scalar()
    return audit.exactly_once(handled, 0, end)


@register("missing_offset_runs", query(FACTS, """SELECT min(off) AS gap_from, max(off) AS gap_to FROM (
  SELECT off, off - row_number() OVER (ORDER BY off) AS g FROM facts WHERE state <> 'ok') GROUP BY g
  HAVING max(off) < (SELECT max(off) FROM facts WHERE state = 'ok') AND min(off) > (SELECT min(off) FROM facts WHERE state = 'ok')"""))
def missing_offset_runs(spark, sf):
    return audit.gap_runs(parse.readable(b.parsed_log(spark, sf)).select("offset"))


@register(
    "price_table",
    query(RUNS, "SELECT model, count(*) AS rows, any_value(input)::DOUBLE AS input, any_value(output)::DOUBLE AS output, '2026-10-04' AS retrieved_at FROM runs JOIN prices ON prices.model = split_part(config, '__', 1) GROUP BY 1"),
)
def price_table(spark, sf):
    """Prices written as a dated JSON file and loaded, next to the models that ran."""
    path = scratch(spark, "prices")
    models = F.map_from_entries(F.collect_list(F.struct("model", F.struct("input", "output"))))
    doc = b.prices(spark).agg(models.alias("models")).select(F.lit("2026-10-04").alias("retrievedAt"), "models")
    tables.write_report(doc.coalesce(1), path)
    priced = tables.load_prices(spark, path)
    used = b.runs(spark, sf).select(change.model_of(F.col("config")).alias("model")).groupBy("model").agg(F.count("*").alias("rows"))
    return used.join(priced, "model").select("model", "rows", "input", "output", F.col("retrieved_at").cast("string").alias("retrieved_at"))
