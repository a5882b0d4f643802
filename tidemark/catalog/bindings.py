"""The given tables seen as change streams, evaluation sets and recordings.

Each binding exists twice: as a DataFrame here, and as SQL over the same columns
in ``sql.py``. The SQL never parses JSON, so parsers are checked against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import change
from tidemark.operators import parse
from tidemark.sources.tables import load


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` with the columns both forms of the log are built from."""
    e, u = F.col("event_id"), F.col("user_id")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    df = load(spark, sf, "events").repartition("event_id").withColumn("k", k)
    k = F.col("k")
    state = (
        F.when(e % 97 == 5, "cut")
        .when(e % 89 == 7, "bad id")
        .when(e % 83 == 11, "other stream")
        .when(e % 79 == 13, "bad field")
        .otherwise("ok")
    )
    name = (
        F.when(u % 6 == 0, F.concat(F.lit("192.0.2."), u % 250))
        .when(u % 6 == 1, F.concat(F.lit("~2025-"), u, F.lit("-"), k))
        .when(u % 6 == 2, F.concat(F.lit("Helper "), u))
        .when((u % 6 == 3) & (k % 25 == 0), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("User "), u))
    )
    behind = F.when(k % 10 == 0, 1000 + k).otherwise(1 + k % 50)
    return df.select(
        e.alias("offset"),
        "ts",
        F.unix_millis("ts").alias("dt_ms"),
        u.alias("user_id"),
        "event_type",
        "value",
        "k",
        state.alias("state"),
        F.when(u % 10 == 0, "dewiki").otherwise("enwiki").alias("wiki"),
        F.when(k % 7 == 0, F.lit(1)).otherwise(0).cast("bigint").alias("namespace"),
        F.concat(F.lit("Page "), u % 40).alias("title"),
        name.alias("user"),
        (u % 6 == 2).alias("bot"),
        (e - behind).alias("target"),
        (F.unix_millis("ts") - behind * 240_000).alias("target_ms"),
    )


def raw_log(spark: SparkSession, sf: str) -> DataFrame:
    """(offset, value, arrived): the events as JSON payloads, some of them damaged on purpose."""
    c = F.col
    k, off = c("k"), c("offset")
    other = F.when(c("state") == "other stream", "other.stream")
    meta = lambda stream: F.struct(
        F.concat(F.lit("rc-"), off).alias("id"), iso(c("ts")).alias("dt"), F.coalesce(other, F.lit(stream)).alias("stream")
    )
    kind = (
        F.when(c("state") == "bad field", F.lit(None).cast("string"))
        .when(c("event_type") == "signup", "new")
        .when(c("event_type") == "purchase", "log")
        .otherwise("edit")
    )
    is_log = c("event_type") == "purchase"
    change_json = F.to_json(
        F.struct(
            meta(change.CHANGE_STREAM).alias("meta"),
            kind.alias("type"),
            c("wiki").alias("wiki"),
            c("namespace").alias("namespace"),
            c("title").alias("title"),
            c("user").alias("user"),
            c("bot").alias("bot"),
            F.when(k % 3 == 0, True).when(k % 3 == 2, False).alias("minor"),
            F.when(k % 11 != 0, F.concat(F.lit("note "), k)).alias("comment"),
            F.floor(c("dt_ms") / 1000).alias("timestamp"),
            F.struct(
                F.when(c("event_type") != "signup", k * 10).alias("old"), (k * 10 + (k % 13 - 6) * 7).alias("new")
            ).alias("length"),
            F.when(~is_log, F.struct((off - 1).alias("old"), off.alias("new"))).alias("revision"),
            F.when(is_log, "delete").alias("log_type"),
            F.when(is_log, F.when(k % 2 == 0, "delete").otherwise("restore")).alias("log_action"),
        )
    )
    texts = lambda *items: F.array(*[F.lit(i) for i in items])
    tags = (
        F.when(k % 4 == 0, texts("visualeditor", "mw-undo"))
        .when(k % 4 == 1, texts("mw-reverted"))
        .when(k % 4 == 2, texts("visualeditor", "mw-reverted"))
        .otherwise(texts("mw-reverted", "mw-rollback"))
    )
    prior = F.when(k % 4 == 2, texts("visualeditor")).when(k % 4 == 3, texts("mw-reverted"))
    tags_json = F.to_json(
        F.struct(
            meta(change.TAGS_STREAM).alias("meta"),
            c("wiki").alias("database"),
            c("target").alias("rev_id"),
            F.when(c("state") != "bad field", iso(F.timestamp_millis("target_ms"))).alias("rev_timestamp"),
            c("namespace").alias("page_namespace"),
            tags.alias("tags"),
            F.when(prior.isNotNull(), F.struct(prior.alias("tags"))).alias("prior_state"),
        )
    )
    json = F.when(c("event_type") == "error", tags_json).otherwise(change_json)
    quoted, bare = F.concat(F.lit('"id":"rc-'), off, F.lit('"')), F.concat(F.lit('"id":'), off)
    value = (
        F.when(c("state") == "cut", F.substring(json, F.lit(1), F.length(json) - 5))
        .when(c("state") == "bad id", F.replace(json, quoted, bare))
        .otherwise(json)
    )
    return facts(spark, sf).select("offset", value.alias("value"), c("ts").alias("arrived"))


def parsed_log(spark: SparkSession, sf: str) -> DataFrame:
    return parse.parse(raw_log(spark, sf))


def raw_log_with_copies(spark: SparkSession, sf: str) -> DataFrame:
    """The raw log delivered at least once: every 20th event comes three times."""
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("offset") % 20 == 0, 2).otherwise(0))).alias("copy")
    return raw_log(spark, sf).select("*", copies).select(
        (F.col("offset") * 3 + F.col("copy")).alias("offset"), "value", "arrived"
    )


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """(user, registration, editcount, as_of) per registered name; some unknown, some without a date."""
    u = F.col("user_id")
    seen = facts(spark, sf).where("user LIKE 'User %'").groupBy("user", "user_id").agg(F.count("*").alias("n"))
    days = (u * 7) % 61
    start = F.lit("2024-01-01").cast("timestamp")
    return seen.where(u % 11 != 0).select(
        "user",
        F.when(u % 13 != 0, start - F.make_dt_interval(days.cast("int"))).alias("registration"),
        (F.col("n") * (u % 17)).alias("editcount"),
        F.lit("2024-02-01").cast("timestamp").alias("as_of"),
    )


def account_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots taken while the log ran: one at each view event of a registered name."""
    return facts(spark, sf).where("user LIKE 'User %' AND event_type = 'view'").select(
        "user",
        F.date_trunc("second", "ts").alias("as_of"),
        (F.lit("2023-12-01").cast("timestamp")).alias("registration"),
        (F.col("offset") % 1000).alias("editcount"),
    )


# Configurations of the derived runs as (name, model version, weight of the hash, tokens in).
CONFIGS = (
    ("small:a__terse-1", "a@1", 37, 400),
    ("small:a__rules-4", "a@1", 53, 700),
    ("large:b__terse-1", "b@2", 11, 900),
    ("large:b__rules-4", "b@2", 29, 1300),
    ("baseline:score-c", "c@3", 71, None),
)
PRICES = (("small:a", 0.0, 0.0), ("large:b", 1.5, 9.0))


def eval_set(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as an evaluation set in two parts, dev and sealed."""
    docs = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    d = F.col("doc_id")
    label = (
        F.when(d % 19 == 0, "deleted").when(d % 23 == 0, "incomplete").when(F.col("quality") == 0, "reverted").otherwise("not-reverted")
    )
    return docs.select(
        F.when(d % 3 == 0, "dev").otherwise("sealed").alias("set"),
        d.alias("rev_id"),
        F.when(d % 4 == 0, "temporary").when(d % 4 == 1, "ip").otherwise("registered").alias("user_class"),
        label.alias("label"),
        F.col("quality").cast("bigint").alias("quality"),
        "n_chars",
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of five configurations: hash-based probabilities, some invalid, some missing."""
    c = F.col
    entry = F.array(
        *[
            F.struct(
                F.lit(name).alias("config"), F.lit(version).alias("model_version"),
                F.lit(w).cast("bigint").alias("w"), F.lit(tokens).cast("bigint").alias("tokens"),
            )
            for name, version, w, tokens in CONFIGS
        ]
    )
    d = c("rev_id")
    spread = ((d * c("w") + c("n_chars") * 7) % 101).cast("double") / 100
    p = F.floor((spread * 0.7 + F.when(c("quality") == 0, 0.3).otherwise(0.0)) * 100 + 0.5) / 100.0
    invalid = (d * c("w")) % 31 == 3
    # The first prompt of the large model left some edits unanswered.
    answered = ~((c("config") == "large:b__terse-1") & (d % 10 == 7))
    rows = eval_set(spark, sf).select("*", F.explode(entry).alias("e")).select("*", "e.*").where(answered)
    return rows.select(
        "set",
        "config",
        "rev_id",
        F.when(~invalid, p >= 0.5).alias("revert"),
        F.when(~invalid, p).alias("p_revert"),
        F.when(invalid, "not JSON").alias("invalid"),
        F.when(c("tokens").isNull(), 0.0).otherwise((d * c("w")) % 900 + 100.0).alias("latency_ms"),
        (c("tokens") + d % 50).alias("tokens_in"),
        F.when(c("tokens").isNotNull(), 20 + d % 9).alias("tokens_out"),
        "model_version",
        F.timestamp_seconds(F.lit(1_700_000_000) + d).alias("at"),
    )


def reruns(spark: SparkSession, sf: str) -> DataFrame:
    """Later answers of the sealed runs: two configurations drifted in different ways."""
    c = F.col
    d = c("rev_id")
    flip = ((c("config") == "small:a__terse-1") & (d % 5 == 1)) | ((c("config") == "large:b__rules-4") & (d % 50 == 3))
    lost = (c("config") == "large:b__rules-4") & (d % 7 == 2)
    return runs(spark, sf).where("set = 'sealed'").select(
        "set",
        "config",
        "rev_id",
        F.when(lost, F.lit(None).cast("boolean")).when(flip, ~c("revert")).otherwise(c("revert")).alias("revert"),
        F.when(~lost, F.when(flip, 1 - c("p_revert")).otherwise(c("p_revert"))).alias("p_revert"),
        F.when(c("config") == "small:a__rules-4", "a@2").otherwise(c("model_version")).alias("model_version"),
        "at",
    )


def prices(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("input"), F.lit(o).alias("output")) for m, i, o in PRICES])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def load_samples(spark: SparkSession, sf: str) -> DataFrame:
    """A recording: one cumulative-counter sample per event of the feed, at most one per minute."""
    per_minute = facts(spark, sf).select(
        (F.floor(F.unix_seconds("ts") / F.lit(60)) * 60).cast("bigint").alias("m"), "offset", "k"
    )
    last = per_minute.groupBy("m").agg(F.max("offset").alias("offset"), F.max_by("k", "offset").alias("k"))
    return last.select(
        F.timestamp_seconds(F.col("m") + F.col("k") % 20).alias("t"),
        F.when(F.col("k") % 29 != 0, F.col("k") % 6 + 1).alias("replicas"),
        (F.col("k") * 3).alias("classifier_lag"),
        F.when(F.col("k") % 31 != 0, F.col("offset") + 1).alias("scored"),
    )


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    turns = load(spark, sf, "conversations")
    said = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"))
    heard = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answered"))
    return said.join(heard, ["conv_id", "turn"])
