"""Feed rates, load windows, backlog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import bindings as b
from tidemark.catalog.sql import FACTS, KEPT, LOG, MINUTES, SAMPLES, query, r4, share
from tidemark.functions.stats import pearson
from tidemark.operators import load, parse

Q: dict = {}
COVER = 0.05


def register(name: str, sql: str | None):
    def add(fn):
        Q[name] = (fn, sql)
        return fn

    return add


@register(
    "rate_per_second",
    f"""WITH s AS (SELECT epoch_us(ts) // 1000000 AS t, event_type FROM events), b AS (SELECT min(t) AS lo, max(t) AS hi FROM s),
grid AS (SELECT unnest(range(lo + 1, hi)) AS t FROM b), names AS (SELECT * FROM (VALUES ('all'), ('purchase')) v(series)),
n AS (SELECT series, g.t, count(s.t) AS n FROM grid g CROSS JOIN names LEFT JOIN s ON s.t = g.t AND (series = 'all' OR s.event_type = series) GROUP BY ALL)
SELECT series, count(*) AS n, {r4('avg(n)')} AS mean, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95, quantile_disc(n, 0.99) AS p99, max(n) AS max FROM n GROUP BY 1""",
)
def rate_per_second(spark, sf):
    events = b.load(spark, sf, "events")
    return load.rate_summary(events, F.col("ts"), {"all": F.lit(True), "purchase": F.col("event_type") == "purchase"})


@register("rate_per_minute", "SELECT CAST(epoch_us(ts) // 60000000 * 60 AS BIGINT) AS t, event_type, count(*) AS n FROM events GROUP BY ALL")
def rate_per_minute(spark, sf):
    return load.per_period(b.load(spark, sf, "events"), F.col("ts"), 60, ["event_type"])


@register("event_type_shares", f"SELECT event_type AS category, count(*) AS count, {share('count(*)', '(SELECT count(*) FROM events)')} AS share FROM events GROUP BY 1")
def event_type_shares(spark, sf):
    return load.shares(b.load(spark, sf, "events"), F.col("event_type"))


@register("user_class_shares", query(LOG, f"SELECT user_class AS category, count(*) AS count, {share('count(*)', '(SELECT count(*) FROM edits)')} AS share FROM edits GROUP BY 1"))
def user_class_shares(spark, sf):
    return load.shares(parse.edits(b.parsed_log(spark, sf)), F.col("user_class"))


@register("top_25_users", f"SELECT CAST(user_id AS VARCHAR) AS category, count(*) AS count, {share('count(*)', '(SELECT count(*) FROM events)')} AS share FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def top_25_users(spark, sf):
    return load.top(load.shares(b.load(spark, sf, "events"), F.col("user_id").cast("string")), 25)


@register("first_examples", query(LOG, "SELECT off, rev_id FROM tags WHERE k % 4 IN (1, 2) AND wiki = 'enwiki' ORDER BY off LIMIT 5"))
def first_examples(spark, sf):
    tags = parse.tag_changes(b.parsed_log(spark, sf)).where(F.array_contains("added", "mw-reverted"))
    return tags.select(F.col("offset").alias("off"), "rev_id").orderBy("off").limit(5)


MINUTE_COLS = f"SELECT epoch_us(t) // 1000000 AS t_s, {r4('feed')} AS feed, replicas, lag FROM minutes"


def minutes(spark, sf):
    return load.rates(b.load_samples(spark, sf))


def kept_messages(spark, sf):
    """Scored messages as they arrive: JSON with the decision, some of them unreadable."""
    keep = F.to_json(F.struct(F.struct((F.col("k") % 3 != 0).alias("keep")).alias("filter")))
    good = b.facts(spark, sf).select(F.col("ts").alias("arrived"), keep.alias("value"), "offset")
    junk = good.where("offset % 50 = 0").withColumn("value", F.lit('{"filter":'))
    return good.unionByName(junk)


@register("feed_per_minute", query(MINUTES, MINUTE_COLS))
def feed_per_minute(spark, sf):
    from tidemark.functions.stats import round_half_up

    return minutes(spark, sf).select(F.unix_seconds("t").alias("t_s"), round_half_up(F.col("feed")).alias("feed"), "replicas", "lag")


@register("recording_gaps", query(MINUTES, "SELECT epoch_us(p) // 1000000 AS from_s, epoch_us(t) // 1000000 AS to_s, CAST(floor(step / 60 + 0.5) AS BIGINT) AS minutes FROM (SELECT *, lag(t) OVER (ORDER BY t) AS p FROM steps) WHERE step > 180"))
def recording_gaps(spark, sf):
    gaps = load.sample_gaps(b.load_samples(spark, sf))
    return gaps.select(F.unix_seconds("gap_from").alias("from_s"), F.unix_seconds("gap_to").alias("to_s"), "minutes")


@register("kept_per_minute", query(f"{FACTS}, {KEPT}", 'SELECT m AS t, all_n AS "all", kept_n AS kept FROM kept'))
def kept_per_minute(spark, sf):
    return load.kept_per_minute(kept_messages(spark, sf))


KEPT_MINUTES = f"""{MINUTES}, {KEPT}, kept_minutes AS (
  SELECT m.*, coalesce((SELECT sum(kept_n) FROM kept k WHERE k.m BETWEEN epoch_us(m.t) // 60000000 * 60 - 300 AND epoch_us(m.t) // 60000000 * 60 - 60), 0)::DOUBLE / 5 AS kept FROM minutes m)"""


@register("trailing_kept_rate", query(KEPT_MINUTES, "SELECT epoch_us(t) // 1000000 AS t_s, kept FROM kept_minutes"))
def trailing_kept_rate(spark, sf):
    rows = load.attach_kept(minutes(spark, sf), load.kept_per_minute(kept_messages(spark, sf)))
    return rows.select(F.unix_seconds("t").alias("t_s"), "kept")


def window_sql(size: int) -> str:
    return f"""SELECT epoch_us(t) // {size * 60_000_000} * {size * 60} AS start, count(*) AS minutes, {r4('avg(feed)')} AS feed, {r4('avg(replicas)')} AS replicas, max(lag) AS max_lag, {r4('avg(kept)')} AS kept
FROM kept_minutes GROUP BY 1 HAVING count(*) >= {size} * {COVER}::DOUBLE"""


def kept_minutes(spark, sf):
    return load.attach_kept(minutes(spark, sf), load.kept_per_minute(kept_messages(spark, sf)))


@register("load_windows_30_minutes", query(KEPT_MINUTES, window_sql(30)))
def load_windows_30_minutes(spark, sf):
    return load.windows(kept_minutes(spark, sf), 30, COVER)


@register("load_windows_60_minutes", query(KEPT_MINUTES, window_sql(60)))
def load_windows_60_minutes(spark, sf):
    return load.windows(kept_minutes(spark, sf), 60, COVER)


@register("feed_replica_correlation", query(KEPT_MINUTES, f"SELECT {r4('corr(feed, replicas)')} AS feed_vs_replicas, {r4('corr(kept, replicas)')} AS kept_vs_replicas, count(*) AS windows FROM ({window_sql(30)})"))
def feed_replica_correlation(spark, sf):
    half = load.windows(kept_minutes(spark, sf), 30, COVER)
    return half.agg(pearson(F.col("feed"), F.col("replicas")).alias("feed_vs_replicas"), pearson(F.col("kept"), F.col("replicas")).alias("kept_vs_replicas"), F.count("*").alias("windows"))


@register(
    "load_report",
    query(KEPT_MINUTES, f"""SELECT (SELECT {r4('(epoch(max(t)) - epoch(min(t))) / 3600.0')} FROM samples) AS hours_spanned, (SELECT count(*) FROM minutes) AS minutes_recorded, (SELECT min(replicas) FROM minutes) AS replicas_min, (SELECT max(replicas) FROM minutes) AS replicas_max,
  (SELECT start FROM ({window_sql(60)}) ORDER BY feed DESC, start LIMIT 1) AS busiest_hour, (SELECT start FROM ({window_sql(60)}) ORDER BY feed, start LIMIT 1) AS quietest_hour,
  (SELECT start FROM ({window_sql(60)}) WHERE kept IS NOT NULL ORDER BY kept DESC, start LIMIT 1) AS busiest_kept_hour, (SELECT start FROM ({window_sql(60)}) WHERE kept IS NOT NULL ORDER BY kept, start LIMIT 1) AS quietest_kept_hour,
  (SELECT CAST(floor(epoch(min(t))) AS BIGINT) FROM samples) AS from_s, (SELECT CAST(floor(epoch(max(t))) AS BIGINT) FROM samples) AS to_s,
  (SELECT {r4('corr(feed, replicas)')} FROM ({window_sql(30)})) AS feed_vs_replicas, (SELECT {r4('corr(kept, replicas)')} FROM ({window_sql(30)})) AS kept_vs_replicas"""),
)
def load_report(spark, sf):
    return load.load_report(b.load_samples(spark, sf), kept_minutes(spark, sf), COVER)


@register(
    "trailing_15_point_mean",
    query(KEPT_MINUTES, f"""SELECT t_s, {r4('avg(kept)')} AS trailing FROM (SELECT a.t_s, b.kept FROM n a JOIN n b ON b.i BETWEEN a.i - 14 AND a.i AND a.t - b.t <= INTERVAL 15 MINUTES) GROUP BY 1""").replace("\nSELECT t_s,", ", n AS (SELECT t, epoch_us(t) // 1000000 AS t_s, kept, row_number() OVER (ORDER BY t) AS i FROM kept_minutes)\nSELECT t_s,"),
)
def trailing_15_point_mean(spark, sf):
    from tidemark.functions.stats import round_half_up

    rows = load.trailing_mean(kept_minutes(spark, sf), "kept")
    return rows.select(F.unix_seconds("t").alias("t_s"), round_half_up(F.col("trailing")).alias("trailing"))


BACKLOG = """WITH moves AS (SELECT epoch_us(ts) // 1000000 AS t, 1 AS d FROM events UNION ALL
  SELECT epoch_us(ts) // 1000000 + 60 + event_id * 7919 % 3600, -1 FROM events),
per_second AS (SELECT t, sum(d) AS d FROM moves GROUP BY 1), backlog AS (SELECT t, CAST(sum(d) OVER (ORDER BY t) AS BIGINT) AS lag FROM per_second)"""


def moves(spark, sf):
    events = b.load(spark, sf, "events")
    wait = F.make_dt_interval(secs=(60 + F.col("event_id") * 7919 % 3600).cast("decimal(18,6)"))
    return events.select(F.col("ts").alias("at")), events.select((F.col("ts") + wait).alias("at"))


@register("backlog_series", f"{BACKLOG} SELECT t, lag FROM backlog")
def backlog_series(spark, sf):
    return load.backlog(*moves(spark, sf))


@register("backlog_peak", f"{BACKLOG} SELECT max(lag) AS peak, min(t) FILTER (lag = (SELECT max(lag) FROM backlog)) AS first_peak_s FROM backlog")
def backlog_peak(spark, sf):
    series = load.backlog(*moves(spark, sf))
    return series.agg(F.max("lag").alias("peak"), (-F.max_by(-F.col("t"), F.struct("lag", -F.col("t")))).alias("first_peak_s"))
