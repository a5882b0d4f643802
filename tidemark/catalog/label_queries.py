"""Labels, account facts, the trust filter, and what it costs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.catalog import bindings as b
from tidemark.catalog.sql import ACCOUNTS, LOG, labels as label_sql, query, r4, share, wilson
from tidemark.functions import change
from tidemark.operators import audit, enrich, labels, load, parse, quantiles, sampling, scoring
from tidemark.plans import jobs
from tidemark.session import stored

Q: dict = {}

# The test log is far thinner than a live feed; a hole is twenty minutes of silence.
GAP_MS = 20 * labels.MINUTE_MS
RULES = replace(labels.LIVE, outage_gap_ms=GAP_MS)
# Short enough that holes, deletions and reverts all decide some labels.
SHORT = replace(RULES, window_ms=2 * labels.HOUR_MS)
LONG_SQL, SHORT_SQL = label_sql(GAP_MS), label_sql(GAP_MS, SHORT.window_ms)


def register(name: str, sql: str | None):
    def add(fn):
        Q[name] = (fn, sql)
        return fn

    return add


LABEL_ROWS = """SELECT rev_id, title, edit_ms, label, tag_ms, CAST(floor((tag_ms - edit_ms) / 1000.0 + 0.5) AS BIGINT) AS delay_seconds, source_offset FROM labels_"""


def label_rows(spark, sf, rules):
    return labels.label_log(b.parsed_log(spark, sf), rules).select(
        "rev_id", "title", F.unix_millis("edit_time").alias("edit_ms"), "label", F.unix_millis("reverted_at").alias("tag_ms"),
        F.col("revert_delay_seconds").alias("delay_seconds"), "source_offset",
    )


@register("labels_72h", query(f"{LOG}, {LONG_SQL}", LABEL_ROWS))
def labels_72h(spark, sf):
    return label_rows(spark, sf, RULES)


@register("labels_2h", query(f"{LOG}, {SHORT_SQL}", LABEL_ROWS))
def labels_2h(spark, sf):
    return label_rows(spark, sf, SHORT)


@register("labels_by_value", query(f"{LOG}, {SHORT_SQL}", "SELECT label, count(*) AS n FROM labels_ GROUP BY 1"))
def labels_by_value(spark, sf):
    return labels.label_log(b.parsed_log(spark, sf), SHORT).groupBy("label").agg(F.count("*").alias("n"))


@register("outages", query(f"{LOG}, {SHORT_SQL}", "SELECT off, from_ms, to_ms FROM holes"))
def outages(spark, sf):
    timed = labels.with_event_time(labels.timeline(b.parsed_log(spark, sf), RULES), RULES)
    return labels.outages(timed, RULES).select(F.col("offset").alias("off"), "from_ms", "to_ms")


@register("event_time_high_mark", query(f"{LOG}, {SHORT_SQL}", "SELECT off, dt_ms, greatest(mark, dt_ms) AS high_ms FROM ordered"))
def event_time_high_mark(spark, sf):
    timed = labels.with_event_time(labels.timeline(b.parsed_log(spark, sf), RULES), RULES)
    return timed.select(F.col("offset").alias("off"), F.col("dt").alias("dt_ms"), F.greatest("mark", "dt").alias("high_ms"))


@register("edits_inside_outages", query(f"{LOG}, {SHORT_SQL}", "SELECT count(*) FILTER (holed) AS holed, count(*) AS closed FROM label_rows"))
def edits_inside_outages(spark, sf):
    """Edits whose open window overlaps a hole, whatever else decides their label."""
    events = labels.timeline(b.parsed_log(spark, sf), SHORT)
    marked = labels.label(events.withColumn("kind", F.when(F.col("kind") == "edit", "edit")), SHORT)
    return marked.agg(F.count_if(F.col("label") == "incomplete").alias("holed"), F.count("*").alias("closed"))


WINDOW_SQL = """WITH starts AS (SELECT * FROM events WHERE event_type = 'purchase'), hits AS (SELECT * FROM events WHERE event_type = 'error'),
first_hit AS (SELECT s.event_id, min(h.event_id) AS hit FROM starts s LEFT JOIN hits h ON h.user_id = s.user_id AND h.event_id > s.event_id GROUP BY 1)
SELECT f.event_id, s.user_id, CASE WHEN h.ts <= s.ts + INTERVAL 72 HOURS THEN epoch_us(h.ts) // 1000 END AS hit_ms
FROM first_hit f JOIN starts s USING (event_id) LEFT JOIN hits h ON h.event_id = f.hit"""


@register("next_error_after_purchase", WINDOW_SQL)
def next_error_after_purchase(spark, sf):
    events = b.load(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    kind = F.col("event_type")
    found = labels.next_event(
        events, key="user_id", offset="event_id", time="ts", starts=kind == "purchase", ends=kind == "error", window="72 hours"
    )
    return found.select("event_id", "user_id", F.unix_millis("hit_time").alias("hit_ms"))


@register("reopened_purchases_by_hour", f"SELECT extract(hour FROM ts)::INTEGER AS hour, count(*) AS purchases, count(hit_ms) AS followed FROM ({WINDOW_SQL}) JOIN events USING (event_id) GROUP BY 1")
def reopened_purchases_by_hour(spark, sf):
    events = b.load(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    kind = F.col("event_type")
    found = labels.next_event(
        events, key="user_id", offset="event_id", time="ts", starts=kind == "purchase", ends=kind == "error", window="72 hours"
    )
    return found.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("purchases"), F.count("hit_time").alias("followed"))


@register(
    "returned_orders",
    """SELECT o_orderkey, o_custkey, CAST(epoch(first_return) AS BIGINT) AS returned_s, CAST(date_diff('day', o_orderdate, first_return) AS BIGINT) AS days
FROM (SELECT o.o_orderkey, any_value(o_custkey) AS o_custkey, any_value(o_orderdate) AS o_orderdate, min(l_shipdate) AS first_return
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l_returnflag = 'R' AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 365 DAYS GROUP BY 1)""",
)
def returned_orders(spark, sf):
    """Orders with their first return shipped within a year: lines are reduced per order before any pair could form."""
    orders = b.load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = b.load(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_shipdate")
    # Bounds depend on the order, so they are tested next to it; an order has few lines.
    day = F.when(F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")), F.col("l_shipdate"))
    first = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey", "o_custkey", "o_orderdate").agg(F.min(day).alias("at"))
    return first.select("o_orderkey", "o_custkey", F.unix_seconds("at").alias("returned_s"), F.datediff("at", "o_orderdate").cast("bigint").alias("days"))


# -- accounts and filter ----------------------------------------------------


def enriched(spark, sf):
    return with_accounts(spark, sf, b.parsed_log(spark, sf))


def with_accounts(spark, sf, parsed):
    return enrich.attach_accounts(parse.edits(parsed), b.accounts(spark, sf))


@register("edits_with_accounts", query(f"{LOG}, {ACCOUNTS}", "SELECT rev_id, user_class, found, CAST(epoch(registration) AS BIGINT) AS registered_s, editcount FROM enriched"))
def edits_with_accounts(spark, sf):
    a = F.col("account")
    return enriched(spark, sf).select("rev_id", "user_class", a.isNotNull().alias("found"), F.unix_seconds(a["registration"]).alias("registered_s"), a["editcount"].alias("editcount"))


@register("accounts_asked_and_found", query(f"{LOG}, {ACCOUNTS}", "SELECT count(DISTINCT usr) AS asked, count(DISTINCT usr) FILTER (found) AS found FROM enriched WHERE user_class = 'registered'"))
def accounts_asked_and_found(spark, sf):
    users = enriched(spark, sf).where("user_class = 'registered'").select("user", F.col("account").isNotNull().alias("found")).distinct()
    return users.agg(F.count("*").alias("asked"), F.count_if("found").alias("found"))


@register(
    "accounts_as_of_edit",
    query(
        LOG,
        """SELECT rev_id, CAST(epoch(CASE WHEN s.as_of >= make_timestamp(e.dt_ms * 1000) - INTERVAL 60 MINUTES THEN s.as_of END) AS BIGINT) AS as_of_s,
  CASE WHEN s.as_of >= make_timestamp(e.dt_ms * 1000) - INTERVAL 60 MINUTES THEN s.editcount END AS editcount
FROM (SELECT *, make_timestamp(dt_ms * 1000) AS dt, CASE WHEN user_class = 'registered' THEN usr END AS key FROM edits) e
LEFT JOIN (SELECT usr, date_trunc('second', ts) AS as_of, max(off % 1000) AS editcount FROM facts WHERE usr LIKE 'User %' AND event_type = 'view' GROUP BY ALL) s
  ON s.usr = e.key AND s.as_of = (SELECT max(date_trunc('second', f.ts)) FROM facts f WHERE f.usr = e.key AND f.event_type = 'view' AND date_trunc('second', f.ts) <= e.dt)""",
    ),
)
def accounts_as_of_edit(spark, sf):
    rows = enrich.attach_accounts_as_of(stored(parse.edits(b.parsed_log(spark, sf)), "edits"), b.account_snapshots(spark, sf))
    return rows.select("rev_id", F.unix_seconds("account_as_of").alias("as_of_s"), F.col("account.editcount").alias("editcount"))


@register(
    "account_age_at_edit",
    query(f"{LOG}, {ACCOUNTS}", f"SELECT rev_id, CASE WHEN found THEN {r4('(timestamp - epoch(registration)) / 86400.0')} END AS account_age_days, CASE WHEN found THEN registration IS NULL END AS age_unrecorded, length_new - coalesce(length_old, 0) AS size_delta, comment FROM enriched"),
)
def account_age_at_edit(spark, sf):
    return enrich.features(enriched(spark, sf)).select("rev_id", "account_age_days", "age_unrecorded", "size_delta", "comment")


@register("filter_decisions", query(f"{LOG}, {ACCOUNTS}", "SELECT rev_id, policy, rule, rule = 'kept' AS keep FROM decisions WHERE policy = 'extendedconfirmed'"))
def filter_decisions(spark, sf):
    return enrich.with_filter(enriched(spark, sf)).select("rev_id", "filter.policy", "filter.rule", "filter.keep")


@register("filter_decisions_per_policy", query(f"{LOG}, {ACCOUNTS}", "SELECT policy, rule, count(*) AS n FROM decisions GROUP BY ALL"))
def filter_decisions_per_policy(spark, sf):
    return enrich.per_policy(enriched(spark, sf)).groupBy("policy", "rule").agg(F.count("*").alias("n"))


@register("survivor_share", query(f"{LOG}, {ACCOUNTS}", f"SELECT count(*) AS classifiable, count(*) FILTER (rule = 'kept') AS kept, {share('count(*) FILTER (rule = ' + chr(39) + 'kept' + chr(39) + ')', 'count(*)')} AS survivor_share FROM decisions WHERE policy = 'extendedconfirmed'"))
def survivor_share(spark, sf):
    from tidemark.operators.ladder import survivor_share as shares

    return shares(enrich.per_policy(enriched(spark, sf)), "extendedconfirmed")


@register("routed_edits", query(f"{LOG}, {ACCOUNTS}", "SELECT rev_id, CASE WHEN rule = 'kept' THEN 'model' ELSE 'filter' END AS tier, CASE WHEN rule = 'kept' THEN 'scorer' ELSE 'filter:extendedconfirmed' END AS config, CASE WHEN rule <> 'kept' THEN false END AS revert, CASE WHEN rule <> 'kept' THEN 0.0::DOUBLE END AS p_revert FROM decisions WHERE policy = 'extendedconfirmed'"))
def routed_edits(spark, sf):
    scored = enrich.with_filter(enriched(spark, sf))
    return scoring.route(scored, "scorer").select("rev_id", "tier", "config", "revert", "p_revert")


TRADE = f"""SELECT policy, count(*) AS edits, count(*) FILTER (rule <> 'kept') AS dropped, count(*) FILTER (rule = 'bot') AS dropped_bot,
  count(*) FILTER (rule = 'trusted-account') AS dropped_trusted, {share("count(*) FILTER (rule <> 'kept')", "count(*)")} AS volume_removed,
  {share("count(*) FILTER (rule <> 'kept' AND user_class <> 'bot')", "count(*) FILTER (user_class <> 'bot')")} AS volume_removed_non_bot,
  {wilson("reverted_lost", "count(*) FILTER (reverted AND rule <> 'kept')", "count(*) FILTER (reverted)")},
  {share("count(*) FILTER (reverted)", "count(reverted)")} AS revert_rate_before,
  {share("count(*) FILTER (reverted AND rule = 'kept')", "count(*) FILTER (reverted IS NOT NULL AND rule = 'kept')")} AS revert_rate_after,
  count(*) FILTER (reverted AND rule = 'bot') AS lost_bot, count(*) FILTER (reverted AND rule = 'trusted-account') AS lost_trusted,
  (SELECT count(DISTINCT rev_id) FROM decisions o WHERE NOT EXISTS (SELECT 1 FROM labels_ k WHERE k.rev_id = o.rev_id)) AS open_edits
FROM (SELECT d.*, CASE l.label WHEN 'reverted' THEN true WHEN 'not-reverted' THEN false END AS reverted FROM decisions d JOIN labels_ l USING (rev_id)) GROUP BY policy"""


@register("filter_trade_off", query(f"{LOG}, {ACCOUNTS}, {LONG_SQL}", TRADE))
def filter_trade_off(spark, sf):
    return jobs.trade_off(b.parsed_log(spark, sf), b.accounts(spark, sf), RULES)


@register("filter_trade_off_2h", query(f"{LOG}, {ACCOUNTS}, {SHORT_SQL}", TRADE))
def filter_trade_off_2h(spark, sf):
    return jobs.trade_off(b.parsed_log(spark, sf), b.accounts(spark, sf), SHORT)


@register(
    "filter_trade_off_ranges",
    query(f"{LOG}, {ACCOUNTS}, {SHORT_SQL}", f"""SELECT policy AS family, min(v) AS volume_removed_low, max(v) AS volume_removed_high, min(lost) AS reverted_lost_rate_low, max(lost) AS reverted_lost_rate_high FROM (
  SELECT policy, timestamp // 604800 AS week, {share("count(*) FILTER (rule <> 'kept')", "count(*)")} AS v, {share("count(*) FILTER (label = 'reverted' AND rule <> 'kept')", "count(*) FILTER (label = 'reverted')")} AS lost
  FROM decisions JOIN labels_ USING (rev_id) GROUP BY ALL) GROUP BY 1"""),
)
def filter_trade_off_ranges(spark, sf):
    """The trade-off per week of edits, and its range over the weeks."""
    table = jobs.labelled_edits(b.parsed_log(spark, sf), b.accounts(spark, sf), SHORT).where("code IS NOT NULL")
    known = table.withColumn("reverted", F.when(F.col("code") != "gone", F.col("code") == "1")).withColumn("week", F.floor(F.col("timestamp") / 604_800))
    weekly = scoring.trade_off(enrich.per_policy(known), ["week"])
    return scoring.ranges(weekly, F.col("policy"), ["volume_removed", "reverted_lost_rate"])


@register("sampled_rows_in_tables", query(f"{LOG}, {ACCOUNTS}", "SELECT policy, count(*) AS found, count(*) FILTER (rule <> 'kept') AS dropped FROM decisions WHERE rev_id % 9 = 1 AND rev_id % 4 <> 3 GROUP BY 1"))
def sampled_rows_in_tables(spark, sf):
    """Judged rows looked up in several edit tables, some of which overlap."""
    rows = stored(enriched(spark, sf), "enriched")
    sample = rows.where("rev_id % 9 = 1").select("rev_id")
    found = audit.found_in(sample, rows.where("rev_id % 4 = 0"), rows.where("rev_id % 4 IN (1, 2)"), rows.where("rev_id % 4 = 2"))
    return enrich.per_policy(found).groupBy("policy").agg(F.count("*").alias("found"), F.count_if(F.col("rule") != "kept").alias("dropped"))


@register("filter_table_codes", query(f"{LOG}, {ACCOUNTS}, {SHORT_SQL}", "SELECT CASE label WHEN 'reverted' THEN '1' WHEN 'not-reverted' THEN '0' ELSE 'gone' END AS code, count(*) AS n FROM labels_ GROUP BY 1"))
def filter_table_codes(spark, sf):
    closed = jobs.labelled_edits(b.parsed_log(spark, sf), b.accounts(spark, sf), SHORT).where("code IS NOT NULL")
    return closed.groupBy("code").agg(F.count("*").alias("n"))


@register(
    "live_trade_off",
    query(f"{LOG}, {ACCOUNTS}, {SHORT_SQL}", f"""SELECT count(*) AS n, {share("count(*) FILTER (rule <> 'kept')", "count(*)")} AS volume_removed,
  {wilson("reverted_lost", "count(*) FILTER (label = 'reverted' AND rule <> 'kept')", "count(*) FILTER (label = 'reverted')")},
  {share("count(*) FILTER (label = 'reverted')", "count(*)")} AS revert_rate_before,
  {share("count(*) FILTER (label = 'reverted' AND rule = 'kept')", "count(*) FILTER (rule = 'kept')")} AS revert_rate_after
FROM decisions JOIN labels_ USING (rev_id) WHERE policy = 'extendedconfirmed' AND label IN ('reverted', 'not-reverted')"""),
)
def live_trade_off(spark, sf):
    """Decisions recorded at least once: every message is doubled, the first one counts."""
    parsed = jobs.parsed_once(b.parsed_log(spark, sf))
    scored = enrich.with_filter(with_accounts(spark, sf, parsed)).select("rev_id", "filter", "offset")
    twice = scored.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    messages = twice.select("rev_id", F.when(F.col("copy") == 0, F.col("filter")).otherwise(F.struct(F.lit("later").alias("policy"), F.lit(True).alias("keep"), F.lit("kept").alias("rule"))).alias("filter"), (F.col("offset") + F.col("copy")).alias("offset"))
    return audit.live_trade_off(audit.decisions_for(labels.label_log(parsed, SHORT), messages))


@register(
    "label_summary",
    query(f"{LOG}, {SHORT_SQL}", f"""SELECT count(*) AS labels, count(*) FILTER (label = 'reverted') AS reverted, count(*) FILTER (label = 'not-reverted') AS not_reverted,
  count(*) FILTER (label = 'deleted') AS deleted, count(*) FILTER (label = 'incomplete') AS incomplete,
  {wilson("revert", "count(*) FILTER (label = 'reverted')", "count(*) FILTER (label IN ('reverted', 'not-reverted'))", with_n=False)},
  min(edit_ms) AS first_edit_ms, max(edit_ms) AS last_edit_ms FROM labels_"""),
)
def label_summary(spark, sf):
    return audit.label_summary(labels.label_log(b.parsed_log(spark, sf), SHORT))


QUANT = "quantile_disc({v}, {p})"


@register(
    "revert_delay_summary",
    query(f"{LOG}, {LONG_SQL}", f"""SELECT count(*) AS n, {r4('avg(d)')} AS mean, quantile_disc(d, 0.5) AS p50, quantile_disc(d, 0.95) AS p95, quantile_disc(d, 0.99) AS p99, max(d) AS max
FROM (SELECT CAST(floor((tag_ms - edit_ms) / 1000.0 + 0.5) AS BIGINT) AS d FROM labels_ WHERE tag_ms IS NOT NULL)"""),
)
def revert_delay_summary(spark, sf):
    """Whole seconds within the window: at most 259,201 distinct delays."""
    rows = labels.label_log(b.parsed_log(spark, sf), RULES)
    return quantiles.summarise(rows, [], "revert_delay_seconds")


@register(
    "value_percentiles",
    f"SELECT event_type, count(*) AS n, {r4('avg(value)')} AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max FROM events GROUP BY 1",
)
def value_percentiles(spark, sf):
    """Unrounded doubles: distinct values may be as many as rows, so the order is sliced."""
    return quantiles.summarise(b.load(spark, sf, "events"), ["event_type"], "value")


# -- agreement ---------------------------------------------------------------

AGREE = f"""table_ AS (SELECT rev_id, CASE WHEN rev_id % 37 = 0 THEN 'gone' WHEN rev_id % 53 = 0 OR EXISTS (SELECT 1 FROM reverts r WHERE r.rev_id = e.rev_id) THEN 'reverted' ELSE 'not-reverted' END AS api FROM edits e),
first_revert AS (SELECT rev_id, min(dt_ms) AS first_ms FROM reverts GROUP BY 1),
agree_rows AS (SELECT t.rev_id, t.api, l.label AS stream, first_ms, CASE WHEN l.label IS NOT NULL AND api <> 'gone' AND api <> l.label THEN
  CASE WHEN api = 'reverted' AND first_ms IS NULL THEN 'tag never seen in the log' WHEN api = 'reverted' AND first_ms > l.edit_ms + {SHORT.window_ms} THEN 'reverted after the window'
    WHEN api = 'not-reverted' AND l.label = 'reverted' THEN 'tag no longer present' ELSE 'other' END END AS cause
  FROM table_ t LEFT JOIN labels_ l USING (rev_id) LEFT JOIN first_revert f USING (rev_id))"""


def agreement_rows(spark, sf):
    parsed = jobs.parsed_once(b.parsed_log(spark, sf))
    reverts = labels.timeline(parsed, SHORT).where("kind = 'revert'").select("rev_id", F.col("dt").alias("dt_ms"))
    ever = reverts.select("rev_id").distinct().withColumn("tagged", F.lit(True))
    e = F.col("rev_id")
    code = F.when(e % 37 == 0, "gone").when((e % 53 == 0) | F.coalesce("tagged", F.lit(False)), "1").otherwise("0")
    table = parse.edits(parsed).select("rev_id").join(ever, "rev_id", "left").select("rev_id", code.alias("reverted"))
    return audit.agreement_rows(labels.label_log(parsed, SHORT), table, reverts, SHORT.window_ms)


AGREE_CTES = f"{LOG}, {SHORT_SQL}, {AGREE}"


@register("label_agreement", query(AGREE_CTES, f"""SELECT count(*) AS table_rows, count(stream) AS labelled, count(*) FILTER (stream IS NOT NULL AND NOT (api = 'gone' AND stream IN ('reverted', 'not-reverted'))) AS compared,
  count(*) FILTER (api = stream) AS agree, {wilson('agreement', 'count(*) FILTER (api = stream)', "count(*) FILTER (stream IS NOT NULL AND NOT (api = 'gone' AND stream IN ('reverted', 'not-reverted')))", with_n=False)} FROM agree_rows"""))
def label_agreement(spark, sf):
    return audit.agreement(agreement_rows(spark, sf))


@register("label_confusion", query(AGREE_CTES, "SELECT api, stream, count(*) AS n FROM agree_rows WHERE stream IS NOT NULL GROUP BY ALL"))
def label_confusion(spark, sf):
    return audit.confusion(agreement_rows(spark, sf))


@register("label_disagreement_causes", query(AGREE_CTES, "SELECT cause, count(*) AS n FROM agree_rows WHERE cause IS NOT NULL GROUP BY ALL"))
def label_disagreement_causes(spark, sf):
    return audit.causes(agreement_rows(spark, sf))


# -- probes of the tag stream ------------------------------------------------


@register("reverted_edits_seen_before", query(LOG, "SELECT t.off, t.rev_id FROM tags t JOIN edits e ON e.rev_id = t.rev_id AND e.off < t.off WHERE t.wiki = 'enwiki' AND t.k % 4 IN (1, 2)"))
def reverted_edits_seen_before(spark, sf):
    parsed = b.parsed_log(spark, sf)
    tags = parse.tag_changes(parsed).where(change.is_reverted(F.col("added")))
    return audit.seen_before(tags, parse.edits(parsed)).select(F.col("offset").alias("off"), "rev_id")


@register(
    "added_revert_tag_counts",
    query(LOG, """SELECT tag, count(*) AS n, count(*) FILTER (namespace = 0) AS in_articles FROM (
  SELECT namespace, CASE k % 4 WHEN 0 THEN 'mw-undo' WHEN 3 THEN 'mw-rollback' ELSE 'mw-reverted' END AS tag FROM tags WHERE wiki = 'enwiki') GROUP BY 1"""),
)
def added_revert_tag_counts(spark, sf):
    tags = parse.tag_changes(b.parsed_log(spark, sf))
    rows = tags.select("namespace", F.explode(change.revert_tags(F.col("added"))).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.count_if(F.col("namespace") == 0).alias("in_articles"))


_D = "(dt_ms - target_ms) / 1000.0"


@register(
    "revert_delay_coverage",
    query(LOG, "SELECT count(*) AS n, " + ", ".join(f"{share(f'count(*) FILTER ({_D} <= {s})', 'count(*)')} AS within_{n}" for n, s in audit.DELAY_BOUNDS.items()) + " FROM tags WHERE wiki = 'enwiki' AND k % 4 IN (1, 2) AND namespace = 0"),
)
def revert_delay_coverage(spark, sf):
    tags = parse.tag_changes(b.parsed_log(spark, sf)).where(change.is_reverted(F.col("added")) & (F.col("namespace") == 0))
    delay = (F.unix_millis("dt") - F.unix_millis("rev_timestamp")) / 1000
    return audit.delay_coverage(tags.select(delay.alias("delay_seconds")))


@register("edits_by_label_age", query(LOG, "SELECT CASE WHEN h < 72 THEN 'young' WHEN h > 96 THEN 'old' ELSE 'eligible' END AS age_group, count(*) AS n FROM (SELECT (epoch_ms(TIMESTAMP '2024-01-20') - dt_ms) / 3600000.0 AS h FROM edits WHERE user_class <> 'bot') GROUP BY 1"))
def edits_by_label_age(spark, sf):
    edits = parse.edits(b.parsed_log(spark, sf)).where("user_class <> 'bot'")
    as_of = F.lit("2024-01-20").cast("timestamp")
    return enrich.by_age(edits, as_of).groupBy("age_group").agg(F.count("*").alias("n"))


@register("closed_window_guard", query(LOG, "SELECT count(*) AS edits, min(timestamp) AS first_s, max(timestamp) AS last_s FROM edits"))
def closed_window_guard(spark, sf):
    edits = enrich.require_closed(parse.edits(b.parsed_log(spark, sf)), F.lit("2024-02-05").cast("timestamp"))
    return edits.agg(F.count("*").alias("edits"), F.min("timestamp").alias("first_s"), F.max("timestamp").alias("last_s"))


@register("label_codes_from_tags", query(LOG, "SELECT CASE WHEN tag_off IS NULL THEN 'gone' WHEN k2 % 4 IN (1, 2, 3) THEN '1' ELSE '0' END AS code, count(*) AS n FROM (SELECT e.rev_id, arg_max(t.off, t.off) AS tag_off, arg_max(t.k, t.off) AS k2 FROM edits e LEFT JOIN tags t ON t.rev_id = e.rev_id AND t.wiki = 'enwiki' GROUP BY 1) GROUP BY 1"))
def label_codes_from_tags(spark, sf):
    """The last tag list seen of a revision, as a snapshot of its present tags."""
    parsed = b.parsed_log(spark, sf)
    last = parse.last_by_key(parse.tag_changes(parsed).select("rev_id", "tags", "offset"), "rev_id", "offset").drop("offset")
    rows = parse.edits(parsed).select("rev_id").join(last, "rev_id", "left")
    code = change.label_code_from_tags(F.col("tags").isNotNull(), F.col("tags"))
    return rows.groupBy(code.alias("code")).agg(F.count("*").alias("n"))


@register("merged_captures", "SELECT event_id, row_number() OVER (ORDER BY ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, event_id) - 1 AS offset FROM events")
def merged_captures(spark, sf):
    """Changes and tag changes captured apart, merged into one log with new offsets."""
    raw = b.facts(spark, sf).select("offset", F.col("ts").alias("dt"), F.col("offset").cast("string").alias("value"), "event_type")
    both = labels.merged(raw.where("event_type <> 'error'"), raw.where("event_type = 'error'"))
    return both.select(F.col("value").cast("bigint").alias("event_id"), "offset")


@register(
    "label_noise",
    query(LOG, f"""SELECT count(*) AS labelled, count(*) FILTER (v = 'u') AS unsure,
  {wilson("reverted_not_vandalism", "count(*) FILTER (reverted AND v = 'n')", "count(*) FILTER (reverted AND v <> 'u')")},
  {wilson("kept_but_vandalism", "count(*) FILTER (NOT reverted AND v = 'y')", "count(*) FILTER (NOT reverted AND v <> 'u')")},
  0.0815::DOUBLE AS population_rate,
  {r4("0.0815 * (1 - count(*) FILTER (reverted AND v = 'n')::DOUBLE / count(*) FILTER (reverted AND v <> 'u')) + (1 - 0.0815) * (1 - count(*) FILTER (NOT reverted AND v = 'y')::DOUBLE / count(*) FILTER (NOT reverted AND v <> 'u'))")} AS population_agreement
FROM (SELECT k % 4 = 1 AS reverted, CASE WHEN k % 9 = 0 THEN 'u' WHEN k % 5 < 2 THEN 'y' ELSE 'n' END AS v FROM edits WHERE rev_id % 41 <> 0 AND k % 17 <> 0)"""),
)
def label_noise(spark, sf):
    """A judged sheet against its key; rows that are not in the key or not judged are set aside."""
    edits = parse.edits(b.parsed_log(spark, sf)).select("rev_id")
    k = b.facts(spark, sf).select(F.col("offset").alias("rev_id"), "k")
    base = edits.join(k, "rev_id")
    verdict = F.when(F.col("k") % 17 == 0, "?").when(F.col("k") % 9 == 0, "u").when(F.col("k") % 5 < 2, "Y").otherwise("n")
    sheet = base.select("rev_id", verdict.alias("vandalism"))
    key = base.where("rev_id % 41 <> 0").select("rev_id", (F.col("k") % 4 == 1).alias("reverted"))
    usable = audit.judged(sheet, key).where("problem IS NULL")
    return audit.label_noise(usable, 0.0815)


@register("sheet_problems", query(LOG, "SELECT CASE WHEN rev_id % 41 = 0 THEN 'not in key' ELSE 'vandalism must be y/n/u' END AS problem, count(*) AS n FROM edits WHERE rev_id % 41 = 0 OR k % 17 = 0 GROUP BY 1"))
def sheet_problems(spark, sf):
    edits = parse.edits(b.parsed_log(spark, sf)).select("rev_id")
    k = b.facts(spark, sf).select(F.col("offset").alias("rev_id"), "k")
    base = edits.join(k, "rev_id")
    sheet = base.select("rev_id", F.when(F.col("k") % 17 == 0, "?").otherwise("n").alias("vandalism"))
    key = base.where("rev_id % 41 <> 0").select("rev_id", F.lit(True).alias("reverted"))
    return audit.judged(sheet, key).where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))


@register(
    "population_statistics",
    query(f"{LOG}, {LONG_SQL}", f"""SELECT count(*) AS eligible, count(*) FILTER (label NOT IN ('reverted', 'not-reverted')) AS gone, {wilson("revert", "count(*) FILTER (label = 'reverted')", "count(*) FILTER (label IN ('reverted', 'not-reverted'))")},
  {share("count(*) FILTER (label NOT IN ('reverted', 'not-reverted'))", "count(*)")} AS gone_rate FROM labels_"""),
)
def population_statistics(spark, sf):
    return audit.population(labels.label_log(b.parsed_log(spark, sf), RULES))


# -- samples -------------------------------------------------------------------


@register("seeded_sample", "SELECT doc_id, lang FROM documents ORDER BY sha256('7:' || doc_id) LIMIT 100")
def seeded_sample(spark, sf):
    return sampling.sample(b.load(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 100, 7)


@register(
    "stratified_sample",
    """SELECT quality, doc_id, row_number() OVER (ORDER BY sha256('8:' || doc_id)) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY sha256('7:' || doc_id)) AS n FROM labels) WHERE n <= 40""",
)
def stratified_sample(spark, sf):
    rows = sampling.stratified(b.load(spark, sf, "labels").select("doc_id", "quality"), ["quality"], "doc_id", 40, 7)
    return rows.select("quality", "doc_id", F.col("position").cast("bigint").alias("position"))


@register("drift_subset", query("eval_docs AS (SELECT DISTINCT doc_id FROM labels)", "SELECT doc_id FROM eval_docs ORDER BY sha256('40417:' || doc_id) LIMIT 50"))
def drift_subset(spark, sf):
    return sampling.subset(b.load(spark, sf, "labels"), "doc_id", 50, 40417)


@register("evaluation_set", query(f"{LOG}, {ACCOUNTS}, {LONG_SQL}", "SELECT 'sealed' AS \"set\", rev_id, user_class, size_delta, label FROM (SELECT d.rev_id, d.user_class, d.length_new - coalesce(d.length_old, 0) AS size_delta, label FROM decisions d JOIN labels_ USING (rev_id) WHERE policy = 'extendedconfirmed' AND rule = 'kept' ORDER BY sha256('11:' || d.rev_id) LIMIT 200)"))
def evaluation_set(spark, sf):
    """Sampled among edits whose label window has closed."""
    return drawn_features(spark, sf).select("set", "rev_id", "user_class", "size_delta", "label")


def drawn_features(spark, sf):
    parsed = jobs.parsed_once(b.parsed_log(spark, sf))
    labelled = labels.label_log(parsed, RULES).select("rev_id", "label")
    # Labels shrink so well that they pass for small; there is one for each edit, so they are not broadcast.
    edits = parse.last_by_key(parse.edits(parsed), "rev_id", "offset").join(labelled.hint("shuffle_merge"), "rev_id")
    scored = enrich.with_filter(enrich.attach_accounts(edits, b.accounts(spark, sf))).where("filter.keep")
    drawn = sampling.sample(scored, "rev_id", 200, 11)
    return enrich.features(drawn, extra=("label",)).withColumn("set", F.lit("sealed"))
