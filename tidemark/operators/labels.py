"""One label per edit from what the log says later, inside an event-time window.

The log is read in offset order. An edit is labelled once event time has passed
its window plus a grace period:

reverted      the first revert tag seen after the edit lies inside the window
deleted       its page was deleted inside the window
incomplete    the log has a hole inside the window
not-reverted  none of these

Each "first one after the edit" is a running value over the log (operators/scan),
so an edit is never paired with all events of its key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import change
from tidemark.functions.stats import whole
from tidemark.operators import parse
from tidemark.operators.scan import ROWS_PER_BUCKET, numbered, offset_bucket, running
from tidemark.session import stored

HOUR_MS = 3_600_000
MINUTE_MS = 60_000


@dataclass(frozen=True)
class LabelRules:
    """Window, grace and outage gap in milliseconds of event time."""

    wiki: str = "enwiki"
    window_ms: int = 72 * HOUR_MS
    grace_ms: int = 10 * MINUTE_MS
    outage_gap_ms: int = 2 * MINUTE_MS
    rows_per_bucket: int = ROWS_PER_BUCKET


LIVE = LabelRules()
# A replayed single wiki idles for minutes at night.
REPLAY = LabelRules(outage_gap_ms=30 * MINUTE_MS)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def timeline(parsed: DataFrame, rules: LabelRules = LIVE) -> DataFrame:
    """The readable log cut down to what labels need: one narrow row per event.

    ``kind`` is edit / revert / deletion, or NULL for events that only move time.
    """
    c, t = F.col("change"), F.col("tags")
    edit = (
        (c["wiki"] == rules.wiki)
        & change.is_classifiable(c["type"], c["namespace"])
        & c["rev_id"].isNotNull()
        & c["timestamp"].isNotNull()
    )
    deletion = (c["wiki"] == rules.wiki) & change.is_page_deletion(c["type"], c["log_type"], c["log_action"], c["title"])
    revert = (t["wiki"] == rules.wiki) & change.is_reverted(change.added_tags(t["tags"], t["prior_tags"]))
    kind = F.when(edit, "edit").when(deletion, "deletion").when(revert, "revert")
    return parse.readable(parsed).where(F.col("dt").isNotNull()).select(
        "offset",
        epoch_ms(F.col("dt")).alias("dt"),
        kind.alias("kind"),
        F.coalesce(c["rev_id"], t["rev_id"]).alias("rev_id"),
        F.coalesce(c["title"], F.lit("")).alias("title"),
        F.when(edit, c["timestamp"] * 1000).alias("edit_ms"),
    )


def with_event_time(events: DataFrame, rules: LabelRules = LIVE) -> DataFrame:
    """Add the running maximum of event time before each event, and of edit times up to it.

    ``mark`` is the event time known before the row; ``due_ms`` is the latest edit
    time at or before it in the queue, since labels leave the queue in order.
    """
    bucket = offset_bucket(F.col("offset"), rules.rows_per_bucket)
    out = running(
        events,
        bucket=bucket,
        order=[F.col("offset")],
        values={"mark": ("max", F.col("dt")), "due_ms": ("max", F.col("edit_ms"))},
    )
    return out.withColumn("due_ms", F.greatest("due_ms", "edit_ms"))


def outages(timed: DataFrame, rules: LabelRules = LIVE) -> DataFrame:
    """Holes in the log: event time jumps past the running maximum by more than the gap."""
    return timed.where(F.col("dt") - F.col("mark") > rules.outage_gap_ms).select(
        "offset", F.col("mark").alias("from_ms"), F.col("dt").alias("to_ms")
    )


def _next_in_log(timed: DataFrame, keys: list[str], values: dict, rules: LabelRules) -> DataFrame:
    return running(
        timed,
        keys=keys,
        bucket=offset_bucket(F.col("offset"), rules.rows_per_bucket),
        order=[F.col("offset")],
        values=values,
        after=True,
    )


def label(events: DataFrame, rules: LabelRules = LIVE) -> DataFrame:
    """Labels of all edits whose window has closed by the end of ``events``."""
    # The log is parsed once into this narrow table; later steps only need the few
    # rows that are edits, reverts, deletions or holes.
    events = stored(events, "timeline")
    timed = with_event_time(events, rules)
    return labelled(timed.where(F.col("kind").isNotNull() | is_hole(rules)), events.agg(F.max("dt")).scalar(), rules)


def is_hole(rules: LabelRules) -> Column:
    """Event time jumps by more than the outage gap at this row."""
    return F.coalesce(F.col("dt") - F.col("mark") > rules.outage_gap_ms, F.lit(False))


def closing_ms(rules: LabelRules) -> Column:
    """The event time at which an edit's label leaves the queue."""
    return F.col("due_ms") + rules.window_ms + rules.grace_ms


def labelled(timed: DataFrame, last: Column, rules: LabelRules = LIVE) -> DataFrame:
    """Labels of the edits among ``timed`` that have closed by event time ``last``.

    ``timed`` holds edits, reverts, deletions and holes with their ``mark`` and ``due_ms``, one
    row for each offset; a part of the log will do that has, for each of its edits, all that follows on it.
    """
    # The next hole after each event. Holes are ordered, so the first one after
    # an edit decides whether any of them reaches into its window.
    holed = _next_in_log(timed, [], {"hole": ("min", F.when(is_hole(rules), F.struct("offset", F.col("mark").alias("from_ms"))))}, rules)
    facts = stored(holed.where(F.col("kind").isNotNull()), "facts")
    seen = F.struct("offset", "dt", "mark")

    by_rev = facts.where(F.col("kind").isin("edit", "revert"))
    by_rev = _next_in_log(by_rev, ["rev_id"], {"tag": ("min", F.when(F.col("kind") == "revert", seen))}, rules)
    edits = parse.first_by_key(by_rev.where(F.col("kind") == "edit"), "rev_id", "offset")

    columns = ["offset", "kind", "rev_id", "title", "dt", "mark", "edit_ms", "due_ms", "hole", "tag"]
    dropped = facts.where(F.col("kind") == "deletion").withColumn("tag", F.lit(None).cast(edits.schema["tag"].dataType))
    by_title = edits.select(columns).unionByName(dropped.select(columns))
    is_deletion = F.col("kind") == "deletion"
    prompt = F.coalesce(F.col("mark") - F.col("dt") < rules.grace_ms, F.lit(True))
    by_title = _next_in_log(
        by_title,
        ["title"],
        {
            # One that is less than the grace behind is seen in time if it lies in the window at all.
            "prompt": ("min", F.when(is_deletion & prompt, F.col("dt"))),
            "late": ("min", F.when(is_deletion & ~prompt, seen)),
        },
        rules,
    )
    closing = closing_ms(rules)
    ends = F.col("edit_ms") + rules.window_ms
    in_window = lambda hit: F.coalesce((hit["dt"] <= ends) & (hit["mark"] < closing), F.lit(False))
    reverted = in_window(F.col("tag"))
    # Behind an edit that is itself in order, the first late deletion seen in time lies in the
    # window; an edit behind a later one needs a look at all late deletions of its page.
    behind = by_title.where((F.col("kind") == "edit") & (F.col("due_ms") > F.col("edit_ms"))).select("offset", "title", "rev_id", closing.alias("closing"), ends.alias("ends"))
    hits = late_hits(behind, facts.where((F.col("kind") == "deletion") & ~prompt).select("offset", "title", "dt", "mark"), rules)
    by_title = by_title.join(hits.withColumn("late_hit", F.lit(True)), "rev_id", "left")
    deleted = F.coalesce(F.col("prompt") <= ends, F.lit(False)) | in_window(F.col("late")) | F.coalesce("late_hit", F.lit(False))
    incomplete = F.coalesce(F.col("hole.from_ms") < closing, F.lit(False))
    return (
        by_title.where((F.col("kind") == "edit") & (last >= closing))
        .select(
            "rev_id",
            F.lit(rules.wiki).alias("wiki"),
            "title",
            F.timestamp_millis("edit_ms").alias("edit_time"),
            F.when(reverted, "reverted")
            .when(deleted, "deleted")
            .when(incomplete, "incomplete")
            .otherwise("not-reverted")
            .alias("label"),
            F.when(reverted, F.timestamp_millis("tag.dt")).alias("reverted_at"),
            F.when(reverted, whole((F.col("tag.dt") - F.col("edit_ms")) / 1000)).alias("revert_delay_seconds"),
            F.lit(rules.window_ms / HOUR_MS).alias("window_hours"),
            F.col("offset").alias("source_offset"),
        )
    )


def late_hits(edits: DataFrame, late: DataFrame, rules: LabelRules = LIVE) -> DataFrame:
    """``rev_id`` of the edits with a late deletion of their page after them that counts: dt <= ends and mark < closing.

    ``edits``: (offset, title, rev_id, closing, ends); ``late``: (offset, title, dt, mark), ``mark`` rising
    with the offset. So an edit's candidates are a run of its page's deletions: from those before it in
    the log to the last with mark < closing. Both ends are running counts. The earliest dt of a run comes from
    minima over runs of 1, 2, 4, ... deletions: each deletion is in one run of each length, and a run
    of any length is made of two of each at most. No edit meets the single deletions of its page.
    """
    none = F.lit(None).cast("bigint")
    one = F.when(F.col("kind") == "late", F.lit(1).cast("bigint"))
    rows = edits.select("offset", "title", F.lit("edit").alias("kind"), F.col("closing").alias("at"), "rev_id", "ends", none.alias("dt")).unionByName(
        late.select("offset", "title", F.lit("late").alias("kind"), F.col("mark").alias("at"), none.alias("rev_id"), none.alias("ends"), "dt")
    )
    first = running(rows, keys=["title"], bucket=offset_bucket(F.col("offset"), rules.rows_per_bucket), order=[F.col("offset")], values={"lo": ("sum", one)})
    # A deletion at the edit's own closing comes too late, so edits go first among equals.
    both = running(first, keys=["title"], bucket=F.floor(F.col("at") / rules.grace_ms).cast("bigint"), order=[F.col("at"), F.col("kind"), F.col("offset")], values={"hi": ("sum", one)})
    zero = F.lit(0).cast("bigint")
    counted = stored(both.withColumns({"lo": F.coalesce("lo", zero), "hi": F.coalesce("hi", zero)}).where("kind = 'late' OR lo < hi"), "late-runs")
    levels = F.lit(0) + F.coalesce(counted.where("kind = 'late'").agg(F.ceil(F.log2(F.max("lo") + 1)).cast("int")).scalar(), F.lit(0))
    level = F.explode(F.sequence(F.lit(0), levels))
    node = F.expr("shiftright(lo, level)")
    minima = counted.where("kind = 'late'").select("title", "lo", "dt", level.alias("level")).groupBy("title", "level", node.alias("node")).agg(F.min("dt").alias("dt"))
    wanted = counted.where("kind = 'edit'").select("title", "rev_id", "ends", "lo", "hi", level.alias("level"))
    wanted = wanted.withColumns({"a": F.expr("shiftright(lo + shiftleft(1L, level) - 1, level)"), "b": F.expr("shiftright(hi, level)")}).where("a < b")
    pieces = F.array_compact(F.array(F.when(F.expr("a % 2 = 1"), F.col("a")), F.when(F.expr("b % 2 = 1"), F.col("b") - 1)))
    wanted = wanted.select("title", "rev_id", "ends", "level", F.explode(pieces).alias("node"))
    return wanted.join(minima, ["title", "level", "node"]).where("dt <= ends").select("rev_id").distinct()


def label_log(parsed: DataFrame, rules: LabelRules = LIVE) -> DataFrame:
    return label(timeline(parsed, rules), rules)


def merged(first: DataFrame, second: DataFrame, slices: int | None = None) -> DataFrame:
    """Two captures as one log in event-time order; the first goes before the second at equal times.

    Both need (dt, value) and a tie-break column ``offset`` of their own.
    """
    both = (
        first.select("dt", "value", F.lit(0).alias("source"), F.col("offset").alias("own_offset"))
        .unionByName(second.select("dt", "value", F.lit(1).alias("source"), F.col("offset").alias("own_offset")))
    )
    return numbered(both, "dt", "source", "own_offset", name="offset", slices=slices)


def next_event(
    events: DataFrame,
    *,
    key: str,
    offset: str,
    time: str,
    starts: Column,
    ends: Column,
    window: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Every start event with the first end event of its key that follows it in the log.

    ``hit_time`` is NULL unless that event lies within ``window`` (an interval such
    as '72 hours') of the start. One row per start; a key may be arbitrarily hot.
    """
    narrow = events.where((starts | ends) & F.col(key).isNotNull()).withColumn("__start", starts)
    found = running(
        narrow,
        keys=[key],
        bucket=offset_bucket(F.col(offset), rows_per_bucket),
        order=[F.col(offset)],
        values={"__hit": ("min", F.when(ends, F.struct(F.col(offset).alias("o"), F.col(time).alias("t"))))},
        after=True,
    )
    inside = F.col("__hit.t") <= F.col(time) + F.expr(f"INTERVAL {window}")
    return (
        found.where("__start")
        .withColumn("hit_time", F.when(inside, F.col("__hit.t")))
        .drop("__hit", "__start")
    )
