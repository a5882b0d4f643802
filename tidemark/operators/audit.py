"""Was every log entry handled exactly once, and do two label sources agree?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import ratio, round_half_up, share, wilson_columns
from tidemark.operators.parse import first_by_key
from tidemark.operators.scan import offset_bucket, running
from tidemark.operators.scoring import decided
from tidemark.session import stored


def exactly_once(handled: DataFrame, start: int | Column, end: int | Column) -> DataFrame:
    """One row: handled, expected, duplicates, missing, first_gap, ok for offsets start..end-1.

    ``first_gap`` is the first offset at which the sorted list of handled offsets
    stops counting up by one: after a repeated offset or at a missing one. No sort
    is needed; offsets are counted once and matched with their successor.
    """
    lo = F.lit(start) if isinstance(start, int) else start
    hi = F.lit(end) if isinstance(end, int) else end
    # Read three times below; whatever produced ``handled`` runs once.
    counts = stored(handled.groupBy("offset").agg(F.count("*").alias("times")), "handled")
    inside = (F.col("offset") >= lo) & (F.col("offset") < hi)
    # A missing run starts right after a handled offset, or at ``start``.
    succeeded = counts.select((F.col("offset") + 1).alias("offset")).where(inside)
    first_hole = succeeded.join(counts, "offset", "left_anti").agg(F.min("offset")).scalar()
    sums = counts.agg(
        F.coalesce(F.sum("times"), F.lit(0)).alias("handled"),
        F.count("*").alias("__distinct"),
        F.count_if(inside).alias("__inside"),
        F.count_if(F.col("offset") == lo).alias("__has_start"),
        F.min(F.when(F.col("times") > 1, F.col("offset") + 1)).alias("__after_repeat"),
    )
    expected = (hi - lo).cast("bigint")
    out = sums.select(
        "handled",
        expected.alias("expected"),
        (F.col("handled") - F.col("__distinct")).alias("duplicates"),
        (expected - F.col("__inside")).alias("missing"),
        F.least("__after_repeat", first_hole, F.when((F.col("__has_start") == 0) & (expected > 0), lo)).cast("bigint").alias("first_gap"),
    )
    clean = (F.col("duplicates") == 0) & F.col("first_gap").isNull() & (F.col("handled") == F.col("expected"))
    return out.withColumn("ok", clean)


def gap_runs(offsets: DataFrame) -> DataFrame:
    """Every run of missing offsets as (gap_from, gap_to), both included.

    A run lies between an offset and the one before it, which is a running maximum. Offsets may
    repeat and need not be stored: whatever produced them runs once, here.
    """
    seen = stored(offsets.select("offset").where(F.col("offset").isNotNull()), "offsets")
    before = running(
        seen,
        bucket=offset_bucket(F.col("offset")),
        order=[F.col("offset")],
        values={"before": ("max", F.col("offset"))},
    )
    gaps = before.where(F.col("offset") - F.col("before") > 1)
    return gaps.select((F.col("before") + 1).alias("gap_from"), (F.col("offset") - 1).alias("gap_to"))


def ingest_counts(raw: DataFrame) -> DataFrame:
    """received / written / duplicates / invalid of one capture; needs ``valid`` and ``meta_id``."""
    return raw.agg(
        F.count("*").alias("received"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.count_distinct(F.when(F.col("valid"), F.col("meta_id"))).alias("written"),
    ).withColumn("duplicates", F.col("received") - F.col("invalid") - F.col("written"))


def observed(df: DataFrame, name: str, **conditions: Column) -> DataFrame:
    """Count rows and conditions while the data flows by, in batch or streaming."""
    return df.observe(name, F.count("*").alias("rows"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


# ---------------------------------------------------------------------------
# Label agreement


def agreement_rows(labels: DataFrame, table: DataFrame, reverts: DataFrame, window_ms: int, covered_until_ms: int | None = None, asked_ms: int | None = None) -> DataFrame:
    """Independent labels beside log labels with the cause of every disagreement.

    ``table``: (rev_id, reverted) coded 1/0/gone. ``reverts``: (rev_id, dt_ms) of all
    revert tags at any delay; they are reduced to one row per revision first.
    """
    api = F.when(F.col("reverted") == "1", "reverted").when(F.col("reverted") == "0", "not-reverted").otherwise("gone")
    first = reverts.groupBy("rev_id").agg(F.min("dt_ms").alias("first_revert_ms"))
    rows = (
        table.select("rev_id", api.alias("api"))
        .join(labels.select("rev_id", F.unix_millis("edit_time").alias("edit_ms"), F.col("label").alias("stream")), "rev_id", "left")
        .join(first, "rev_id", "left")
    )
    ends = F.col("edit_ms") + window_ms
    asked_later = F.lit(False)
    if covered_until_ms is not None and asked_ms is not None:
        asked_later = (F.lit(covered_until_ms) < asked_ms) & (F.lit(covered_until_ms) >= ends)
    never = F.col("first_revert_ms").isNull()
    differs = F.col("stream").isNotNull() & (F.col("api") != "gone") & (F.col("api") != F.col("stream"))
    cause = (
        F.when((F.col("api") == "reverted") & never & asked_later, "asked after the log ended")
        .when((F.col("api") == "reverted") & never, "tag never seen in the log")
        .when((F.col("api") == "reverted") & (F.col("first_revert_ms") > ends), "reverted after the window")
        .when((F.col("api") == "not-reverted") & (F.col("stream") == "reverted"), "tag no longer present")
        .otherwise("other")
    )
    return rows.withColumn("cause", F.when(differs, cause))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("stream").isNotNull()).groupBy("api", "stream").agg(F.count("*").alias("n"))


def causes(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("cause").isNotNull()).groupBy("cause").agg(F.count("*").alias("n"))


def agreement(rows: DataFrame) -> DataFrame:
    """Agreement rate; rows the independent source no longer sees do not count when undecided by it."""
    labelled = F.col("stream").isNotNull()
    excluded = (F.col("api") == "gone") & F.col("stream").isin("reverted", "not-reverted")
    sums = rows.agg(
        F.count("*").alias("table_rows"),
        F.count_if(labelled).alias("labelled"),
        F.count_if(labelled & ~excluded).alias("compared"),
        F.count_if(labelled & (F.col("api") == F.col("stream")) & decided(F.col("api"))).alias("agree"),
    )
    return sums.select("table_rows", "labelled", "compared", "agree", *wilson_columns("agreement", F.col("agree"), F.col("compared"))[:3])


def label_summary(labels: DataFrame) -> DataFrame:
    """Counts by label, revert rate with interval, and the time range."""
    n = lambda v: F.count_if(F.col("label") == v)
    reverted, kept = n("reverted"), n("not-reverted")
    return labels.agg(
        F.count("*").alias("labels"),
        reverted.alias("reverted"),
        kept.alias("not_reverted"),
        n("deleted").alias("deleted"),
        n("incomplete").alias("incomplete"),
        *wilson_columns("revert", reverted, reverted + kept)[:3],
        F.unix_millis(F.min("edit_time")).alias("first_edit_ms"),
        F.unix_millis(F.max("edit_time")).alias("last_edit_ms"),
    )


def decisions_for(labels: DataFrame, scored: DataFrame) -> DataFrame:
    """Decided labels with the first filter decision recorded for their revision.

    A revision that was labelled again counts by its last label.

    The log of decisions is first cut to labelled revisions, then to one row each
    (it is at-least-once), then joined.
    """
    last = labels.groupBy("rev_id").agg(F.max_by(F.struct(*labels.columns), "source_offset").alias("l")).select("l.*")
    wanted = scored.join(last.select("rev_id"), "rev_id", "left_semi")
    first = wanted.groupBy("rev_id").agg(F.min_by("filter", "offset").alias("filter"))
    return last.where(decided(F.col("label"))).join(first, "rev_id")


def live_trade_off(joined: DataFrame) -> DataFrame:
    """Volume removed and reverts lost, from decisions recorded while running."""
    keep, reverted = F.col("filter.keep"), F.col("label") == "reverted"
    sums = joined.agg(
        F.count("*").alias("n"), F.count_if(~keep).alias("dropped"), F.count_if(reverted).alias("reverted"),
        F.count_if(reverted & ~keep).alias("lost"), F.count_if(keep).alias("kept"), F.count_if(reverted & keep).alias("kept_reverted"),
    )
    c = F.col
    return sums.select(
        "n",
        share(c("dropped"), c("n")).alias("volume_removed"),
        *wilson_columns("reverted_lost", c("lost"), c("reverted")),
        share(c("reverted"), c("n")).alias("revert_rate_before"),
        share(c("kept_reverted"), c("kept")).alias("revert_rate_after"),
    )


def seen_before(tags: DataFrame, edits: DataFrame) -> DataFrame:
    """Tag changes of revisions that occurred earlier in the same log as an edit.

    One row per revision is enough on the edit side: its earliest offset.
    """
    first = edits.groupBy("rev_id").agg(F.min("offset").alias("__edit_offset"))
    return tags.join(first, "rev_id").where(F.col("__edit_offset") < F.col("offset")).drop("__edit_offset")


def found_in(sample: DataFrame, *tables: DataFrame) -> DataFrame:
    """Rows of any of the tables whose revision is in the sample, one per revision."""
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table)
    wanted = rows.join(sample.select("rev_id").distinct(), "rev_id", "left_semi")
    return first_by_key(wanted, "rev_id", "offset")


# The label windows the delay probe reports, in seconds.
DELAY_BOUNDS = {"1h": 3_600, "6h": 21_600, "24h": 86_400, "72h": 259_200, "7d": 604_800, "30d": 2_592_000}


def delay_coverage(delays: DataFrame, delay: str = "delay_seconds") -> DataFrame:
    """Share of delays within each bound, one column per bound, in one pass."""
    total = F.count(delay)
    return delays.agg(
        total.alias("n"),
        *[share(F.count_if(F.col(delay) <= s), total).alias(f"within_{name}") for name, s in DELAY_BOUNDS.items()],
    )


# ---------------------------------------------------------------------------
# Human judgement of the label


def judged(sheet: DataFrame, key: DataFrame) -> DataFrame:
    """The sheet beside its key: ``problem`` says why a row cannot be used."""
    rows = sheet.withColumn("vandalism", F.lower("vandalism")).join(key.select("rev_id", "reverted"), "rev_id", "left")
    problem = F.when(F.col("reverted").isNull(), "not in key").when(
        ~F.coalesce(F.col("vandalism").isin("y", "n", "u"), F.lit(False)), "vandalism must be y/n/u"
    )
    return rows.withColumn("problem", problem)


def population(labels: DataFrame) -> DataFrame:
    """One row over all labels of a population: eligible, gone, the revert rate of the decided with its interval, gone_rate."""
    known, reverted = decided(F.col("label")), F.col("label") == "reverted"
    return labels.agg(
        F.count("*").alias("eligible"),
        F.count_if(~known).alias("gone"),
        *wilson_columns("revert", F.count_if(reverted), F.count_if(known)),
        share(F.count_if(~known), F.count("*")).alias("gone_rate"),
    )


def label_noise(rows: DataFrame, population_rate: Column | float) -> DataFrame:
    """Both directions of label noise; agreement reweighted to the population's revert rate."""
    sure = F.col("vandalism") != "u"
    r = F.lit(population_rate) if isinstance(population_rate, float) else population_rate
    sums = rows.agg(
        F.count("*").alias("labelled"),
        F.count_if(~sure).alias("unsure"),
        F.count_if(sure & F.col("reverted")).alias("rev"),
        F.count_if(sure & ~F.col("reverted")).alias("kept"),
        F.count_if(F.col("reverted") & (F.col("vandalism") == "n")).alias("rev_fine"),
        F.count_if(~F.col("reverted") & (F.col("vandalism") == "y")).alias("kept_bad"),
    )
    c = F.col
    agree = r * (1 - ratio(c("rev_fine"), c("rev"))) + (1 - r) * (1 - ratio(c("kept_bad"), c("kept")))
    return sums.select(
        "labelled",
        "unsure",
        *wilson_columns("reverted_not_vandalism", c("rev_fine"), c("rev")),
        *wilson_columns("kept_but_vandalism", c("kept_bad"), c("kept")),
        round_half_up(r).alias("population_rate"),
        round_half_up(agree).alias("population_agreement"),
    )
