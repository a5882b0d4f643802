"""Account facts beside edits, and the trust filter on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text, trust
from tidemark.functions.stats import round_half_up
from tidemark.operators.scan import running, sliced


def attach_accounts(edits: DataFrame, accounts: DataFrame) -> DataFrame:
    """Left join one snapshot per account: ``account`` (NULL = none found) and ``account_as_of``.

    Only registered users are looked up. The others get keys of their own that no account
    has, so one join reads the edits once and nobody piles up on one reducer. AQE splits
    a user that owns many edits.
    """
    facts = accounts.select(
        F.col("user").alias("__user"),
        F.struct("registration", F.col("editcount").cast("bigint").alias("editcount")).alias("account"),
        F.col("as_of").alias("account_as_of"),
    )
    nobody = F.concat(F.lit("\u0000"), F.xxhash64("rev_id").cast("string"))
    key = F.when(F.col("user_class") == "registered", F.col("user")).otherwise(nobody)
    return edits.join(facts, key == F.col("__user"), "left").drop("__user")


def attach_accounts_as_of(
    edits: DataFrame, snapshots: DataFrame, *, ttl: str | None = "60 minutes", slices: int | None = None
) -> DataFrame:
    """As-of form: the latest snapshot at or before the edit and not older than ``ttl``.

    Edits and snapshots are read as one series ordered by user and time and cut into
    runs of bounded length, so a busy user spreads over tasks and no edit meets every snapshot.
    ``offset`` names an edit.
    """
    # Only keys, times and offsets go through the order; edits meet their answer by offset.
    asked = edits.where(F.col("user_class") == "registered").select(F.col("user").alias("__user"), F.col("dt").alias("__t"), F.col("offset").alias("__tie"))
    facts = snapshots.select(F.col("user").alias("__user"), F.col("as_of").alias("__t"), F.struct("as_of", "registration", F.col("editcount").cast("bigint").alias("editcount")).alias("__snap"))
    # A snapshot at the edit's own time counts, so it goes first.
    series = asked.withColumn("__side", F.lit(1)).unionByName(facts.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    cut = sliced(series, "__user", "__t", "__side", "__tie", slices=slices, name="__slice")
    seen = running(
        cut,
        keys=["__user"],
        bucket=F.col("__slice"),
        order=[F.col("__t"), F.col("__side"), F.col("__tie")],
        values={"__last": ("max", F.col("__snap"))},
    ).where("__side = 1 AND __last IS NOT NULL")
    if ttl is not None:
        seen = seen.where(F.col("__last.as_of") >= F.col("__t") - F.expr(f"INTERVAL {ttl}"))
    answers = seen.select(
        F.col("__tie").alias("offset"),
        F.struct(F.col("__last.registration").alias("registration"), F.col("__last.editcount").alias("editcount")).alias("account"),
        F.col("__last.as_of").alias("account_as_of"),
    )
    return edits.join(answers, "offset", "left").select(*edits.columns, "account", "account_as_of")


def with_filter(enriched: DataFrame, policy: str = trust.DEFAULT_POLICY) -> DataFrame:
    """Annotate with STRUCT<policy, keep, rule>; nothing is removed."""
    return enriched.withColumn(
        "filter", trust.decide(F.col("user_class"), F.col("account"), F.col("timestamp"), policy)
    )


def per_policy(enriched: DataFrame) -> DataFrame:
    """One row per (edit, policy) with ``policy``, ``rule``, ``keep``, in one scan."""
    exploded = enriched.withColumn("__level", F.explode(trust.policy_levels()))
    outcome = trust.rule(
        F.col("user_class"), F.col("account"), F.col("timestamp"), F.col("__level.days"), F.col("__level.edits")
    )
    return (
        exploded.withColumn("policy", F.col("__level.policy"))
        .withColumn("rule", outcome)
        .withColumn("keep", F.col("rule") == "kept")
        .drop("__level")
    )


def features(scored: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """What a scorer may see of an edit.

    An account without a registration date is older than the field: its age is NULL and
    ``age_unrecorded`` true. Without an account both are NULL.
    """
    registration = F.col("account.registration")
    age = round_half_up(trust.account_age_days(registration, F.col("timestamp")))
    has_account = F.col("account").isNotNull()
    return scored.select(
        "rev_id",
        "title",
        F.timestamp_seconds("timestamp").alias("edit_time"),
        "is_new",
        "minor",
        "user_class",
        F.when(has_account & registration.isNotNull(), age).alias("account_age_days"),
        F.when(has_account, registration.isNull()).alias("age_unrecorded"),
        F.when(has_account, F.col("account.editcount")).alias("editcount"),
        (F.coalesce("length_new", F.lit(0)) - F.coalesce("length_old", F.lit(0))).alias("size_delta"),
        "comment",
        *extra,
    )


def with_diffs(edits: DataFrame, diffs: DataFrame) -> DataFrame:
    """Features with ``diff`` and ``diff_unavailable``, the last two that a request needs.

    ``diffs`` has one row (rev_id, html, reason) for each edit whose table diff was fetched: ``reason`` says why
    one is hidden, and is NULL for one that is there. An edit without a row says that nothing was fetched.

    ``edits`` is read twice, so store it. Diffs of other edits go before the join, and only those of the
    edits are turned into text: few edits beside many diffs cost one scan of the diffs.
    """
    asked = diffs.join(edits.select("rev_id"), "rev_id", "left_semi")
    fetched = asked.select("rev_id", F.col("html").alias("__html"), F.col("reason").alias("__reason"), F.lit(True).alias("__fetched"))
    joined = edits.join(fetched, "rev_id", "left")
    reason = F.when(F.col("__fetched").isNull(), "not fetched").otherwise(F.col("__reason"))
    diff = F.coalesce(text.diff_text(F.col("__html")), F.lit(""))
    return joined.select(*[joined[c] for c in edits.columns], diff.alias("diff"), reason.alias("diff_unavailable"))


def by_age(edits: DataFrame, as_of: Column, min_hours: float = 72, max_hours: float = 96) -> DataFrame:
    """Add ``age_group``: young / eligible / old, by hours between the event and ``as_of``."""
    hours = (F.unix_micros(as_of) - F.unix_micros("dt")) / 3.6e9
    return edits.withColumn(
        "age_group", F.when(hours < min_hours, "young").when(hours > max_hours, "old").otherwise("eligible")
    )


def require_closed(edits: DataFrame, as_of: Column, hours: float = 72) -> DataFrame:
    """The edits unchanged, but any row younger than the label window fails the job.

    The check is a filter, so no reader of the result can have it pruned away.
    """
    age = (F.unix_micros(as_of) - F.unix_micros(F.timestamp_seconds("timestamp"))) / 3.6e9
    message = F.concat(F.lit("the label window of revision "), F.col("rev_id"), F.lit(" has not closed"))
    return edits.where(F.when(age >= hours, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
