"""Precision, recall and run statistics of every configuration on a labelled set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import change
from tidemark.functions.stats import f1, ratio, round_half_up, share, whole, wilson_columns
from tidemark.operators.quantiles import histogram, summarise_histogram

LATENCY_POINTS = {"latency_p50": 50.0, "latency_p95": 95.0}


def decided(label: Column) -> Column:
    return label.isin("reverted", "not-reverted")


def set_totals(edits: DataFrame) -> DataFrame:
    """(set, set_edits, set_reverted, set_decided)."""
    return edits.groupBy("set").agg(
        F.count("*").alias("set_edits"),
        F.count_if(F.col("label") == "reverted").alias("set_reverted"),
        F.count_if(decided(F.col("label"))).alias("set_decided"),
    )


def base_rate(edits: DataFrame) -> DataFrame:
    totals = set_totals(edits)
    return totals.select("set", "set_edits", *wilson_columns("base", F.col("set_reverted"), F.col("set_decided")))


def grid(edits: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per (set, config). An edit without an answer counts as not flagged.

    ``edits`` is unique per (set, rev_id). Runs are narrowed to one row per answered
    edit first; the last answer decides.
    """
    has_tokens = F.col("tokens_in").isNotNull() & F.col("tokens_out").isNotNull()
    answers = runs.groupBy("set", "config", "rev_id").agg(
        F.max_by("revert", "at").alias("revert"),
        F.count("*").alias("rows"),
        F.count_if("revert").alias("flagged"),
        F.count_if(F.col("revert").isNull()).alias("invalid"),
        F.sum(F.when(has_tokens, F.col("tokens_in"))).alias("tokens_in"),
        F.sum(F.when(has_tokens, F.col("tokens_out"))).alias("tokens_out"),
        F.count_if(has_tokens).alias("with_tokens"),
    )
    judged = answers.join(edits.select("set", "rev_id", "label"), ["set", "rev_id"], "left")
    hit = F.coalesce(F.col("revert"), F.lit(False))
    sums = judged.groupBy("set", "config").agg(
        F.sum("rows").alias("edits"),
        F.count("label").alias("__matched"),
        F.count_if(hit & (F.col("label") == "reverted")).alias("tp"),
        F.count_if(hit & (F.col("label") == "not-reverted")).alias("fp"),
        F.sum("flagged").alias("__flagged"),
        F.sum("invalid").alias("__invalid"),
        F.sum("tokens_in").alias("__in"),
        F.sum("tokens_out").alias("__out"),
        F.sum("with_tokens").alias("__with"),
    )
    versions = runs.groupBy("set", "config").agg(F.array_sort(F.collect_set("model_version")).alias("model_versions"))
    counted = (
        sums.join(versions, ["set", "config"])
        .join(set_totals(edits), "set")
        .withColumn("fn", F.col("set_reverted") - F.col("tp"))
    )
    latency = summarise_histogram(
        histogram(runs, ["set", "config"], "latency_ms"), ["set", "config"], "value", LATENCY_POINTS
    ).select("set", "config", *LATENCY_POINTS, F.col("max").alias("__slowest"))
    timed = counted.join(latency, ["set", "config"], "left")
    return timed.select(
        "set",
        "config",
        "model_versions",
        "edits",
        (F.col("__matched") == F.col("set_edits")).alias("complete"),
        share(F.col("__flagged"), F.col("edits")).alias("flagged"),
        share(F.col("__invalid"), F.col("edits")).alias("invalid"),
        "tp",
        "fp",
        "fn",
        *wilson_columns("precision", F.col("tp"), F.col("tp") + F.col("fp")),
        *wilson_columns("recall", F.col("tp"), F.col("tp") + F.col("fn")),
        round_half_up(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("f1"),
        *[F.when(F.col("__slowest") > 0, F.col(p)).alias(p) for p in LATENCY_POINTS],
        whole(ratio(F.col("__in"), F.col("__with"))).alias("tokens_in"),
        whole(ratio(F.col("__out"), F.col("__with"))).alias("tokens_out"),
    )


def in_report_order(scores: DataFrame) -> DataFrame:
    """Baselines first, then by name."""
    return scores.orderBy("set", ~F.col("config").startswith("baseline:"), "config")


def best_per_model(scores: DataFrame) -> DataFrame:
    """The configuration with the highest F1 of each model; ties go to fewer tokens, then by name."""
    tokens = F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))
    order = W.partitionBy("set", "model").orderBy(F.desc("f1"), tokens, "config")
    ranked = scores.withColumn("model", change.model_of(F.col("config"))).withColumn("__n", F.row_number().over(order))
    return ranked.where("__n = 1").drop("__n")


def filter_only(edits: DataFrame) -> DataFrame:
    """Rule baseline: everything that passed the filter is flagged."""
    return _instant(edits, F.lit(True), "baseline:filter-only", "filter:extendedconfirmed")


def filter_temporary(edits: DataFrame) -> DataFrame:
    """Rule baseline: only temporary accounts are flagged."""
    return _instant(
        edits, F.col("user_class") == "temporary", "baseline:filter+temporary", "filter:extendedconfirmed+temporary"
    )


def _instant(edits: DataFrame, revert: Column, config: str, version: str) -> DataFrame:
    return edits.select(
        "set",
        "rev_id",
        F.lit(config).alias("config"),
        revert.alias("revert"),
        revert.cast("double").alias("p_revert"),
        F.lit(None).cast("string").alias("invalid"),
        F.lit(0.0).alias("latency_ms"),
        F.lit(None).cast("bigint").alias("tokens_in"),
        F.lit(None).cast("bigint").alias("tokens_out"),
        F.lit(version).alias("model_version"),
    )


def by_threshold(p: Column, status: Column, body: Column, threshold: float = 0.5) -> list[Column]:
    """revert / p_revert / invalid of a scorer that only gives a probability."""
    return [
        (p >= threshold).alias("revert"),
        p.alias("p_revert"),
        F.when(p.isNull(), F.concat(status, F.lit(": "), body)).alias("invalid"),
    ]


def unanswered(edits: DataFrame, runs: DataFrame) -> DataFrame:
    """What a resumed run still has to do."""
    return edits.join(runs.select("set", "rev_id"), ["set", "rev_id"], "left_anti")


def route(scored: DataFrame, config: str) -> DataFrame:
    """Rows the filter dropped are answered on the spot; the others go to the model tier."""
    keep = F.col("filter.keep")
    return scored.select(
        "*",
        F.when(keep, "model").otherwise("filter").alias("tier"),
        F.when(keep, F.lit(config)).otherwise(F.concat(F.lit("filter:"), "filter.policy")).alias("config"),
        F.when(~keep, False).alias("revert"),
        F.when(~keep, 0.0).alias("p_revert"),
        F.when(~keep, F.col("filter.rule")).alias("model_version"),
    )


def trade_off(per_policy: DataFrame, keys: list[str]) -> DataFrame:
    """What each policy removes and what it loses, in one aggregate.

    Needs ``rule``, ``user_class`` and ``reverted`` (NULL = label undecidable) next
    to ``keys`` and ``policy``.
    """
    dropped = F.col("rule") != "kept"
    reverted = F.coalesce(F.col("reverted"), F.lit(False))
    known = F.col("reverted").isNotNull()
    human = F.col("user_class") != "bot"
    sums = per_policy.groupBy(*keys, "policy").agg(
        F.count("*").alias("edits"),
        F.count_if(dropped).alias("dropped"),
        F.count_if(F.col("rule") == "bot").alias("dropped_bot"),
        F.count_if(F.col("rule") == "trusted-account").alias("dropped_trusted"),
        F.count_if(human).alias("__human"),
        F.count_if(human & dropped).alias("__human_dropped"),
        F.count_if(known).alias("__known"),
        F.count_if(known & ~dropped).alias("__known_kept"),
        F.count_if(reverted).alias("__reverted"),
        F.count_if(reverted & dropped).alias("__lost"),
        F.count_if(reverted & (F.col("rule") == "bot")).alias("lost_bot"),
        F.count_if(reverted & (F.col("rule") == "trusted-account")).alias("lost_trusted"),
    )
    c = F.col
    return sums.select(
        *keys,
        "policy",
        "edits",
        "dropped",
        "dropped_bot",
        "dropped_trusted",
        share(c("dropped"), c("edits")).alias("volume_removed"),
        share(c("__human_dropped"), c("__human")).alias("volume_removed_non_bot"),
        *wilson_columns("reverted_lost", c("__lost"), c("__reverted")),
        share(c("__reverted"), c("__known")).alias("revert_rate_before"),
        share(c("__reverted") - c("__lost"), c("__known_kept")).alias("revert_rate_after"),
        "lost_bot",
        "lost_trusted",
    )


def ranges(table: DataFrame, group: Column, values: list[str]) -> DataFrame:
    """Lowest and highest of each value per group, for a headline such as '67-87%'."""
    return table.groupBy(group.alias("family")).agg(
        *[f(v).alias(f"{v}_{name}") for v in values for name, f in (("low", F.min), ("high", F.max))]
    )
