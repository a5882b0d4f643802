"""Does a stated probability mean what it says? All figures come from a histogram over distinct p."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import as_exact, ratio, round_half_up, wilson_columns
from tidemark.operators.quantiles import cumulated
from tidemark.operators.scoring import decided, set_totals

BUCKETS = 10
SEGMENTS = ("temporary", "registered")


def bucket_of(p: Column) -> Column:
    """0..9; each edge is compared as a double, since p * 10 lands above some edges."""
    below = [F.when(p >= b / BUCKETS, 1).otherwise(0) for b in range(1, BUCKETS)]
    total = F.lit(0)
    for step in below:
        total = total + step
    return total


def probabilities(edits: DataFrame, runs: DataFrame) -> DataFrame:
    """(set, config, user_class, p, n, pos) of answers with a probability on decided edits."""
    labels = edits.where(decided(F.col("label"))).select("set", "rev_id", "user_class", "label")
    rows = runs.where(F.col("p_revert").isNotNull()).join(labels, ["set", "rev_id"])
    return rows.groupBy("set", "config", "user_class", F.col("p_revert").alias("p")).agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == "reverted").alias("pos")
    )


def calibratable(edits: DataFrame, runs: DataFrame, hist: DataFrame) -> DataFrame:
    """(set, config, invalid_excluded): complete runs with more than two distinct probabilities."""
    answered = (
        runs.groupBy("set", "config", "rev_id")
        .agg(F.count_if(F.col("p_revert").isNull()).alias("bad"))
        .join(edits.select("set", "rev_id"), ["set", "rev_id"], "left_semi")
        .groupBy("set", "config")
        .agg(F.count("*").alias("answered"), F.sum("bad").alias("invalid_excluded"))
        .join(set_totals(edits), "set")
        .where("answered >= set_edits")
        .select("set", "config", "invalid_excluded")
    )
    varied = hist.groupBy("set", "config").agg(F.count_distinct("p").alias("distinct_p")).where("distinct_p > 2")
    return answered.join(varied.select("set", "config"), ["set", "config"], "left_semi")


def by_segment(hist: DataFrame) -> DataFrame:
    """The histogram once per segment: overall, temporary and registered editors."""
    segments = F.array_compact(F.array(F.lit("overall"), F.when(F.col("user_class").isin(*SEGMENTS), F.col("user_class"))))
    return (
        hist.withColumn("segment", F.explode(segments))
        .groupBy("set", "config", "segment", "p")
        .agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    )


def reliability(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ten buckets of stated p against the observed rate; empty buckets have no row."""
    sums = hist.groupBy(*keys, bucket_of(F.col("p")).alias("bucket")).agg(
        F.sum("n").alias("n"), F.sum(as_exact(F.col("p")) * F.col("n")).cast("double").alias("__p"), F.sum("pos").alias("__pos")
    )
    return sums.select(
        *keys,
        "bucket",
        (F.col("bucket") / F.lit(BUCKETS)).alias("p_from"),
        ((F.col("bucket") + 1) / F.lit(BUCKETS)).alias("p_to"),
        "n",
        round_half_up(F.col("__p") / F.col("n")).alias("mean_p"),
        *[c for c in wilson_columns("observed", F.col("__pos"), F.col("n"))[:3]],
    )


def ece(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected calibration error from the published (rounded) bucket values."""
    gap = as_exact(F.abs(F.col("observed_rate") - F.col("mean_p"))) * F.col("n")
    return buckets.groupBy(*keys).agg(round_half_up(F.sum(gap).cast("double") / F.sum("n")).alias("ece"))


def brier_and_auroc(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, distinct_p, brier, auroc).

    AUROC by rank sum, tied probabilities sharing their mean rank; NULL when one
    class is empty.
    """
    ranked = cumulated(hist, keys, "p", {"__below": "n"})
    p, n, pos = F.col("p"), F.col("n"), F.col("pos")
    mean_rank = F.col("__below") + (n + 1) / 2
    miss = as_exact(F.pow(1 - p, F.lit(2))) * pos + as_exact(F.pow(p, F.lit(2))) * (n - pos)
    sums = ranked.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.count("*").alias("distinct_p"),
        round_half_up(F.sum(miss).cast("double") / F.sum(n)).alias("brier"),
        F.sum(pos * mean_rank).alias("__ranks"),
        F.sum(pos).cast("double").alias("__pos"),
    )
    pos, neg = F.col("__pos"), F.col("n") - F.col("__pos")
    area = ratio(F.col("__ranks") - pos * (pos + 1) / 2, pos * neg)
    return sums.select(*keys, "n", "distinct_p", "brier", round_half_up(area).alias("auroc"))


def calibration(edits: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per (set, config, segment) of all runs that state real probabilities."""
    hist = probabilities(edits, runs)
    usable = calibratable(edits, runs, hist)
    keys = ["set", "config", "segment"]
    # Joined after the figures: the list of configurations is short, the histogram need not be.
    segments = by_segment(hist)
    errors = ece(reliability(segments, keys), keys)
    return (
        brier_and_auroc(segments, keys).join(errors, keys).join(usable, ["set", "config"])
    )
