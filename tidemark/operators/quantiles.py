"""Exact nearest-rank percentiles from a histogram of distinct values.

``percentile_disc`` keeps one group's values in one task. Counting per distinct
value first combines before the shuffle; ranks are then read off the counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import round_half_up
from tidemark.operators.scan import running, sliced

STANDARD = {"p50": 50.0, "p95": 95.0, "p99": 99.0}


def histogram(df: DataFrame, keys: Sequence[str], value: str | Column, name: str = "value") -> DataFrame:
    """(keys, value, n) over non-NULL values."""
    col = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, col.alias(name)).where(F.col(name).isNotNull())
    return rows.groupBy(*keys, name).agg(F.count("*").alias("n"))


def cumulated(hist: DataFrame, keys: Sequence[str], value: str, counts: dict[str, str]) -> DataFrame:
    """Add ``new`` = sum of ``count`` over smaller values of the same keys, per (new, count).

    Distinct values may themselves be too many for one task, so their order is cut into
    stored slices.
    """
    sums = {new: ("sum", F.col(count)) for new, count in counts.items()}
    cut = sliced(hist, *keys, value, name="__slice")
    out = running(cut, keys=keys, bucket=F.col("__slice"), order=[F.col(value)], values=sums).drop("__slice")
    for new in counts:
        out = out.withColumn(new, F.coalesce(F.col(new), F.lit(0)))
    return out


def summarise_histogram(
    hist: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    points: dict[str, float] | None = None,
) -> DataFrame:
    """(keys, n, mean, percentiles, max) of a (keys, value, n) histogram."""
    points = points or STANDARD
    totals = hist.groupBy(*keys).agg(
        F.sum("n").alias("__total"),
        round_half_up(F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("__mean"),
        F.max(value).alias("__max"),
    )
    ranked = cumulated(hist, keys, value, {"__below": "n"})
    if keys:
        both = ranked.join(totals, list(keys))
    else:
        both = ranked.select("*", totals.select(F.struct("*")).scalar().alias("__s")).select(*ranked.columns, "__s.*")
    hit = lambda p: F.col("__below") + F.col("n") >= F.greatest(F.ceil(F.lit(p / 100) * F.col("__total")), F.lit(1))
    out = both.groupBy(*keys).agg(
        F.first("__total").alias("n"),
        F.first("__mean").alias("mean"),
        *[F.min(F.when(hit(p), F.col(value))).alias(name) for name, p in points.items()],
        F.first("__max").alias("max"),
    )
    return out.where("n > 0") if keys else out


def summarise(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    points: dict[str, float] | None = None,
) -> DataFrame:
    return summarise_histogram(histogram(df, keys, value), keys, "value", points)
