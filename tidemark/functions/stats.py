"""Column formulas for rates, intervals and ratios. A rate over nothing is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def round_half_up(x: Column, digits: int = 4) -> Column:
    """Ties go towards +infinity, unlike ``F.round`` (which goes away from zero)."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / F.lit(scale)


def whole(x: Column) -> Column:
    """Nearest whole number as BIGINT, ties towards +infinity."""
    return F.floor(x + 0.5).cast("bigint")


def ratio(part: Column, total: Column) -> Column:
    """part/total, NULL when there is nothing to divide by."""
    return F.try_divide(part.cast("double"), total.cast("double"))


def share(part: Column, total: Column) -> Column:
    return round_half_up(ratio(part, total))


def as_exact(p: Column) -> Column:
    """A probability-sized value as a decimal, so that sums do not depend on task order.

    Means of two-digit probabilities often end in exactly 5 at the fifth digit;
    with doubles the rounded figure could differ from run to run.
    """
    return p.cast("decimal(16,12)")


def wilson(successes: Column, n: Column, z: float = Z95) -> Column:
    """Wilson score interval as STRUCT<rate, low, high, n>; rate, low, high NULL at n = 0."""
    size = n.cast("double")
    p = ratio(successes, n)
    denom = 1.0 + F.try_divide(F.lit(z * z), size)
    centre = (p + F.try_divide(F.lit(z * z), 2.0 * size)) / denom
    spread = F.try_divide(p * (1.0 - p), size) + F.try_divide(F.lit(z * z), 4.0 * size * size)
    half = z * F.sqrt(spread) / denom
    return F.struct(
        round_half_up(p).alias("rate"),
        round_half_up(centre - half).alias("low"),
        round_half_up(centre + half).alias("high"),
        n.cast("bigint").alias("n"),
    )


def wilson_columns(prefix: str, successes: Column, n: Column) -> list[Column]:
    """The same interval as flat columns, for tables meant to be read in rows."""
    interval = wilson(successes, n)
    return [interval[part].alias(f"{prefix}_{part}") for part in ("rate", "low", "high", "n")]


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 without a true positive."""
    hits = 2.0 * tp.cast("double")
    return F.when(tp == 0, F.lit(0.0)).otherwise(F.try_divide(hits, hits + fp + fn))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson r to four digits; NULL below three points or without variance.

    ``F.corr`` raises on zero variance in ANSI mode, so the quotient is built here.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    r = F.try_divide(F.covar_pop(a, b), spread)
    return F.when(F.count_if(both) >= 3, round_half_up(r))
