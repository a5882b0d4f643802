"""Reproducible samples: the order is a hash of seed and key, so input order and partitions do not matter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def draw(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows; each task keeps its own best ``n``, nothing is fully sorted."""
    return df.orderBy(draw(F.col(key), seed), key).limit(n)


def stratified(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: int) -> DataFrame:
    """Up to ``n`` rows per stratum and ``position`` in one shuffled order.

    A stratum may hold most rows: it is first thinned to ``n`` per 1/256 of the
    hash space, which cannot lose a row of the final ``n``.
    """
    drawn = df.withColumn("__draw", draw(F.col(key), seed)).withColumn("__part", F.substring("__draw", 1, 2))
    thin = W.partitionBy(*strata, "__part").orderBy("__draw", key)
    few = drawn.withColumn("__n", F.row_number().over(thin)).where(F.col("__n") <= n)
    final = W.partitionBy(*strata).orderBy("__draw", key)
    chosen = few.withColumn("__n", F.row_number().over(final)).where(F.col("__n") <= n)
    # At most n rows per stratum are left to number.
    shuffled = W.orderBy(draw(F.col(key), seed + 1), key)
    return chosen.withColumn("position", F.row_number().over(shuffled)).drop("__draw", "__part", "__n")


def subset(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The fixed subset a drift check reruns: keys only."""
    return sample(df.select(key).distinct(), key, n, seed)
