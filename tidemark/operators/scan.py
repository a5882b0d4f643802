"""Ordered running values without putting a whole order, or a whole hot key, in one task.

A plain ``Window.orderBy`` runs in one task, and ``partitionBy(key)`` gives a key
that owns a third of the rows to one task. Both are cut here into buckets:

1. a window inside each (keys, bucket);
2. one total per (keys, bucket), and a small window over those totals only;
3. the total of the other buckets is joined back and combined.

The bucket must rise with the order. ``offset_bucket`` cuts a dense log offset
into equal runs of rows, so no bucket can be hot. ``sliced`` cuts any other order
into runs of a bounded number of rows and stores the cut, so that both passes see the same one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.session import stored

ROWS_PER_BUCKET = 1_000_000
#: A range partition of a small table holds about this many rows at least.
FEW_ROWS = 5_000
#: ``monotonically_increasing_id`` counts rows below this bit and partitions above it.
_POSITION_BITS = 33
_BUCKET = "__bucket"

_FOLD = {"max": F.max, "min": F.min, "sum": F.sum}


def offset_bucket(offset: Column, rows: int = ROWS_PER_BUCKET) -> Column:
    return F.floor(offset / F.lit(rows)).cast("bigint")


def ranges_for(spark: SparkSession, rows: int, per_range: int = ROWS_PER_BUCKET) -> int:
    """How many range partitions ``rows`` rows need: by their number, and a few more of a small table for its tasks."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // per_range), min(width, rows // FEW_ROWS))


def sliced(
    df: DataFrame, *order: Column | str, slices: int | None = None, rows_per_slice: int = ROWS_PER_BUCKET, name: str = "slice"
) -> DataFrame:
    """Cut ``df`` into contiguous runs of ``order`` of at most ``rows_per_slice`` rows, numbered in that order.

    Two levels: range partitions, as many as the counted rows need, whose bounds Spark samples; and
    inside each, runs of exactly so many rows by position. However far a sample is off, or however
    often a value stands, no slice is larger. Equal values may lie in neighbouring slices. The number is
    only stable once stored (a re-run may sample other bounds).
    """
    rows = stored(df, "unsliced")
    count = rows.count()
    if slices is None and count <= min(FEW_ROWS, rows_per_slice):
        return rows.withColumn(name, F.lit(0).cast("bigint"))
    n = slices or ranges_for(df.sparkSession, count, rows_per_slice)
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Range partition above, position in it below.
    place = F.monotonically_increasing_id()
    part, position = F.shiftright(place, _POSITION_BITS), place.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    number = F.shiftleft(part, _POSITION_BITS) + F.floor(position / F.lit(rows_per_slice))
    return stored(ranged.withColumn(name, number.cast("bigint")), "slices")


def running(
    df: DataFrame,
    *,
    bucket: Column,
    order: Sequence[Column],
    values: dict[str, tuple[str, Column]],
    keys: Sequence[str] = (),
    after: bool = False,
    inclusive: bool = False,
) -> DataFrame:
    """Add ``name -> fold(value)`` over all rows before (or after) each row.

    ``values`` maps a new column to ("max" | "min" | "sum", expression); NULLs are
    skipped. ``keys`` must not be NULL. ``order`` must be a total order inside a bucket.
    """
    keys = list(keys)
    cut = df.withColumn(_BUCKET, bucket)
    # A frame that ends at the last row is re-read for every row, so "after" is
    # read backwards as a growing frame.
    ordering = [c.desc() for c in order] if after else list(order)
    edge = W.currentRow if inclusive else -1
    local = W.partitionBy(*keys, _BUCKET).orderBy(*ordering).rowsBetween(W.unboundedPreceding, edge)
    within = cut
    for name, (fold, value) in values.items():
        within = within.withColumn(name, _FOLD[fold](value).over(local))

    totals = cut.groupBy(*keys, _BUCKET).agg(*[_FOLD[fold](value).alias(f"__t_{n}") for n, (fold, value) in values.items()])
    by_bucket = F.col(_BUCKET).desc() if after else F.col(_BUCKET)
    across = W.partitionBy(*keys).orderBy(by_bucket).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *keys, _BUCKET, *[_FOLD[fold](f"__t_{n}").over(across).alias(f"__c_{n}") for n, (fold, _) in values.items()]
    )
    # Buckets with nothing carried in need no row on this side.
    carried = carried.where(reduce(or_, [F.col(f"__c_{n}").isNotNull() for n in values]))
    joined = within.join(carried, [*keys, _BUCKET], "left")
    for name, (fold, _) in values.items():
        here, other = F.col(name), F.col(f"__c_{name}")
        if fold == "max":
            both = F.greatest(here, other)
        elif fold == "min":
            both = F.least(here, other)
        else:
            both = F.coalesce(here + other, here, other)
        joined = joined.withColumn(name, both)
    return joined.drop(_BUCKET, *[f"__c_{n}" for n in values])


def numbered(
    df: DataFrame, *order: Column | str, name: str = "offset", slices: int | None = None, rows_per_slice: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Dense 0-based position in a global order, computed slice by slice."""
    cut = sliced(df, *order, slices=slices, rows_per_slice=rows_per_slice, name="__slice")
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    out = running(
        cut, bucket=F.col("__slice"), order=columns, values={name: ("sum", F.lit(1).cast("bigint"))}
    )
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("bigint"))).drop("__slice")
