"""Edits ordered along a Hilbert curve over several metadata columns and cut into shards.

Each dimension is quantised by its own quantiles, so every cell of the grid holds a
similar share whatever the distribution. Rows are sorted by their index on the curve through the
grid, then by id, and the order is cut into runs of equal row counts. Neighbours on the
curve are neighbours in every dimension, so a run spans a narrow range of each, and a reader that
filters on any of them skips most runs by their minima and maxima.

A cell that holds a third of all rows is split by id: the sort ranges over the index and
the id together. Only quantile cuts, run lengths and run bounds reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import shuffle_width
from tidemark.operators.scan import running, sliced
from tidemark.session import stored

BITS = 6
LAW = "rows"
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "decimal")
_ORDER = ("curve", "rev_id", "crc", "size")


def axis(column: Column, kind: str) -> Column:
    """A number, date or time as a double that keeps its order."""
    if kind.startswith(("timestamp", "date")):
        column = F.unix_micros(column.cast("timestamp"))
    return column.cast("double")


def string_cuts(edits: DataFrame, dim: str, cells: int) -> list[tuple[str, int]]:
    """The strings at the quantiles of a column, each with the number of quantiles that fall on it.

    Strings count by their whole value. Distinct ones are weighed, ordered by range and summed up
    run by run; at most ``cells - 1`` of them reach the driver.
    """
    weights = edits.select(F.col(f"`{dim}`").cast("string").alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    ordered = running(sliced(weights, "value"), bucket=F.col("slice"), order=[F.col("value")], values={"upto": ("sum", F.col("n"))}, inclusive=True)
    ordered = stored(ordered.select("value", "n", "upto"), "string-ranks")
    total = ordered.agg(F.max("upto")).first()[0]
    if not total:
        return []
    # Quantile i of cells lies on the first string whose running weight reaches i * total / cells.
    upto = F.least(F.expr(f"upto * {cells} div {total}"), F.lit(cells - 1))
    before = F.expr(f"(upto - n) * {cells} div {total}")
    found = ordered.select("value", (upto - before).alias("k")).where("k > 0").orderBy("value").collect()
    return [(r.value, r.k) for r in found]


def string_cell(column: Column, cuts: list[tuple[str, int]]) -> Column:
    """The number of quantiles at or below a string, -1 for NULL."""
    if not cuts:
        return F.lit(-1.0)
    at = F.aggregate(
        F.array(*[F.struct(F.lit(v).alias("v"), F.lit(k).alias("k")) for v, k in cuts]),
        F.lit(0),
        lambda n, cut: n + F.when(cut["v"] <= column, cut["k"]).otherwise(0),
    )
    return F.when(column.isNull(), F.lit(-1)).otherwise(at).cast("double")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of a (rows, dimensions) grid of ``bits``-bit cells.

    Per bit level from the top, lower bits of an axis are reflected or exchanged with the first
    axis so that the sub-cubes join end to end; a Gray decode and bit interleaving follow.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for i in range(d):
            flip = (x[i] & top) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        gray = np.where((x[d - 1] & (1 << level)) != 0, gray ^ ((1 << level) - 1), gray)
    x ^= gray
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << 1) | ((x[i] >> level) & 1)
    return index


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = 0
    for batch in batches:
        place = pa.array(np.arange(at, at + batch.num_rows, dtype=np.int64))
        at += batch.num_rows
        yield batch.append_column("local", place)


def _with_curve(edits: DataFrame, dims: Sequence[str], bits: int, cuts: list[list[float]] | None = None) -> tuple[DataFrame, list]:
    """``edits`` with curve, size and crc columns, and the cuts used."""
    if not 2 <= len(dims) <= 62 // bits:
        raise ValueError(f"two to {62 // bits} dimensions, not {len(dims)}")
    kinds = dict(edits.dtypes)
    cells = 1 << bits
    numeric = {d: axis(F.col(f"`{d}`"), kinds[d]) for d in dims if kinds[d].startswith(_NUMERIC)}
    if cuts is None:
        shares = [i / cells for i in range(1, cells)]
        row = edits.agg(F.lit(0), *[F.percentile_approx(a, shares, 10_000).alias(f"c{i}") for i, a in enumerate(numeric.values())]).first()[1:]
        by_dim = {d: sorted(c or []) for d, c in zip(numeric, row, strict=True)}
        cuts = [by_dim[d] if d in numeric else string_cuts(edits, d, cells) for d in dims]
    # A string's cell is counted by Spark; its number is cut at 1, 2, ... like any other.
    axes = [numeric[d] if d in numeric else string_cell(F.col(f"`{d}`").cast("string"), c) for d, c in zip(dims, cuts, strict=True)]
    edges = [c if d in numeric else list(range(1, cells)) for d, c in zip(dims, cuts, strict=True)]

    @F.pandas_udf("bigint")
    def curve(*values: pd.Series) -> pd.Series:
        # A NULL is the lowest cell.
        cells = [np.searchsorted(np.array(c), v.fillna(-np.inf).to_numpy(float), side="right") for c, v in zip(edges, values, strict=True)]
        return pd.Series(hilbert_index(np.stack(cells, 1), bits))

    body = F.coalesce(F.col("diff").cast("string"), F.lit(""))
    extra = {"__curve": curve(*axes), "__size": (F.octet_length(body) + 1).cast("bigint"), "__crc": F.crc32(body.cast("binary"))}
    return edits.withColumns(extra), cuts


def hilbert_shards(edits: DataFrame, dims: Sequence[str], *, shards: int = 8, bits: int = BITS) -> DataFrame:
    """One row per edit: rev_id, size, crc, curve, shard, slot.

    ``edits`` needs ``rev_id``, ``diff`` and the columns named in ``dims`` (two or more numbers,
    times or strings); others are ignored. ``size`` is the text's UTF-8 length plus 1 and
    ``crc`` its CRC-32, a NULL text being empty. Shards hold equal row counts, at most one
    apart; ``slot`` counts from 0 in the order of the curve. NULL dimensions lie in the
    lowest cell, equal cells are ordered by ``rev_id``, CRC and size, and rows equal in all take
    neighbouring slots. Fewer rows than shards leave shards empty. No rows in, none out.
    """
    return _placed(edits, dims, shards, bits)[0]


def _placed(edits: DataFrame, dims: Sequence[str], shards: int, bits: int) -> tuple[DataFrame, list]:
    found, cuts = _with_curve(edits, dims, bits)
    narrow = found.select(
        F.col("rev_id").cast("bigint").alias("rev_id"), F.col("__size").alias("size"), F.col("__crc").alias("crc"), F.col("__curve").alias("curve")
    )
    # Stored, as a second run of the range sort could draw other bounds.
    narrow = stored(narrow, "curve")
    ranged = narrow.repartitionByRange(shuffle_width(edits.sparkSession), *_ORDER).sortWithinPartitions(*_ORDER)
    ranged = ranged.withColumn("run", F.spark_partition_id())
    runs = stored(ranged.mapInArrow(_numbered, "rev_id bigint, size bigint, crc bigint, curve bigint, run int, local bigint"), "curve-runs")
    # One row per partition of the range sort.
    lengths = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    before = lengths.select(
        "run", F.coalesce(F.sum("n").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias("before")
    )
    total = runs.count()
    place = runs.join(before, "run").withColumn("at", F.col("before") + F.col("local"))
    shard = F.floor(F.expr(f"at * {shards}L div {max(total, 1)}L")).cast("int")
    # The first place of shard s is the least p with p * shards >= s * total.
    first = F.expr(f"(cast(shard as bigint) * {total}L + {shards - 1}L) div {shards}L")
    return place.withColumn("shard", shard).select("rev_id", "size", "crc", "curve", "shard", (F.col("at") - first).alias("slot")), cuts


def write_shards(edits: DataFrame, dims: Sequence[str], folder: str, *, shards: int = 8, bits: int = BITS) -> DataFrame:
    """Write whole edits as one Parquet folder per shard, in curve order; the assignment is returned.

    Shard bounds, one key for each shard, are looked up by comparison, so texts move once.
    """
    placed, cuts = _placed(edits, dims, shards, bits)
    placed = stored(placed, "curve-shards")
    bounds = placed.where("slot = 0 AND shard > 0").orderBy("shard").select(*_ORDER).collect()
    whole, _ = _with_curve(edits, dims, bits, cuts)
    key = F.struct(F.col("__curve"), F.col("rev_id").cast("bigint"), F.col("__crc"), F.col("__size"))
    shard = F.lit(0)
    for b in bounds:
        bound = F.struct(*[F.lit(v).cast("bigint") for v in b])
        shard = shard + (key >= bound).cast("int")
    out = whole.withColumn("shard", shard)
    out = out.repartitionByRange(max(shards, shuffle_width(edits.sparkSession)), "shard", "__curve", "rev_id").sortWithinPartitions("shard", "__curve", "rev_id")
    out.drop("__curve", "__size", "__crc").write.partitionBy("shard").parquet(folder)
    return placed
