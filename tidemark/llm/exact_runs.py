"""Exact duplicates among edit texts by a tree-merge of sorted digest runs.

Every partition turns its edits into one run: rows sorted by the SHA-256 of the
normalised text, equal digests already merged. Runs are then exchanged in binomial
rounds. In round r the 2^k partitions form pairs whose numbers differ in bit r; each
pair splits the digest space by the next digest bit, so one partner keeps the lower and
the other the upper half of both runs and merges them. After k rounds a partition holds
one k-bit digest range, merged over all runs. No partition ever holds the whole space,
and an edit text that owns a third of all rows is one row per run from the first level on.

The rows that partners exchange are merged by Spark's sort inside each partition, which spills and streams;
what the task adds is the fold of equal neighbours.

The smallest identifier of a digest is kept at each level: the edit with the most code
points, then the smallest ``rev_id``. A merge verifies what it joins: rows that share a
SHA-256 must agree on the normalised length and on an independent 64-bit hash, else the
job fails instead of dropping an edit.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import edit_columns, shuffle_width
from tidemark.session import stored

SPACE = r"[\x20\x09-\x0D]"
_RUN_COLUMNS = ("digest", "check_hash", "length", "chars", "keep_id", "group_size")
_RUN_SCHEMA = "digest binary, check_hash bigint, length bigint, chars bigint, keep_id bigint, group_size bigint"
_ARROW = pa.schema(
    [("digest", pa.binary()), ("check_hash", pa.int64()), ("length", pa.int64()), ("chars", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())]
)
BATCH = 20_000


class DigestMismatch(ValueError):
    """Two texts share a SHA-256 but are not equal."""


def fingerprints(edits: DataFrame) -> DataFrame:
    """(rev_id, digest, check_hash, length, chars) of every edit, texts compared without blanks."""
    bare = F.regexp_replace("diff", SPACE, "")
    return (
        edit_columns(edits)
        .select("rev_id", F.char_length("diff").cast("bigint").alias("chars"), bare.alias("bare"))
        .select(
            "rev_id",
            F.unhex(F.sha2(F.col("bare").cast("binary"), 256)).alias("digest"),
            F.xxhash64("bare").alias("check_hash"),
            F.octet_length("bare").cast("bigint").alias("length"),
            "chars",
        )
    )


def _id_order(chars: int, keep_id: int | None) -> tuple:
    return (-chars, keep_id is None, keep_id or 0)


def merged_runs(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Multiway merge of digest-sorted runs; one verified row per digest."""
    current: tuple | None = None
    for row in heapq.merge(*runs, key=lambda r: r[0]):
        if current is None or row[0] != current[0]:
            if current is not None:
                yield current
            current = row
            continue
        if row[1:3] != current[1:3]:
            raise DigestMismatch(row[0].hex())
        best = min(row, current, key=lambda r: _id_order(r[3], r[4]))
        current = (*best[:5], row[5] + current[5])
    if current is not None:
        yield current


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _RUN_COLUMNS), strict=True)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _merge_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spark hands over the partner runs sorted together; equal digests stand side by side."""
    yield from _batches(merged_runs([_rows(batches)]))


def _bit(position: int):
    """The digest bit at ``position``, the highest bit first."""
    byte = F.conv(F.hex(F.substring("digest", position // 8 + 1, 1)), 16, 10).cast("int")
    return F.shiftright(byte, 7 - position % 8).bitwiseAND(F.lit(1))


def winners(prints: DataFrame, rounds: int | None = None) -> DataFrame:
    """(digest, keep_id, group_size) per distinct text, merged over 2^rounds runs.

    ``prints`` is what :func:`fingerprints` returns. ``rounds`` defaults to the rounds
    that cover ``spark.sql.shuffle.partitions`` and is one at least; results do not depend on it.
    """
    k = max(1, (shuffle_width(prints.sparkSession) - 1).bit_length() if rounds is None else rounds)
    n = 1 << k
    # Level 0: any placement will do, so the scan's own partitions are dealt round the runs.
    rows = prints.select("digest", "check_hash", "length", "chars", F.col("rev_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    run = rows.sortWithinPartitions("digest").mapInArrow(_merge_partition, _RUN_SCHEMA)
    run = run.withColumn("at", F.spark_partition_id() % n)
    for r in range(k):
        # Partner numbers differ in bit r; the row goes to the one whose bit r is the digest's.
        partner = F.col("at").bitwiseAND(F.lit(~(1 << r))).bitwiseOR(F.shiftleft(_bit(r), r))
        run = run.withColumn("at", partner.cast("int")).repartitionById(n, F.col("at"))
        merged = run.sortWithinPartitions("digest").drop("at").mapInArrow(_merge_partition, _RUN_SCHEMA)
        run = merged.withColumn("at", F.spark_partition_id())
    return run.drop("at", "check_hash", "length", "chars")


def exact_duplicates(edits: DataFrame, rounds: int | None = None) -> DataFrame:
    """One row per edit, dropped ones too: rev_id, keep_id, group_size, kept, text_sha256.

    ``edits`` needs ``rev_id`` and ``diff``; other columns are ignored, whatever their
    names. Texts are equal when identical after deleting blanks; a NULL text is an empty
    one, and all empty texts are one group. The edit with the most code points stays, then
    the smallest ``rev_id``; a NULL ``rev_id`` comes last. A row that repeats an id and a
    text counts in ``group_size`` and is marked like its first copy. No rows in, none out.
    """
    prints = stored(fingerprints(edits), "digests")
    found = stored(winners(prints, rounds), "digest-runs")
    # The answer goes back to each row. The left side may hold a hot digest; it is dealt by
    # digest and a salt, and only digests that were found more than once travel to all salts.
    salts = 16
    many = found.where("group_size > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("rev_id"), F.lit(salts)).cast("int"))
    joined = salted.join(many, ["digest", "salt"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("rev_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "rev_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("rev_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
