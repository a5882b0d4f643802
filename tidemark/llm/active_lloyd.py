"""Vectors as short codes: one small codebook for each part of a vector, trained by active-entry Lloyd rounds.

A vector is cut into equal parts, and each part position has a codebook of entries. A round
assigns every part to its nearest entry and then moves every entry to the mean of its parts.
Each part keeps its entry and the exact distance to it. Where that entry stayed fixed in the last
move, all other fixed entries are as far as before, so only the moved ones are compared with the stored
distance; where it moved, the part is compared with all. Equal distances go to the
lower index in both cases, so the result is that of plain Lloyd rounds.

All arithmetic is in integers. Between rounds the assigned vectors are stored; what reaches the
driver is one sum for each entry, and what goes to the tasks is one codebook, both bounded by the number of entries.

The project's log holds no vectors, so this operator is general: any table of ids and arrays of numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1_024
#: Vectors compared at a time.
SLICE = 2_048
#: Largest component, scaled: sums of squared differences then fit 64 bits.
LIMIT = 1 << 26
#: Below this, products and their sums are exact in double precision, which multiplies faster.
_EXACT = 1 << 53
_STATE = "vec_id bigint, label string, x array<int>, code array<int>, distance array<bigint>"
_SUMS = "part int, entry int, n bigint, total array<bigint>"


class VectorShape(ValueError):
    """Vectors that cannot be cut into equal parts, or components beyond ``LIMIT``."""


@dataclass
class Codebooks:
    """Entries as (parts, entries, width) integers, and which of them moved last."""

    entries: np.ndarray
    moved: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of (n, width) parts to (k, width) entries, exact."""
    if not x.size or not entries.size:
        return np.zeros((len(x), len(entries)), np.int64)
    most = max(int(np.abs(x).max()), int(np.abs(entries).max()))
    if 4 * most * most * x.shape[1] < _EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j, None] - entries[None, :, j]
        out += d * d
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and distance of the nearest entry, the lower index among equals."""
    d = squared(x, entries)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def reassigned(x: np.ndarray, code: np.ndarray, distance: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``code`` and ``distance`` after a move of entries, where both were exact before it."""
    code, distance = code.copy(), distance.copy()
    rescan = moved[code]
    if rescan.any():
        code[rescan], distance[rescan] = nearest(x[rescan], entries)
    fixed, candidates = np.flatnonzero(~rescan), np.flatnonzero(moved)
    if len(fixed) and len(candidates):
        at, d = nearest(x[fixed], entries[candidates])
        at = candidates[at]
        better = (d < distance[fixed]) | ((d == distance[fixed]) & (at < code[fixed]))
        code[fixed[better]], distance[fixed[better]] = at[better], d[better]
    return code, distance


def _matrix(lists: pa.Array, kind) -> np.ndarray:
    return lists.flatten().to_numpy().astype(kind, copy=False).reshape(len(lists), -1)


def _rows(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.ravel(), kind))


def _assigner(books: Codebooks, first: bool):
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("x", pa.list_(pa.int32())), ("code", pa.list_(pa.int32())), ("distance", pa.list_(pa.int64()))])
    parts, _, width = books.entries.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n = part.num_rows
                x = _matrix(part.column(2), np.int64)
                code, distance = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
                if not first:
                    code, distance = _matrix(part.column(3), np.int64).copy(), _matrix(part.column(4), np.int64).copy()
                for p in range(parts):
                    own, entries = x[:, p * width : (p + 1) * width], books.entries[p]
                    if first:
                        code[:, p], distance[:, p] = nearest(own, entries)
                    else:
                        code[:, p], distance[:, p] = reassigned(own, code[:, p], distance[:, p], entries, books.moved[p])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), _rows(code, pa.int32()), _rows(distance, pa.int64())], schema=schema)

    return assign


def _summer(parts: int, entries: int, width: int):
    """Count and componentwise sum of each entry's parts, added up over the task."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, code = _matrix(batch.column(0), np.int64), _matrix(batch.column(1), np.int64)
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(total[p], code[:, p], x[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(n)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), _rows(total[part, entry], pa.int64())], schema=schema)

    return add


def moved_to_means(books: Codebooks, state: DataFrame) -> Codebooks:
    """Each entry at floor(sum / count) of its parts; entries without parts stay."""
    parts, entries, width = books.entries.shape
    sums = state.select("x", "code").mapInArrow(_summer(parts, entries, width), _SUMS)
    added = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(width)])
    new = books.entries.copy()
    # One row for each entry of a codebook.
    for row in added.collect():
        new[row.part, row.entry] = [t // row.n for t in row[3:]]
    return Codebooks(new, (new != books.entries).any(axis=2))


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x): components as floor(scale * component); unusable vectors are left out.

    A vector goes if it is NULL or holds a component that is NULL, NaN or infinite.
    """
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("vector").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    far = F.exists("v", lambda c: F.abs(c) * scale >= LIMIT)
    floor = F.transform("v", lambda c: F.floor(c * scale).cast("int"))
    wrong = F.raise_error(F.concat(F.lit("a component is beyond the limit in vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("NULL"))))
    return v.where(F.col("v").isNotNull() & ~bad).select("vec_id", "label", F.when(far, wrong.cast("array<int>")).otherwise(floor).alias("x"))


def _first_codebooks(ints: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The parts of the vectors with the smallest ids; repeated ids by their components, NULL ids last."""
    seeds = [r.x for r in ints.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    if not seeds:
        return None
    width = len(seeds[0])
    if width % parts:
        raise VectorShape(f"{width} components are not {parts} equal parts")
    if any(len(s) != width for s in seeds) or not ints.where(F.size("x") != width).isEmpty():
        raise VectorShape(f"not all vectors have {width} components")
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, width // parts).transpose(1, 0, 2)
    return Codebooks(np.ascontiguousarray(books), np.ones(books.shape[:2], bool))


@dataclass
class Compressed:
    """``codes`` is (vec_id, label, code, error, label_error); ``codebooks`` the final entries, None without vectors."""

    codes: DataFrame
    codebooks: Codebooks | None


def compressed(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Compressed:
    """Codes of all vectors after ``rounds`` Lloyd rounds and a last assignment.

    ``vectors`` needs ``vec_id``, ``vector`` (array of numbers) and ``label``; other columns are ignored.
    ``code`` holds one entry index for each part in order, two hex digits each; ``error`` is the sum
    of the parts' final squared distances, ``label_error`` its sum over equal labels, NULL labels being one.
    The codebooks start as the ``entries`` vectors with the smallest ids, or as all if there are fewer.
    Vectors that are NULL or hold a NULL or non-finite component are left out. Repeated rows
    count each. Vectors of unlike lengths, or of one that ``parts`` does not divide, fail the job, as do
    components of 2^26 or more when scaled. No usable vectors: no rows, no codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits")
    ints = stored(integer_vectors(vectors, scale), "integer-vectors")
    books = _first_codebooks(ints, parts, entries)
    spark = vectors.sparkSession
    if books is None:
        return Compressed(spark.createDataFrame([], "vec_id bigint, label string, code string, error bigint, label_error bigint"), None)
    state = stored(ints.mapInArrow(_assigner(books, True), _STATE), "assigned")
    for _ in range(rounds):
        books = moved_to_means(books, state)
        state = stored(state.mapInArrow(_assigner(books, False), _STATE), "assigned")
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    error = F.aggregate("distance", F.lit(0).cast("bigint"), lambda a, d: a + d)
    rows = state.select("vec_id", "label", code.alias("code"), error.alias("error"))
    # Stored, so that Spark sees how few labels there are, and can split a label that owns many rows.
    totals = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    joined = rows.join(totals, F.col("label").eqNullSafe(F.col("of")), "left")
    return Compressed(joined.select("vec_id", "label", "code", "error", "label_error"), books)
