"""Bytes of edit texts that stand in a repeated stretch of 200 bytes, found by suffix sorting.

Sorting every suffix of a corpus moves each byte hundreds of times, so only suffixes at
content-defined anchors are sorted. Of the 50-byte grams inside a 200-byte window the one with
the least hash, leftmost among equals, is the window's anchor: equal windows have equal
anchors at equal places, so they can only meet in the group of that gram.

1. Anchors of every text, with the run of windows each stands for. A gram that occurs once
   ends here.
2. Texts that hold repeated grams hand out each anchor's context: the bytes of its windows.
3. In a gram's group, the suffixes right of the anchors and the reversed prefixes left of them
   are ordered by deep-shallow sorting. Anchors that share L bytes leftwards and R bytes rightwards,
   L + R >= 200, cover [anchor - L, anchor + R). The longest L and R of each follow from
   neighbours in the two orders; no pairs are formed.
4. A gram with too many anchors is dealt by salt. Each part is sorted alone; windows that are
   single there are looked up among the other parts' by a digest of their bytes.

Texts that are equal as a whole are reduced to one beforehand: every byte of them goes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import edit_columns
from tidemark.llm.deep_shallow import common_prefix, deep_shallow_order
from tidemark.session import stored

LENGTH = 200
GRAM = 50
#: Anchors of one gram that a task sorts together; more are dealt by salt.
CROWD = 5_000
#: A text is read in stretches of this many windows.
STRETCH = 1 << 22
_PLACE_BITS = 24
SALTS = 16

_SALT = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class AnchorFinder:
    """Anchors of byte strings; powers for the rolling hash are kept between texts."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        with np.errstate(over="ignore"):
            self.table = _mixed(np.arange(1, 257, dtype=np.uint64) * _SALT)
        self.base = 0x2545F4914F6CDD1D
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        size = 1 << max(12, (n - 1).bit_length())
        steps = [np.full(size, x, np.uint64) for x in (self.base, pow(self.base, -1, 1 << 64))]
        with np.errstate(over="ignore"):
            for s in steps:
                s[0] = 1
            self.powers, self.inverse = (np.multiply.accumulate(s) for s in steps)

    def _stretch(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        n, g, w = len(data), self.gram, self.width
        if len(self.powers) < n:
            self._grow(n)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.table[data] * self.powers[:n], dtype=np.uint64)])
            hashes = _mixed((sums[g:] - sums[:-g]) * self.inverse[: n - g + 1])
        # The upper hash bits, then the place: a minimum is the leftmost of the least.
        m = len(hashes)
        packed = (hashes & ~np.uint64((1 << _PLACE_BITS) - 1)) | np.arange(m, dtype=np.uint64)
        blocks = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
        blocks[:m] = packed
        blocks = blocks.reshape(-1, w)
        left = np.minimum.accumulate(blocks, 1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        windows = n - self.length + 1
        least = np.minimum(right[:windows], left[w - 1 : w - 1 + windows])
        place = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        end = np.concatenate([start[1:], [windows]]) - 1
        at = place[start]
        return hashes[at].view(np.int64), at, start, end

    def anchors(self, text: bytes) -> tuple[np.ndarray, ...]:
        """(gram hash, place, first window, last window) of each anchor; windows are named by their first byte."""
        if len(text) < self.length:
            return (np.empty(0, np.int64),) * 4
        data = np.frombuffer(text, np.uint8)
        parts = []
        for i in range(0, len(data) - self.length + 1, STRETCH):
            gram, at, start, end = self._stretch(data[i : i + STRETCH + self.length - 1])
            parts.append((gram, at + i, start + i, end + i))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_key(text: bytes) -> tuple[int, int]:
    """Two 64-bit hashes; the first is also what ``F.xxhash64`` gives for the text."""
    return _signed(xxhash.xxh64_intdigest(text, seed=42)), _signed(xxhash.xxh3_64_intdigest(text))


_PRINTS = "rev_id bigint, k1 bigint, k2 bigint, n_bytes bigint, text_sha256 string"
_ANCHORS = "gram bigint, k1 bigint, k2 bigint, place bigint, back int, ahead int, twice boolean"


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.encode() for t in batch.column(1).to_pylist()]
        keys = [text_key(t) for t in texts]
        columns = [batch.column(0), *[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)], pa.array([len(t) for t in texts], pa.int64())]
        columns.append(pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names=["rev_id", "k1", "k2", "n_bytes", "text_sha256"])


def _anchors(length: int, gram_length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = AnchorFinder(length, gram_length)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                held = []
                for text in batch.column(0).slice(i, 500).to_pylist():
                    text = text.encode()
                    gram, at, start, end = finder.anchors(text)
                    if len(gram):
                        _, where, n = np.unique(gram, return_inverse=True, return_counts=True)
                        k1, k2 = text_key(text)
                        held.append((gram, np.full(len(gram), k1), np.full(len(gram), k2), at, (at - start).astype(np.int32), (at - end).astype(np.int32), n[where] > 1))
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["gram", "k1", "k2", "place", "back", "ahead", "twice"])

    return find


_CONTEXTS = "gram bigint, salt int, salted boolean, k1 bigint, k2 bigint, place bigint, back int, context binary"


def _contexts(length: int, crowd: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                out: dict[str, list] = defaultdict(list)
                for k1, k2, text, anchors in zip(*(c.to_pylist() for c in batch.slice(i, 100).columns), strict=True):
                    text = text.encode()
                    for a in anchors:
                        place, back, ahead = a["place"], a["back"], a["ahead"]
                        parts = -(-a["n"] // crowd)
                        out["gram"].append(a["gram"])
                        out["salt"].append((k1 ^ place) % parts)
                        out["salted"].append(parts > 1)
                        out["k1"].append(k1)
                        out["k2"].append(k2)
                        out["place"].append(place)
                        out["back"].append(back)
                        out["context"].append(text[place - back : place - ahead + length])
                if out:
                    kinds = {"salt": pa.int32(), "back": pa.int32(), "salted": pa.bool_(), "context": pa.binary()}
                    yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    return cut


def covered(lefts: list[bytes], rights: list[bytes], length: int) -> list[tuple[int, int]]:
    """For each anchor the longest L and R that it shares with others at once, L + R >= length; else (0, 0).

    ``lefts`` are reversed. At each length that neighbours in the left order share, the runs of
    anchors that share it are looked at in the right order: an anchor's best partner in a run
    stands next to it there.
    """
    found = [(0, 0)] * len(lefts)

    def meet(x: int, y: int, left: int) -> None:
        right = common_prefix(rights[x], rights[y])
        if left + right >= length:
            for i in (x, y):
                found[i] = (max(found[i][0], left), max(found[i][1], right))

    if len(lefts) == 2:
        meet(0, 1, common_prefix(*lefts))
        return found
    by_left = deep_shallow_order(lefts)
    rank = {i: r for r, i in enumerate(deep_shallow_order(rights))}
    shared = [common_prefix(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:], strict=False)]
    for level in sorted(set(shared), reverse=True):
        i = 0
        while i < len(shared):
            if shared[i] < level:
                i += 1
                continue
            j, new = i, False
            while j < len(shared) and shared[j] >= level:
                new |= shared[j] == level
                j += 1
            # A run is worth a look at the level where it came together.
            if new:
                run = sorted(by_left[i : j + 1], key=rank.__getitem__)
                for x, y in zip(run, run[1:], strict=False):
                    meet(x, y, level)
            i = j + 1
    return found


_FOUND = "k1 bigint, k2 bigint, start bigint, end bigint, h1 bigint, h2 bigint"
_FOUND_ARROW = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "start", "end", "h1", "h2")])


def _groups(length: int):
    def one(rows: list[tuple]) -> Iterator[tuple]:
        alike: dict[tuple, list[tuple]] = defaultdict(list)
        for _, _, _, k1, k2, place, back, context in rows:
            alike[back, context].append((k1, k2, place))
        kinds = list(alike)
        for back, context in kinds:
            if len(alike[back, context]) > 1 and len(context) >= length:
                for k1, k2, place in alike[back, context]:
                    yield (k1, k2, place - back, place - back + len(context), None, None)
        if len(kinds) > 1:
            lefts = [c[:b][::-1] for b, c in kinds]
            rights = [c[b:] for b, c in kinds]
            for kind, (left, right) in zip(kinds, covered(lefts, rights, length), strict=True):
                if left + right >= length:
                    for k1, k2, place in alike[kind]:
                        yield (k1, k2, place - left, place + right, None, None)
        if rows[0][2]:
            yield from _windows(alike, length)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:2] != row[:2]:
                    if len(held) > 1 or held[0][2]:
                        out += one(held)
                    held = []
                    if len(out) > 20_000:
                        yield _found(out)
                        out = []
                held.append(row)
        if len(held) > 1 or held and held[0][2]:
            out += one(held)
        if out:
            yield _found(out)

    return sort


def _windows(alike: dict, length: int) -> Iterator[tuple]:
    """A row for each distinct window of one salted part, with its place if it is single here."""
    seen: dict[int, tuple | None] = {}
    for (back, context), places in alike.items():
        for i in range(len(context) - length + 1):
            h = xxhash.xxh3_128_intdigest(context[i : i + length])
            single = len(places) == 1 and h not in seen
            k1, k2, place = places[0]
            seen[h] = (k1, k2, place - back + i) if single else None
    for h, at in seen.items():
        k1, k2, start = at or (None, None, None)
        yield (k1, k2, start, None if at is None else start + length, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63))


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_FOUND_ARROW)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            spans, rest = [], []
            for text, found in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                text = text.encode()
                runs: list[list[int]] = []
                for s in sorted((f["start"], f["end"]) for f in found):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                edges = [0, *[x for r in runs for x in r], len(text)]
                spans.append([{"start": a, "end": b} for a, b in runs])
                rest.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, kind), pa.array(rest, pa.binary())], names=["k1", "k2", "spans", "kept"])


def repeated_stretches(edits: DataFrame, *, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """One row per edit: rev_id, n_bytes, text_sha256, spans, kept.

    ``edits`` needs ``rev_id`` and ``diff``; other columns are ignored. Texts are UTF-8 bytes,
    NULL an empty one. ``spans`` (start, end) are the maximal runs of bytes that some string
    of ``length`` bytes covers which also starts anywhere else, in the same edit or in another
    one; matches do not cross edits. ``kept`` is what is left, as bytes since a
    run may cut a character, and NULL where nothing goes. A repeated row is another place, so
    texts of ``length`` bytes or more that occur twice go whole; shorter ones are never
    touched. No rows in, none out.
    """
    v = edit_columns(edits)
    prints = stored(v.mapInArrow(_prints, _PRINTS), "text-prints")
    long_ones = prints.where(F.col("n_bytes") >= length)
    several = stored(long_ones.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "equal-texts")

    anchors = stored(v.select("diff").mapInArrow(_anchors(length, gram), _ANCHORS), "anchors")
    grams = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("k1").alias("x"), F.max("k1").alias("y"), F.max("twice").alias("twice"))
    # Stored, so that the join has a shuffle of its own that Spark can split at a hot gram.
    repeated = stored(grams.where((F.col("x") != F.col("y")) | F.col("twice")).select("gram", "n"), "repeated-grams")
    # Equal texts have equal anchors: a set keeps each once.
    per_text = anchors.join(repeated, "gram").groupBy("k1", "k2").agg(F.collect_set(F.struct("gram", "place", "back", "ahead", "n")).alias("anchors"))
    per_text = stored(per_text, "text-anchors")

    # One edit lends its text to all equal ones.
    lender = prints.groupBy("k1", "k2").agg(F.min("rev_id").alias("lender")).join(per_text, ["k1", "k2"])
    same = v["rev_id"].eqNullSafe(F.col("lender")) & (F.xxhash64(v["diff"]) == F.col("k1"))
    texts = stored(v.join(lender, same).select("k1", "k2", "diff", "anchors"), "anchored-texts")
    contexts = texts.select("k1", "k2", "diff", "anchors").mapInArrow(_contexts(length, crowd), _CONTEXTS)
    dealt = contexts.repartition("gram", "salt").sortWithinPartitions("gram", "salt")
    found = stored(dealt.mapInArrow(_groups(length), _FOUND), "repeats")
    direct = found.where(F.col("h1").isNull()).select("k1", "k2", "start", "end")
    windows = found.where(F.col("h1").isNotNull())
    again = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    single = windows.where(F.col("start").isNotNull()).join(again, ["h1", "h2"]).select("k1", "k2", "start", "end")
    runs = direct.unionByName(single).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    # Texts that occur several times go whole and need no cutting.
    open_ = runs.join(several.select("k1", "k2"), ["k1", "k2"], "left_anti")
    cut = texts.join(open_, ["k1", "k2"]).select("k1", "k2", "diff", "found")
    cut = cut.mapInArrow(_kept, "k1 bigint, k2 bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    nothing = F.lit(None).cast("binary")
    short = prints.where(F.col("n_bytes") < length).select("rev_id", "n_bytes", "text_sha256", none.alias("spans"), nothing.alias("kept"))
    # A text that many edits share is dealt by a salt.
    salted = long_ones.withColumn("salt", F.pmod(F.xxhash64("rev_id"), F.lit(SALTS)).cast("int"))
    mark = several.select("k1", "k2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("whole"))
    marked = stored(salted.join(mark, ["k1", "k2", "salt"], "left").drop("salt"), "marked-texts")
    all_of_it = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    gone = marked.where("whole").select("rev_id", "n_bytes", "text_sha256", all_of_it.alias("spans"), F.lit(b"").alias("kept"))
    alone = marked.where(F.col("whole").isNull()).join(cut, ["k1", "k2"], "left")
    alone = alone.select("rev_id", "n_bytes", "text_sha256", F.coalesce("spans", none).alias("spans"), "kept")
    return short.unionByName(gone).unionByName(alone)
