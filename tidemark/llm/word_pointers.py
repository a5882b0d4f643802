"""Which classes of editors of a wiki write in other words: counts from sorted word pointers.

Edits are read in shards. A shard's texts stay one Arrow buffer, and every word start in it is a
pointer. Multikey quicksort orders the pointers by the words they point to, eight bytes at a
time: large slices are split three ways at a pivot, and the part equal to it goes on eight bytes
deeper; small slices are ordered at once. Equal words then stand side by side. The length of
such a run is the word's count, the number of edits in it its edit frequency, and both are
told apart by wiki and class. Shards are added up by Spark, which combines them before the shuffle.

On these counts rest two reports over smoothed shares ``p = 1 + floor(10^9 (n + 1) / (N + V))``, in
integers throughout: how far each two classes of a wiki diverge, and which words set a class
apart from its wiki. A pair's divergence adds up over blocks of words and of classes, so no task holds
all words of a wiki, nor all its classes. Words that neither class uses are all alike and are counted,
not visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.session import stored

#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 8_000_000
#: Slices up to this many pointers are ordered at once.
SMALL = 4_096
MIN_EDITS = 3
TOP = 200
SCALE = 1_000_000_000
#: Words and classes of one block of the pair sums, about.
BLOCK_WORDS = 2_048
BLOCK_CLASSES = 128
GROUP = ("wiki", "user_class")
COUNTS = "wiki string, user_class string, term string, n bigint, edits bigint"
_STEP = 8


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """The lower case of each byte, A to Z only, and whether it belongs to a word: letters and all beyond ASCII."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[65:91] = inside[97:123] = inside[128:] = True
    return lower, inside


_LOWER, _INSIDE = _byte_tables()
#: Keeps the first k bytes of a big-endian key.
_HEAD = np.array([0, *((0xFFFFFFFFFFFFFFFF << (64 - 8 * k)) & 0xFFFFFFFFFFFFFFFF for k in range(1, 9))], np.uint64)


class Pointers:
    """Word starts in a buffer of whole texts."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        at = at - at[0]
        self.text = _LOWER[raw]
        inside = _INSIDE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        follows = np.zeros(len(raw), bool)
        follows[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~follows | edge[:-1]))
        goes_on = np.zeros(len(raw), bool)
        goes_on[:-1] = inside[1:]
        self.length = np.flatnonzero(inside & (~goes_on | edge[1:])) + 1 - self.start
        self.edit = np.searchsorted(at, self.start, "right") - 1
        # Eight bytes from each place, as one number that orders like them; no word holds a zero byte.
        wide = np.zeros(len(raw) + _STEP, np.uint64)
        wide[: len(raw)] = self.text
        for width in (1, 2, 4):
            ahead = np.zeros_like(wide)
            ahead[:-width] = wide[width:]
            wide <<= np.uint64(8 * width)
            wide |= ahead
        self.window = wide

    def keys(self, pointers: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(self.length[pointers] - depth, 0, _STEP)
        place = np.minimum(self.start[pointers] + depth, len(self.window) - 1)
        return self.window[place] & _HEAD[left]

    def word(self, pointer: int) -> str:
        at = self.start[pointer]
        return self.text[at : at + self.length[pointer]].tobytes().decode()


def sorted_runs(p: Pointers, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their words, and for each whether a new word starts there."""
    order = np.arange(len(p.start))
    new = np.zeros(len(order), bool)
    slices = [(0, len(order), 0)]
    while slices:
        lo, hi, depth = slices.pop()
        if hi - lo <= small:
            _order_small(p, order, new, lo, hi, depth)
            continue
        part = order[lo:hi].copy()
        key = p.keys(part, depth)
        some = np.sort(key[:: max(1, len(key) // 9)])
        pivot = some[len(some) // 2]
        less, more = key < pivot, key > pivot
        a, b = lo + int(less.sum()), hi - int(more.sum())
        order[lo:a], order[a:b], order[b:hi] = part[less], part[~(less | more)], part[more]
        slices += [(lo, a, depth), (b, hi, depth)]
        # A key that ends in a zero byte is the end of the word: all of these are equal.
        if int(pivot) & 0xFF:
            slices.append((a, b, depth + _STEP))
        else:
            new[a] = True
    return order, new


def _order_small(p: Pointers, order: np.ndarray, new: np.ndarray, lo: int, hi: int, depth: int) -> None:
    """Order a slice whose words agree up to ``depth``: all its unfinished runs go deeper together."""
    if lo == hi:
        return
    run = np.full(hi - lo, lo)
    active = np.arange(lo, hi)
    while len(active):
        part = order[active]
        key = p.keys(part, depth)
        within = np.lexsort((key, run[active - lo]))
        order[active] = part[within]
        key, before = key[within], run[active - lo]
        head = np.ones(len(active), bool)
        head[1:] = (before[1:] != before[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(head)
        which = np.cumsum(head) - 1
        run[active - lo] = active[first][which]
        sizes = np.diff([*first, len(active)])
        # A run of one is done; so is one whose words ended.
        active = active[((key & np.uint64(0xFF)) != 0) & (sizes[which] > 1)]
        depth += _STEP
    new[np.unique(run)] = True


def shard_counts(wikis: list[str], classes: list[str], texts: pa.Array) -> pa.RecordBatch:
    """Count and edit frequency of each word in each (wiki, class) of one shard."""
    groups: dict[tuple[str, str], int] = {}
    of_edit = np.array([groups.setdefault(g, len(groups)) for g in zip(wikis, classes, strict=True)], np.int64)
    # Edits of a group stand together, so a run ordered by edit is ordered by group.
    together = np.argsort(of_edit, kind="stable")
    p = Pointers(texts.take(pa.array(together)))
    order, new = sorted_runs(p)
    n_edits = max(1, len(of_edit))
    by_edit, times = np.unique((np.cumsum(new) - 1) * n_edits + p.edit[order], return_counts=True)
    run, group = by_edit // n_edits, of_edit[together][by_edit % n_edits] if len(by_edit) else by_edit
    head = np.ones(len(by_edit), bool)
    head[1:] = (run[1:] != run[:-1]) | (group[1:] != group[:-1])
    first = np.flatnonzero(head)
    words = pa.array([p.word(i) for i in order[new].tolist()], pa.string())
    names = list(groups)
    at = pa.array(group[first])
    columns = [
        pa.array([g[0] for g in names], pa.string()).take(at),
        pa.array([g[1] for g in names], pa.string()).take(at),
        words.take(pa.array(run[first])),
        pa.array(np.add.reduceat(times, first) if len(first) else times, pa.int64()),
        pa.array(np.diff([*first, len(by_edit)]) if len(first) else times, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["wiki", "user_class", "term", "n", "edits"])


def _counter(shard_bytes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            texts = whole.column(2).combine_chunks()
            found = shard_counts(whole.column(0).to_pylist(), whole.column(1).to_pylist(), texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts)
            for at in range(0, found.num_rows, 50_000):
                yield found.slice(at, 50_000)

        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(2)).to_numpy()
            at = 0
            for i, n in enumerate(lengths.tolist()):
                if size and size + n > shard_bytes:
                    held.append(batch.slice(at, i - at))
                    yield from done()
                    held, size, at = [], 0, i
                size += n
            held.append(batch.slice(at))
        if held:
            yield from done()

    return count


def _groups(edits: DataFrame) -> DataFrame:
    none = F.lit("")
    return edits.select(*[F.coalesce(F.col(c).cast("string"), none).alias(c) for c in (*GROUP, "diff")])


def term_counts(edits: DataFrame, *, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(wiki, user_class, term, n, edits): occurrences of each word, and edits that hold it.

    ``edits`` needs ``wiki``, ``user_class`` and ``diff``; other columns are ignored. Words are
    runs of ASCII letters and characters beyond ASCII, with A to Z in lower case. A NULL wiki, class or text is
    an empty one, an empty text has no words, and repeated rows count each. No rows in, none out.
    """
    found = _groups(edits).mapInArrow(_counter(shard_bytes), COUNTS)
    return found.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("edits").alias("edits"))


def share(n: Column, size: Column, words: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale * (n + 1) / (size + words)), exact beyond 64 bits on the way."""
    wide = "decimal(20,0)"
    return F.lit(1).cast("bigint") + F.call_function(
        "div", F.lit(scale).cast("decimal(10,0)") * (n + 1).cast(wide), (size + words).cast(wide)
    )


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(edits: DataFrame, *, min_edits: int = MIN_EDITS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Counts of the words in at least ``min_edits`` edits of their wiki, with ``wiki_n``, their count in the wiki."""
    # One row for each class that uses the word.
    word = W.partitionBy("wiki", "term")
    counts = term_counts(edits, shard_bytes=shard_bytes)
    with_wiki = counts.withColumns({"wiki_n": F.sum("n").over(word), "wiki_edits": F.sum("edits").over(word)})
    return with_wiki.where(F.col("wiki_edits") >= min_edits).drop("edits", "wiki_edits")


def _sized_groups(edits: DataFrame, kept: DataFrame) -> DataFrame:
    """(wiki, user_class, place, size, wiki_size, words): every group of ``edits``, numbered in its wiki, and what its shares rest on."""
    sizes = kept.groupBy(*GROUP).agg(F.sum("n").alias("size"))
    words = kept.groupBy("wiki", "term").agg(F.max("wiki_n").alias("n")).groupBy("wiki").agg(F.sum("n").alias("wiki_size"), F.count(F.lit(1)).alias("words"))
    groups = _groups(edits).select(*GROUP).distinct()
    found = groups.join(sizes, [*GROUP], "left").join(words, "wiki", "left").na.fill(0, ["size", "wiki_size", "words"])
    return found.withColumn("place", F.row_number().over(W.partitionBy("wiki").orderBy("user_class")) - 1)


def _pair_sums(batch: pd.DataFrame) -> pd.DataFrame:
    """Sums of the gaps between the classes of two blocks over one block of words.

    Rows with a word hold its share in a class; rows without one hold the share of all unused words.
    """
    base = batch[batch.term.isna()]
    used = batch[batch.term.notna()]
    place = base.place.to_numpy()
    rows = pd.Series(np.arange(len(base)), index=place)
    columns, terms = pd.factorize(used.term)
    p = np.repeat(base.p.to_numpy(np.int64)[:, None], len(terms), axis=1)
    p[rows[used.place.to_numpy()].to_numpy(), columns] = used.p.to_numpy(np.int64)
    low, high = int(batch.low.iloc[0]), int(batch.high.iloc[0])
    block = base.block.to_numpy()
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    out = []

    def add(a: int, others: np.ndarray) -> None:
        d = p[a] - p[others]
        out.append(pd.DataFrame({"place": place[a], "other": place[others], "value": (d * d // p[others]).sum(axis=1)}))

    for a in left:
        add(a, right)
    if low != high:
        for b in right:
            add(b, left)
    found = pd.concat(out)
    found.insert(0, "wiki", batch.wiki.iloc[0])
    found["seen"] = len(terms)
    return found[found.place != found.other]


def pair_divergence(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(wiki, user_class, item, value): for each two classes of a wiki, the gap of the first to the second over all kept words.

    The result has a row for each ordered pair of classes; no pairs of edits or words are formed.
    """
    of_wiki = groups.groupBy("wiki").agg(F.max(F.floor(F.col("place") / BLOCK_CLASSES)).alias("last_block"))
    known = groups.where("words > 0").join(of_wiki, "wiki").withColumns({
        "block": F.floor(F.col("place") / BLOCK_CLASSES),
        "slices": F.ceil(F.col("words") / BLOCK_WORDS),
        "zero": share(F.lit(0), F.col("size"), F.col("words")),
    })
    use = kept.join(known, [*GROUP]).select(
        "wiki", "place", "block", "last_block", "term", share(F.col("n"), F.col("size"), F.col("words")).alias("p"), F.pmod(F.xxhash64("term"), "slices").alias("slice")
    )
    none = known.select("wiki", "place", "block", "last_block", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"))
    dealt = use.unionByName(none).withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last_block"))))
    dealt = dealt.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")}).drop("with", "last_block")
    sums = dealt.groupBy("wiki", "slice", "low", "high").applyInPandas(_pair_sums, "wiki string, place bigint, other bigint, value bigint, seen bigint")
    sums = sums.groupBy("wiki", "place", "other").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    zero = F.when(F.col("words") > 0, share(F.lit(0), F.col("size"), F.when(F.col("words") > 0, F.col("words")))).alias("zero")
    a = groups.select("wiki", "user_class", "place", "words", zero)
    b = groups.select("wiki", F.col("user_class").alias("item"), F.col("place").alias("other"), zero.alias("other_zero"))
    pairs = a.join(b, "wiki").where("place <> other").join(sums, ["wiki", "place", "other"], "left")
    unused = (F.col("words") - F.coalesce("seen", F.lit(0))) * gap(F.col("zero"), F.col("other_zero"))
    value = F.when(F.col("words") == 0, F.lit(0).cast("bigint")).otherwise(F.coalesce("value", F.lit(0)) + unused)
    return pairs.select(*GROUP, "item", value.cast("bigint").alias("value"))


def term_divergence(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(wiki, user_class, item, value, rank): the words a class uses more than its wiki, by their gap, the first ``top`` of each class."""
    p, q = share(F.col("n"), F.col("size"), F.col("words")), share(F.col("wiki_n"), F.col("wiki_size"), F.col("words"))
    found = kept.join(groups, [*GROUP]).select(*GROUP, F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    return _ranked(found.select(*GROUP, "item", gap(F.col("p"), F.col("q")).alias("value"))).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))


def divergence(edits: DataFrame, *, min_edits: int = MIN_EDITS, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(wiki, user_class, part, item, value, rank): how the classes of editors of each wiki differ in words.

    ``edits`` needs ``wiki``, ``user_class`` and ``diff``; other columns are ignored. A word is kept in a
    wiki where at least ``min_edits`` of its edits hold it. Part ``pair`` has each other class of
    the wiki as item, part ``term`` a class's own words, at most ``top``. Ranks go by value, then
    by item in UTF-8 order. A NULL wiki, class or text is an empty one; a class without words is a group all the
    same, and in a wiki that keeps no words all pairs have value 0. No rows in, none out.
    """
    kept = stored(kept_terms(edits, min_edits=min_edits, shard_bytes=shard_bytes), "kept-terms")
    groups = stored(_sized_groups(edits, kept), "word-groups")
    pairs = _ranked(pair_divergence(kept, groups)).withColumn("part", F.lit("pair"))
    terms = term_divergence(kept, groups, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select(*GROUP, "part", "item", "value", F.col("rank").cast("int").alias("rank"))
