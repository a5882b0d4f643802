import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from helpers import AWKWARD, words

from tidemark.llm.curve_shards import hilbert_index, hilbert_shards, write_shards

DIMS = ("timestamp", "user", "size_delta")


def table(spark, n, hot=False):
    rows = []
    for i in range(n):
        text = AWKWARD[i % len(AWKWARD)] if i < 2 * len(AWKWARD) else words(i, 5)
        key = (1, "same", 0.0) if hot and i % 3 == 0 else (None if i % 17 == 0 else i * 7919 % 1000, None if i % 13 == 0 else f"User {i * 31 % 50}", float(i * 104729 % 700 - 300))
        rows.append((i, text, *key, i, i))
    return spark.createDataFrame(rows, "rev_id bigint, diff string, timestamp bigint, user string, size_delta double, curve int, shard int")


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 4), (3, 3), (4, 2), (5, 1)])
def test_the_curve_visits_every_cell_by_single_steps(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = hilbert_index(grid, bits)
    assert sorted(index) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("n,hot", [(0, False), (3, False), (8, False), (101, False), (300, True)])
def test_counts_are_even_and_slots_gapless(spark, n, hot):
    out = hilbert_shards(table(spark, n, hot).repartition(3), DIMS).collect()
    assert sorted(r.rev_id for r in out) == list(range(n))
    counts = Counter(r.shard for r in out)
    assert all(0 <= s < 8 for s in counts)
    if n:
        assert max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts.get(s, 0)))
    ordered = [r.curve for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert ordered == sorted(ordered)
    texts = {r.rev_id: (r.diff or "").encode() for r in table(spark, n, hot).collect()}
    assert all(r.size == len(texts[r.rev_id]) + 1 and r.crc == zlib.crc32(texts[r.rev_id]) for r in out)


def test_shards_are_narrower_than_the_whole_in_every_dimension(spark):
    df = table(spark, 4000)
    where = {r.rev_id: r.shard for r in hilbert_shards(df, ("timestamp", "size_delta")).collect()}
    rows = [r for r in df.collect() if r.timestamp is not None]
    for dim, whole in (("timestamp", 1000), ("size_delta", 700)):
        spans = []
        for s in range(8):
            values = [r[dim] for r in rows if where[r.rev_id] == s]
            spans.append((max(values) - min(values)) / whole)
        assert sum(spans) / 8 < 0.75


def test_written_shards_hold_the_rows_assigned(spark, tmp_path):
    df = table(spark, 120).drop("shard")
    placed = {r.rev_id: r.shard for r in write_shards(df, DIMS, f"file://{tmp_path}/s").collect()}
    back = spark.read.parquet(f"file://{tmp_path}/s").collect()
    assert {r.rev_id: r.shard for r in back} == placed and len(back) == 120


def test_repeated_rows_and_bad_dimensions(spark):
    df = table(spark, 20)
    out = hilbert_shards(df.union(df), DIMS).collect()
    assert len(out) == 40 and len({(r.shard, r.slot) for r in out}) == 40
    with pytest.raises(ValueError):
        hilbert_shards(df, ("user",))
