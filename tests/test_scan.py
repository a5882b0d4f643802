import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantiles, scan


@pytest.mark.parametrize("slices", [None, 1, 4])
def test_no_slice_is_larger_than_its_bound(spark, slices):
    """Half of the rows hold one value, over four shuffle partitions: runs stay bounded, contiguous and whole."""
    rng = random.Random(3)
    rows = [(i, 7 if rng.random() < 0.5 else rng.randrange(1000)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, v int").repartition(4)
    cut = scan.sliced(df, "v", "id", slices=slices, rows_per_slice=60)
    sizes = [r["count"] for r in cut.groupBy("slice").count().collect()]
    assert max(sizes) <= 60 and sum(sizes) == 2000 and len(sizes) >= 34
    edges = cut.groupBy("slice").agg(F.min(F.struct("v", "id")).alias("lo"), F.max(F.struct("v", "id")).alias("hi")).orderBy("slice").collect()
    assert all(tuple(a.hi) < tuple(b.lo) for a, b in zip(edges, edges[1:], strict=False))
    numbered = scan.numbered(df, "v", "id", rows_per_slice=60).collect()
    assert [(r.v, r.id) for r in sorted(numbered, key=lambda r: r.offset)] == sorted((v, i) for i, v in rows)
    assert sorted(r.offset for r in numbered) == list(range(2000))


def test_ranges_follow_the_number_of_rows(spark):
    assert [scan.ranges_for(spark, n) for n in (0, 1, 4_999, 10_000, 1_000_001, 70_000_000)] == [1, 1, 1, 2, 4, 70]


def test_empty_orders(spark):
    none = spark.createDataFrame([], "id bigint, v int")
    assert scan.sliced(none, "v").count() == 0 and scan.numbered(none, "v", "id").count() == 0


def test_percentiles_over_many_slices(spark, monkeypatch):
    rng = random.Random(4)
    values = [rng.choice([5, 5, 5, *range(300)]) for _ in range(900)]
    monkeypatch.setattr(scan, "ROWS_PER_BUCKET", 50)
    monkeypatch.setattr(scan.sliced, "__kwdefaults__", {**scan.sliced.__kwdefaults__, "rows_per_slice": 50})
    got = quantiles.summarise(spark.createDataFrame([(v,) for v in values], "v int"), [], "v").first()
    ordered = sorted(values)
    assert [got.p50, got.p95, got.p99] == [ordered[max(1, -(-len(ordered) * p // 100)) - 1] for p in (50, 95, 99)]
