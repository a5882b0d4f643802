import pytest
from pyspark.sql import functions as F

from conftest import DAY0, HOUR, MINUTE, edit, raw
from tidemark.sources import replay


def stamp(ms):
    from datetime import datetime, timezone

    return datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


@pytest.fixture
def captures(spark, tmp_path):
    """Six hours of one event a minute, a file for each hour; every tenth event comes 20 minutes late in the log."""
    events = [edit(DAY0 + i * MINUTE - (20 * MINUTE if i % 10 == 9 else 0), i) for i in range(360)]
    events[5] = "no json at all"
    rows = raw(spark, events)
    folder, index = str(tmp_path / "in"), str(tmp_path / "index")

    def land(hours):
        for h in hours:
            rows.where(F.col("offset").between(60 * h, 60 * h + 59)).coalesce(1).write.mode("append").json(folder)

    return folder, index, land, {i: DAY0 + i * MINUTE - (20 * MINUTE if i % 10 == 9 else 0) for i in range(360) if i != 5}


def test_only_files_that_can_hold_the_window_are_opened(spark, captures):
    folder, index, land, times = captures
    land(range(6))
    known = replay.index_captures(spark, folder, index)
    assert known.count() == 6 and known.agg(F.sum("rows")).first()[0] == 360
    for since, until, files in ((2 * HOUR, 3 * HOUR, 2), (2 * HOUR + 45 * MINUTE, 2 * HOUR + 50 * MINUTE, 2), (90 * MINUTE, 92 * MINUTE, 1), (9 * HOUR, 10 * HOUR, 0), (0, 6 * HOUR, 6)):
        rows = replay.replay(spark, folder, index, stamp(DAY0 + since), stamp(DAY0 + until))
        assert sorted(r.offset for r in rows.collect()) == [i for i, t in times.items() if since <= t - DAY0 < until]
        assert len(rows.inputFiles()) == files == len(replay.files_of_window(spark, folder, index, stamp(DAY0 + since), stamp(DAY0 + until)))
    part = replay.replay_offsets(spark, folder, index, 118, 121)
    assert sorted(r.offset for r in part.collect()) == [118, 119, 120, 121] and len(part.inputFiles()) == 2


def test_files_are_indexed_once_and_unknown_ones_are_opened(spark, captures):
    folder, index, land, times = captures
    assert replay.read_index(spark, index).count() == 0
    land(range(2))
    first = {r.file: r.rows for r in replay.index_captures(spark, folder, index).collect()}
    land(range(2, 4))
    # Not indexed yet, so any window must look into the new ones.
    rows = replay.replay(spark, folder, index, stamp(DAY0), stamp(DAY0 + 10 * MINUTE))
    assert sorted(r.offset for r in rows.collect()) == [i for i, t in times.items() if 0 <= t - DAY0 < 10 * MINUTE] and len(rows.inputFiles()) == 3
    again = {r.file: r.rows for r in replay.index_captures(spark, folder, index).collect()}
    assert len(again) == 4 and first.items() <= again.items()
    assert replay.index_captures(spark, folder, index).count() == 4


def test_a_window_is_complete_once_the_log_is_past_its_padding(spark, captures):
    folder, index, land, _ = captures
    land([0])
    known = replay.index_captures(spark, folder, index)
    done = lambda until, df=known: df.select(replay.is_complete(df, stamp(until)).alias("c")).first().c
    assert done(DAY0 + 56 * MINUTE) and not done(DAY0 + 58 * MINUTE)
    empty = known.where("false")
    assert not spark.range(1).select(replay.is_complete(empty, stamp(DAY0)).alias("c")).first().c
