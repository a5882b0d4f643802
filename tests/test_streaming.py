import json
import random
from dataclasses import replace
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from conftest import DAY0, HOUR, MINUTE, edit, iso, raw, tags
from tidemark.operators import enrich, labels, parse
from tidemark.sources import log
from tidemark.streaming import enriching, jobs, labelling, progress


def steady(n, seed=0):
    """One event a minute: edits, tags of recent ones, some deletions."""
    rng = random.Random(seed)
    for i in range(n):
        at, kind = DAY0 + i * MINUTE, rng.random()
        if kind < 0.7:
            yield edit(at, i, title=f"P{i % 50}")
        elif kind < 0.95:
            yield tags(at, max(0, i - rng.randrange(1, 40)))
        else:
            yield edit(at, 0, type="log", log_type="delete", log_action="delete", title=f"P{rng.randrange(50)}", revision={"new": 0})


def landed(spark, folder, rows, per_file):
    """``rows`` as one file for each run of offsets, in order."""
    n = rows.count()
    for lo in range(0, n, per_file):
        rows.where(F.col("offset").between(lo, lo + per_file - 1)).coalesce(1).write.mode("append").json(folder)


def test_rows_read_follow_the_batch_and_not_the_window(spark, tmp_path, monkeypatch):
    """Twenty batches of 30 minutes under a window of four hours: once edits close, every batch reads as much as the last."""
    monkeypatch.setattr(labelling, "RUN_BITS", 5)  # a run of revisions about as wide as a batch
    rules = replace(labels.LIVE, window_ms=4 * HOUR, outage_gap_ms=20 * MINUTE)
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events = raw(spark, list(steady(600)))
    landed(spark, src, events, 30)
    jobs.label_stream(log.stream_files(spark, src, log.RAW_SCHEMA), out, state, rules).awaitTermination()
    costs = [r for r in jobs_progress(spark, out)]
    assert [r.batch for r in costs] == list(range(20)) and all(r.rows_in == 30 for r in costs)
    # The open window holds nine batches; a batch reads its own, about two that close, their tags, and the few deletions.
    steady_cost = [r.rows_read for r in costs[11:]]
    assert max(steady_cost) <= 1.5 * min(steady_cost) and max(steady_cost) < 150
    got = sorted(map(tuple, jobs.read_labels(spark, out).select("source_offset", "rev_id", "label", "reverted_at").collect()))
    want = sorted(map(tuple, labels.label_log(parse.parse(events), rules).select("source_offset", "rev_id", "label", "reverted_at").collect()))
    assert got == want and sum(r.labels for r in costs) == len(want) > 150


def jobs_progress(spark, out):
    return labelling.label_progress(spark, out).orderBy("batch").collect()


def test_a_batch_that_breaks_before_its_state_is_invisible_and_replaced(spark, tmp_path, monkeypatch):
    rules = replace(labels.LIVE, window_ms=HOUR, outage_gap_ms=20 * MINUTE)
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events = raw(spark, list(steady(240, seed=3)))
    landed(spark, src, events, 60)
    prune, broken = labelling._prune, []

    def once(spark_, folder, before, b):
        if b == 2 and not broken:
            # Everything of the batch is written; its state is taken away, as if the driver had died before it.
            broken.append(b)
            labelling.delete(spark_, f"{folder}/state/batch={b}")
            raise RuntimeError("lost")
        prune(spark_, folder, before, b)

    monkeypatch.setattr(labelling, "_prune", once)
    stream = lambda: log.stream_files(spark, src, log.RAW_SCHEMA)
    with pytest.raises(Exception, match="lost"):
        jobs.label_stream(stream(), out, state, rules).awaitTermination()
    assert [r.batch for r in jobs_progress(spark, out)] == [0, 1]
    seen = jobs.read_labels(spark, out).count()
    jobs.label_stream(stream(), out, state, rules).awaitTermination()
    got = sorted(r.rev_id for r in jobs.read_labels(spark, out).collect())
    want = sorted(r.rev_id for r in labels.label_log(parse.parse(events), rules).collect())
    assert got == want and seen < len(want)


def report(batch, rows, end=None, latest=None, dropped=(), observed=None, run="r", second=0):
    operators = [{"operatorName": "dedupe", "numRowsTotal": 3, "numRowsDroppedByWatermark": d} for d in dropped]
    source = {"description": "s", "startOffset": None, "endOffset": end, "latestOffset": latest, "numInputRows": rows}
    return json.dumps({
        "id": "q", "runId": run, "name": None, "batchId": batch, "timestamp": iso(DAY0 + second * 1000), "numInputRows": rows, "durationMs": {"triggerExecution": 250},
        "eventTime": {"watermark": iso(DAY0)}, "stateOperators": operators, "sources": [source], "observedMetrics": observed or {},
    })


def test_counters_come_from_the_last_try_of_a_batch(spark):
    lines = [
        report(0, 10, observed={"read": {"rows": 10}, "written": {"rows": 7}}),
        report(1, 9, observed={"read": {"rows": 9}, "written": {"rows": 1}}, run="broken", second=5),
        report(1, 9, dropped=(2, 1), observed={"read": {"rows": 9}, "written": {"rows": 4}}, run="again", second=6),
        report(2, 0, second=7),
        "not a report",
    ]
    found = progress.parsed_reports(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(map(tuple, progress.stage_counts(found).collect())) == [("q", 0, 10, 7, 3, 0), ("q", 1, 9, 4, 2, 3)]
    assert sorted(map(tuple, progress.late_rows(found).collect())) == [("q", 0, 10, 0), ("q", 1, 9, 3)]


def test_lag_of_a_topic_adds_up_its_partitions(spark):
    at = lambda a, b: {"edits": {"0": a, "1": b}}
    lines = [report(0, 6, at(2, 4), at(10, 4)), report(1, 4, at(6, 4), at(10, 9), second=1), report(2, 9, at(10, 9), at(10, 9), second=2)]
    found = progress.source_lag(progress.parsed_reports(spark.createDataFrame([(x,) for x in lines], "value string"))).orderBy("batch").collect()
    assert [(r.committed, r.available, r.lag) for r in found] == [(6, 14, 8), (10, 19, 9), (19, 19, 0)]
    assert found[0].ended == datetime.fromtimestamp(DAY0 / 1000 + 0.25, timezone.utc).replace(tzinfo=None)


def test_the_listener_files_one_report_for_each_batch(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("offset"))
    landed(spark, str(tmp_path / "in"), rows, 10)
    reports = str(tmp_path / "reports")
    with progress.ProgressLog(spark, reports):
        stream = progress.count_read(log.stream_files(spark, str(tmp_path / "in"), "offset BIGINT"))
        query = jobs.to_table(progress.count_written(stream.where("offset % 4 = 0")), str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
    counts = progress.stage_counts(progress.read_progress(spark, reports)).orderBy("batch").collect()
    assert [(r.batch, r.read, r.written, r.skipped) for r in counts] == [(0, 10, 3, 7), (1, 10, 2, 8), (2, 10, 3, 7), (3, 10, 2, 8)]
    assert len(progress.reports_of(query)) >= 4
    lag = progress.lag_over_time(
        spark.createDataFrame([(datetime.fromtimestamp(DAY0 / 1000, timezone.utc), 40)], "at timestamp, n bigint"), progress.completions(progress.read_progress(spark, reports))
    )
    assert [r.lag for r in lag.orderBy("step").collect()] == [40, 30, 20, 10, 0]


def account_edits(spark, folder, rows, per_file):
    schema = "offset bigint, user string, user_class string, s bigint"
    data = spark.createDataFrame(rows, schema)
    landed(spark, folder, data, per_file)
    return log.stream_files(spark, folder, schema).select("offset", "user", "user_class", F.timestamp_seconds("s").alias("dt"))


@pytest.mark.parametrize("seed", range(2))
def test_streamed_accounts_equal_the_as_of_join_and_are_asked_once(spark, tmp_path, seed):
    rng = random.Random(seed)
    base = DAY0 // 1000
    # Out of order by up to two hours; one user has most edits, and some edits have none.
    rows = [(i, rng.choice(["A", "A", "A", "B", "C", None]), rng.choice(["registered"] * 4 + ["ip"]), base + i * 120 - rng.randrange(0, 7200)) for i in range(240)]
    snaps = [(rng.choice(["A", "B", "D"]), base + rng.randrange(-7200, 30_000), n) for n in range(150)]
    snapshots = spark.createDataFrame(snaps, "user string, s bigint, editcount bigint").select("user", F.timestamp_seconds("s").alias("as_of"), F.lit(None).cast("timestamp").alias("registration"), "editcount")
    stream = account_edits(spark, str(tmp_path / "in"), rows, 60)
    asked, found = [], []
    for run in ("a", "b"):
        out = str(tmp_path / run)
        enriching.enrich_stream(stream, enriching.snapshot_lookup(snapshots), out, str(tmp_path / "answers"), str(tmp_path / f"{run}-state")).awaitTermination()
        asked.append([r.asked for r in enriching.lookups(spark, out).orderBy("batch").collect()])
        found.append({r.offset: (r.account_as_of, r.account.editcount if r.account else None) for r in enriching.read_enriched(spark, out, stream).collect()})
    table = spark.createDataFrame(rows, "offset bigint, user string, user_class string, s bigint").select("offset", "user", "user_class", F.timestamp_seconds("s").alias("dt"))
    want = {r.offset: (r.account_as_of, r.account.editcount if r.account else None) for r in enrich.attach_accounts_as_of(table, snapshots).collect()}
    assert found[0] == found[1] == want and len(want) == 240 and sum(v[0] is not None for v in want.values()) > 40
    assert len(asked[0]) == 4 and all(asked[0]) and asked[1] == [0] * 4


def test_a_cell_is_asked_for_its_rest_only(spark):
    keys = spark.createDataFrame([("A", 7300), ("A", 7205), ("B", 3599)], "user string, t bigint")
    got = sorted(map(tuple, enriching._wanted(keys, 3600).collect()))
    assert got == [("A", 1, 7199), ("A", 2, 7300), ("B", -1, -1), ("B", 0, 3599)]


def test_a_batch_broken_between_two_sinks_is_invisible_until_its_retry(spark, tmp_path, monkeypatch):
    events = [edit(DAY0 + i * MINUTE, i) if i % 5 else "no json" for i in range(40)]
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    landed(spark, src, raw(spark, events), 20)
    dead, failed = parse.dead_letters, []

    def failing(parsed):
        if len(failed) < 2:
            failed.append(1)
            if len(failed) == 2:
                raise RuntimeError("disk full")
        return dead(parsed)

    monkeypatch.setattr(parse, "dead_letters", failing)
    stream = lambda: log.stream_files(spark, src, log.RAW_SCHEMA)
    with pytest.raises(Exception, match="disk full"):
        jobs.split_sink(stream(), out, state).awaitTermination()
    good, bad = jobs.read_split(spark, out)
    # The second batch has written its readable rows, and no reader sees them.
    assert (tmp_path / "out/readable/batch=1").exists() and good.count() == 16 and bad.count() == 4
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    jobs.split_sink(stream(), out, state).awaitTermination()
    good, bad = jobs.read_split(spark, out)
    assert sorted(r.offset for r in good.collect()) == [i for i in range(40) if i % 5]
    assert sorted(r.source_offset for r in bad.collect()) == list(range(0, 40, 5))
