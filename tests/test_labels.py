import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import DAY0, HOUR, MINUTE, edit, raw, tags, tick, ticks
from tidemark.operators import audit, enrich, labels, parse
from tidemark.plans import jobs
from tidemark.streaming import jobs as streaming

RULES = replace(labels.LIVE, outage_gap_ms=100 * HOUR)


def run(spark, events, rules=RULES):
    rows = labels.label_log(parse.parse(raw(spark, events)), rules).collect()
    return {r["rev_id"]: r for r in rows}


END = DAY0 + 72 * HOUR + 10 * MINUTE


@pytest.mark.parametrize(
    "later, want",
    [
        ([tags(DAY0 + 5 * HOUR, 1)], "reverted"),
        ([tags(DAY0 + 72 * HOUR, 1)], "reverted"),
        ([tags(DAY0 + 72 * HOUR + MINUTE, 1)], "not-reverted"),
        ([tags(DAY0 + HOUR, 1, prior=["mw-reverted"])], "not-reverted"),
        ([tags(DAY0 + HOUR, 1, tags=["mw-undo"])], "not-reverted"),
        ([tags(DAY0 + HOUR, 1, database="dewiki")], "not-reverted"),
        ([edit(DAY0 + HOUR, 0, type="log", log_type="delete", log_action="delete", title="Page 1", revision={"new": 5})], "deleted"),
        ([edit(DAY0 + HOUR, 0, type="log", log_type="delete", log_action="restore", title="Page 1", revision={"new": 5})], "not-reverted"),
        # Arrives late, yet inside the grace period.
        ([tick(DAY0 + 72 * HOUR + 5 * MINUTE), tags(DAY0 + 72 * HOUR - MINUTE, 1)], "reverted"),
        # Arrives after the label was due.
        ([tick(DAY0 + 73 * HOUR), tags(DAY0 + 2 * HOUR, 1)], "not-reverted"),
        # The first tag in log order decides, even if a later one is earlier in time.
        ([tags(DAY0 + 5 * HOUR, 1), tags(DAY0 + 6 * HOUR, 1)], "reverted"),
    ],
)
def test_label_values(spark, later, want):
    got = run(spark, [edit(DAY0, 1), *later, tick(END + HOUR)])
    assert got[1]["label"] == want
    if later and want == "reverted" and len(later) == 1 and "rev_id" in later[0] and later[0]["meta"]["dt"].startswith(edit(DAY0 + 5 * HOUR, 1)["meta"]["dt"][:13]):
        assert got[1]["revert_delay_seconds"] == 18_000


def test_nothing_before_the_window_and_grace_have_passed(spark):
    assert run(spark, [edit(DAY0, 1), tick(END - MINUTE)]) == {}
    assert run(spark, [edit(DAY0, 1), tick(END)])[1]["label"] == "not-reverted"


def test_scope(spark):
    events = [edit(DAY0, 1, wiki="dewiki"), edit(DAY0, 2, namespace=1), tags(DAY0 + HOUR, 77), tick(END + HOUR)]
    assert run(spark, events) == {}


def test_hole_makes_incomplete_unless_reverted(spark):
    short = replace(labels.LIVE, window_ms=2 * HOUR, outage_gap_ms=30 * MINUTE)
    events = [edit(DAY0, 1), edit(DAY0, 2), tags(DAY0 + 5 * MINUTE, 2)]
    # An hour of silence, then an edit after the hole.
    events += [tick(DAY0 + 65 * MINUTE), edit(DAY0 + 66 * MINUTE, 3), *ticks(DAY0 + 70 * MINUTE, DAY0 + 4 * HOUR, 10 * MINUTE)]
    got = run(spark, events, short)
    assert {k: r["label"] for k, r in got.items()} == {1: "incomplete", 2: "reverted", 3: "not-reverted"}
    timed = labels.with_event_time(labels.timeline(parse.parse(raw(spark, events)), short), short)
    assert labels.outages(timed, short).count() == 1


def test_every_third_edit_tagged(spark):
    events = [e for i in range(50) for e in ([edit(DAY0 + i * MINUTE, i + 1)] + ([tags(DAY0 + i * MINUTE + HOUR // 2, i + 1)] if i % 3 == 0 else []))]
    got = run(spark, events + [tick(DAY0 + 80 * HOUR)])
    assert sum(r["label"] == "reverted" for r in got.values()) == 17 and len(got) == 50


def naive(events, rules):
    """The definition, event by event."""
    from datetime import datetime

    ms = lambda s: round(datetime.fromisoformat(s.replace("Z", "+00:00")).timestamp() * 1000)
    mark, waiting, out = None, [], {}
    for e in events:
        dt = ms(e["meta"]["dt"])
        if mark is not None and dt - mark > rules.outage_gap_ms:
            for w in waiting:
                if w["edit"] <= dt:
                    w["hole"] = True
        mark = dt if mark is None else max(mark, dt)
        if "rev_id" in e:
            for w in waiting:
                if w["rev"] == e["rev_id"] and w["tag"] is None:
                    w["tag"] = dt
        elif e["type"] == "log":
            for w in waiting:
                if w["title"] == e["title"] and dt <= w["edit"] + rules.window_ms:
                    w["gone"] = True
        elif e["wiki"] == rules.wiki:
            waiting.append({"rev": e["revision"]["new"], "title": e["title"], "edit": e["timestamp"] * 1000, "tag": None, "gone": False, "hole": False})
        while waiting and mark >= waiting[0]["edit"] + rules.window_ms + rules.grace_ms:
            w = waiting.pop(0)
            hit = w["tag"] is not None and w["tag"] <= w["edit"] + rules.window_ms
            out[w["rev"]] = "reverted" if hit else "deleted" if w["gone"] else "incomplete" if w["hole"] else "not-reverted"
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4, 5])
def test_random_logs_equal_the_definition(spark, seed):
    rng = random.Random(seed)
    rules = replace(labels.LIVE, window_ms=2 * HOUR, outage_gap_ms=12 * MINUTE, rows_per_bucket=23)
    now, events, revs = DAY0, [], []
    for i in range(400):
        now += rng.choice([10_000, 60_000, 300_000, 700_000 if rng.random() < 0.2 else 5_000, 800_000 if rng.random() < 0.3 else 0])
        # Some events arrive long after the grace.
        at = now - rng.choice([0, 0, 0, 60_000, 240_000, 2_400_000 if rng.random() < 0.4 else 0])
        kind = rng.random()
        # One page and one revision range draw a third of all events.
        title = "Hot" if rng.random() < 0.33 else f"P{rng.randrange(30)}"
        if kind < 0.5:
            revs.append(i)
            events.append(edit(at, i, title=title))
        elif kind < 0.75 and revs:
            events.append(tags(at, rng.choice(revs[-15:])))
        elif kind < 0.85:
            events.append(edit(at, 0, type="log", log_type="delete", log_action="delete", title=title, revision={"new": 0}))
        else:
            events.append(tick(at))
    events += [tick(now + 5 * HOUR)]
    got = {k: r["label"] for k, r in run(spark, events, rules).items()}
    assert got == naive(events, rules)
    assert len(set(got.values())) >= 3


def deletion(ms, title):
    return edit(ms, 1, type="log", log_type="delete", log_action="delete", title=title)


def test_a_late_deletion_inside_the_window_counts_whatever_came_before(spark):
    gone = [deletion(DAY0 + 72 * HOUR + 5 * MINUTE, "A"), deletion(DAY0 + 71 * HOUR, "A"), tick(DAY0 + 72 * HOUR + 7 * MINUTE), deletion(DAY0 + 70 * HOUR, "A")]
    events = [edit(DAY0, 10, title="A"), *ticks(DAY0 + MINUTE, DAY0 + 72 * HOUR, MINUTE * 2), *gone, *ticks(DAY0 + 72 * HOUR + 8 * MINUTE, DAY0 + 74 * HOUR, MINUTE)]
    got = labels.label_log(parse.parse(raw(spark, events))).collect()
    assert [(r["rev_id"], r["label"]) for r in got] == [(10, "deleted")]


def test_guards_hold_for_readers_that_drop_the_checked_column(spark):
    parsed = parse.parse(raw(spark, [edit(DAY0, 1), edit(DAY0 + 73 * HOUR, 2), tick(DAY0 + 73 * HOUR + MINUTE)]))
    young = enrich.require_closed(parse.edits(parsed), F.timestamp_millis(F.lit(DAY0 + 100_000)))
    with pytest.raises(Exception, match="has not closed"):
        young.agg(F.count("*"), F.max("title")).collect()
    accounts = spark.createDataFrame([], "user string, registration timestamp, editcount bigint, as_of timestamp")
    with pytest.raises(Exception, match="no label for revision 2"):
        jobs.filter_table(parsed, accounts).agg(F.count("*")).collect()
    assert {r["open_edits"] for r in jobs.trade_off(parsed, accounts).collect()} == {1}


def appended(spark, tmp_path, name, rows, schema="source_offset bigint, v int"):
    src = str(tmp_path / f"in-{name}")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema(schema).json(src)
    streaming.append_new(stream, str(tmp_path / "table"), str(tmp_path / f"state-{name}")).awaitTermination()
    return sorted(r["source_offset"] for r in spark.read.parquet(str(tmp_path / "table")).collect())


def test_append_new_writes_each_offset_once(spark, tmp_path):
    assert appended(spark, tmp_path, "a", [(1, 1), (2, 1), (2, 1), (5_000_000, 1)]) == [1, 2, 5_000_000]
    # Another stream replays a part: only what is new is added, from the runs its offsets fall into.
    assert appended(spark, tmp_path, "b", [(2, 9), (3, 9), (3, 9), (5_000_000, 9)]) == [1, 2, 3, 5_000_000]
    assert len(list((tmp_path / "table").glob("source_offset_run=*"))) == 2


def test_append_new_refuses_a_table_without_the_key(spark, tmp_path):
    spark.createDataFrame([(1, 0)], "other int, source_offset_run bigint").write.partitionBy("source_offset_run").parquet(str(tmp_path / "table"))
    with pytest.raises(Exception, match="source_offset"):
        appended(spark, tmp_path, "c", [(1, 1)])


def test_next_event_with_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.4 else f"u{rng.randrange(9)}", rng.choice(["a", "b", "c"]), DAY0 // 1000 + i * 60) for i in range(500)]
    df = spark.createDataFrame(rows, "o bigint, k string, e string, s bigint").withColumn("t", F.timestamp_seconds("s"))
    got = labels.next_event(df, key="k", offset="o", time="t", starts=F.col("e") == "a", ends=F.col("e") == "b", window="10 minutes", rows_per_bucket=19)
    for r in got.select("o", "k", "s", F.unix_seconds("hit_time").alias("h")).collect():
        later = [s for o, k, e, s in rows if k == r["k"] and o > r["o"] and e == "b"]
        assert r["h"] == (later[0] if later and later[0] - r["s"] <= 600 else None)


def test_as_of_accounts(spark):
    rng = random.Random(6)
    base = DAY0 // 1000
    edits_ = [(i, rng.choice(["A", "A", "B", "C"]), base + rng.randrange(20_000)) for i in range(200)]
    snaps = [(rng.choice(["A", "B"]), base + rng.randrange(20_000), n) for n in range(60)]
    e = spark.createDataFrame(edits_, "offset bigint, user string, s bigint").select("offset", "user", F.lit("registered").alias("user_class"), F.timestamp_seconds("s").alias("dt"))
    s = spark.createDataFrame(snaps, "user string, s bigint, editcount bigint").select("user", F.timestamp_seconds("s").alias("as_of"), F.lit(None).cast("timestamp").alias("registration"), "editcount")
    got = {r["offset"]: r["n"] for r in enrich.attach_accounts_as_of(e, s, slices=5).select("offset", F.unix_seconds("account_as_of").alias("n")).collect()}
    assert len(got) == 200
    for i, user, at in edits_:
        before = [t for u, t, _ in snaps if u == user and t <= at]
        assert got[i] == (max(before) if before and at - max(before) <= 3600 else None)


def test_parse_and_dead_letters(spark):
    events = [edit(DAY0, 1), edit(DAY0, 2, wiki="dewiki"), edit(DAY0, 3, namespace=1), tags(DAY0, 1), "not json"]
    parsed = parse.parse(raw(spark, events))
    assert [r["offset"] for r in parse.edits(parsed).collect()] == [0]
    bad = [
        "not json", edit(DAY0, 1, type=5), {"meta": {"id": "x", "dt": "y", "stream": "other"}}, "null", tags(DAY0, 1, prior_state={"tags": [1]}), edit(DAY0, 1, length={"old": None}),
        edit(DAY0, 1, revision={"old": 1}), edit(DAY0, 1, bot="yes"), {**tags(DAY0, 1), "tags": "x"}, edit(DAY0, 1, log_type=None), edit(DAY0, 1, timestamp=1.5e9), {"meta": 5},
    ]
    got = {r["source_offset"]: r["reason"] for r in parse.dead_letters(parse.parse(raw(spark, bad))).collect()}
    assert got == {
        0: "not JSON", 1: "recentchange schema: type", 2: "unknown stream: other", 3: "unknown stream: undefined", 4: "tags-change schema: prior_state.tags",
        5: "recentchange schema: length.old", 6: "recentchange schema: revision.new", 7: "recentchange schema: bot", 8: "tags-change schema: tags", 11: "unknown stream: undefined",
    }


def test_exactly_once_audit(spark):
    def check(offsets, lo, hi):
        return audit.exactly_once(spark.createDataFrame([(o,) for o in offsets], "offset bigint"), lo, hi).first().asDict()

    assert check(range(10, 20), 10, 20)["ok"]
    assert check([10, 11, 11, 12], 10, 13) == {"handled": 4, "expected": 3, "duplicates": 1, "missing": 0, "first_gap": 12, "ok": False}
    assert check([10, 12], 10, 13)["first_gap"] == 11
    assert check([11, 12], 10, 13)["first_gap"] == 10
    gaps = audit.gap_runs(spark.createDataFrame([(o,) for o in (1, 2, 5, 9)], "offset bigint")).collect()
    assert sorted((g["gap_from"], g["gap_to"]) for g in gaps) == [(3, 4), (6, 8)]


@pytest.mark.parametrize("seed", range(4))
def test_late_hits_equal_the_definition(spark, seed):
    """One page owns most rows; every edit is held against all late deletions of its page."""
    rng = random.Random(seed)
    edits, late, mark = [], [], 0
    for offset in range(300):
        mark += rng.choice([0, 0, 5, 400_000])
        title = "hot" if rng.random() < 0.7 else f"P{rng.randrange(4)}"
        if rng.random() < 0.5:
            edits.append((offset, title, offset, mark + rng.randrange(-10, 4_000_000), rng.randrange(0, 60_000_000)))
        else:
            late.append((offset, title, rng.randrange(0, 60_000_000), mark))
    rules = replace(labels.LIVE, rows_per_bucket=37)
    got = labels.late_hits(
        spark.createDataFrame(edits, "offset bigint, title string, rev_id bigint, closing bigint, ends bigint"),
        spark.createDataFrame(late, "offset bigint, title string, dt bigint, mark bigint"),
        rules,
    )
    want = {r for o, t, r, closing, ends in edits if any(t == u and q > o and dt <= ends and m < closing for q, u, dt, m in late)}
    assert {r.rev_id for r in got.collect()} == want and 0 < len(want) < len(edits)
    assert labels.late_hits(spark.createDataFrame(edits, "offset bigint, title string, rev_id bigint, closing bigint, ends bigint"), spark.createDataFrame([], "offset bigint, title string, dt bigint, mark bigint")).count() == 0
