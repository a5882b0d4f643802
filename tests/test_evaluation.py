import itertools
import random
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import DAY0, HOUR, MINUTE, edit, raw, tags, tick
import bench
from tidemark.catalog import catalog
from tidemark.functions import stats
from tidemark.operators import audit, calibration, drift, labels, ladder, load, parse, sampling, scoring
from tidemark.plans import jobs
from tidemark.sources import log, tables
from tidemark.streaming import jobs as streaming

RUN = "set string, config string, rev_id bigint, revert boolean, p_revert double, latency_ms double, tokens_in bigint, tokens_out bigint, model_version string, at timestamp"


def runs(spark, rows, config="m__p1", set_="dev"):
    full = [(set_, config, i, r, p, float(ms), ti, to, "m@1") for i, r, p, ms, ti, to in rows]
    return spark.createDataFrame(full, RUN.replace(", at timestamp", "")).withColumn("at", F.timestamp_seconds(F.lit(0)))


def edits(spark, labels_, set_="dev"):
    return spark.createDataFrame([(set_, i, x, "temporary" if i % 2 else "registered") for i, x in labels_], "set string, rev_id bigint, label string, user_class string")


def test_score_grid(spark):
    e = edits(spark, [(1, "reverted"), (2, "reverted"), (3, "reverted"), (4, "not-reverted"), (5, "not-reverted"), (6, "deleted")])
    r = runs(spark, [(1, True, 0.9, 10, 100, 10), (2, False, 0.1, 20, 100, 10), (3, None, None, 30, None, None), (4, True, 0.8, 40, 100, 10), (5, False, 0.2, 50, 100, 10), (6, True, 0.9, 60, 100, 10)])
    g = scoring.grid(e, r).first()
    assert (g["precision_rate"], g["recall_rate"], g["invalid"], g["complete"], g["tokens_in"], g["tokens_out"]) == (0.5, 0.3333, 0.1667, True, 100, 10)
    assert (g["latency_p50"], g["latency_p95"], g["tp"], g["fp"], g["fn"]) == (30.0, 60.0, 1, 1, 2)
    assert not scoring.grid(e, r.where("rev_id <> 4")).first()["complete"]
    assert [x["rev_id"] for x in scoring.unanswered(e, r.where("rev_id < 5")).orderBy("rev_id").collect()] == [5, 6]


@pytest.mark.parametrize("items, want", [([(0.1, False), (0.9, True)], 1.0), ([(0.9, False), (0.1, True)], 0.0), ([(0.5, False), (0.5, True)], 0.5), ([(0.2, True)], None)])
def test_auroc(spark, items, want):
    hist = spark.createDataFrame([("a", p, 1, int(y)) for p, y in items], "k string, p double, n bigint, pos bigint").groupBy("k", "p").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    assert calibration.brier_and_auroc(hist, ["k"]).first()["auroc"] == want


def test_auroc_of_random_scores(spark):
    rng = random.Random(4)
    rows = [("a" if rng.random() < 0.7 else "b", rng.random() if rng.random() < 0.8 else 0.5, rng.random() < 0.3) for _ in range(800)]
    hist = spark.createDataFrame(rows, "k string, p double, y boolean").groupBy("k", "p").agg(F.count("*").alias("n"), F.count_if("y").alias("pos"))
    for r in calibration.brier_and_auroc(hist, ["k"]).collect():
        pos, neg = ([p for k, p, y in rows if k == r["k"] and y == want] for want in (True, False))
        pairs = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert r["auroc"] == pytest.approx(pairs, abs=6e-5)


def test_reliability(spark):
    hist = spark.createDataFrame([(1, 0.9, 4, 1)], "k int, p double, n bigint, pos bigint")
    assert calibration.ece(calibration.reliability(hist, ["k"]), ["k"]).first()["ece"] == 0.65
    edges = spark.createDataFrame([(b / 10,) for b in range(11)] + [(0.9 - 1e-16,)], "p double").select("p", calibration.bucket_of(F.col("p")).alias("b")).collect()
    assert {r["p"]: r["b"] for r in edges} == {**{b / 10: b for b in range(10)}, 1.0: 9, 0.9 - 1e-16: 8 if 0.9 - 1e-16 < 0.9 else 9}


def ladder_inputs(spark, n, seed, digits=2):
    """Seeded answers of a quick scorer and a careful one; latencies and tokens differ by edit."""
    prices = spark.createDataFrame([("cloud", 2.0, 8.0), ("m", 0.0, 0.0)], "model string, input double, output double")
    rng = random.Random(seed)
    truth = [rng.random() < 0.3 for _ in range(n)]
    ps = [None if rng.random() < 0.05 else round(rng.random(), digits) for _ in range(n)]
    local = [(None if p is None else p >= 0.5, p, 20 + i % 7) for i, p in enumerate(ps)]
    cloud = [((t if rng.random() < 0.8 else not t), 0.5, 300 + 10 * (i % 11)) for i, t in enumerate(truth)]
    e = edits(spark, [(i, "reverted" if t else "not-reverted") for i, t in enumerate(truth)])
    loc = runs(spark, [(i, r, p, ms, 5, 5) for i, (r, p, ms) in enumerate(local)])
    clo = ladder.with_cost(runs(spark, [(i, r, p, ms, 700 + i, 60) for i, (r, p, ms) in enumerate(cloud)], "cloud__p1"), prices)
    return truth, local, cloud, ladder.paired(e, loc, clo)


def test_ladder_policies_equal_a_plain_count(spark):
    truth, local, cloud, pairs = ladder_inputs(spark, 90, 11)
    lo, hi = 0.35, 0.8
    rows = {r["policy"]: r for r in ladder.compare_policies(pairs, lo, hi).collect()}
    unsure = [p is None or lo <= p < hi for _, p, _ in local]
    flagged = {
        "heuristics only": [True] * 90,
        "local only": [bool(r) for r, _, _ in local],
        "cloud only": [c for c, _, _ in cloud],
        "ladder": [bool(c if u else r) for (r, _, _), (c, _, _), u in zip(local, cloud, unsure)],
    }
    price = [((700 + i) * 2 + 60 * 8) / 1e6 for i in range(90)]
    for policy, flags in flagged.items():
        tp = sum(f and t for f, t in zip(flags, truth))
        assert rows[policy]["recall_rate"] == pytest.approx(tp / sum(truth), abs=1e-4)
        assert rows[policy]["precision_rate"] == pytest.approx(tp / sum(flags), abs=1e-4)
    r = rows["ladder"]
    assert r["escalated"] == pytest.approx(sum(unsure) / 90, abs=1e-4)
    assert r["cost_per_model_edit"] == pytest.approx(sum(c for c, u in zip(price, unsure) if u) / 90)
    waits = sorted(l[2] + (c[2] if u else 0) for l, c, u in zip(local, cloud, unsure))
    assert (r["latency_p50"], r["latency_p95"]) == (waits[44], waits[85])
    assert spark.range(1).select(ladder.per_thousand(F.lit(0.0015), 0.4)).first()[0] == pytest.approx(0.6)


def test_missing_answer_or_price_fails(spark):
    e = edits(spark, [(1, "reverted")])
    r = runs(spark, [(2, True, 0.9, 1, 1, 1)])
    with pytest.raises(Exception, match="no answer for revision 1"):
        ladder.paired(e, r, r.withColumn("cost", F.lit(0.0))).collect()
    # The check holds through readers that never look at the revision.
    some = edits(spark, [(1, "reverted"), (2, "reverted"), (3, "not-reverted")])
    two = runs(spark, [(i, True, 0.9, 1, 1, 1) for i in (1, 2)])
    pairs = ladder.paired(some, two, two.withColumn("cost", F.lit(0.0)))
    for use in (lambda: ladder.compare_policies(pairs, 0.3, 0.7).collect(), lambda: ladder.choose_band(pairs).collect(), lambda: pairs.count()):
        with pytest.raises(Exception, match="no answer for revision 3"):
            use()
    with pytest.raises(Exception, match="no price for m"):
        ladder.with_cost(r, spark.createDataFrame([("x", 1.0, 1.0)], "model string, input double, output double")).collect()


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("fan", [32, 2, 5])
def test_band_search_equals_all_pairs(spark, seed, fan):
    truth, local, cloud, pairs = ladder_inputs(spark, 150, seed)
    r4 = lambda x: int(x * 10000 + 0.5) / 10000
    edges = sorted({0.0, 1.000001, *[p for _, p, _ in local if p is not None]})
    pos = sum(truth)
    cloud_recall = r4(sum(t and bool(c[0]) for t, c in zip(truth, cloud)) / pos)
    best = None
    for lo, hi in itertools.combinations(edges, 2):
        flags, esc = [], 0
        for (lr, p, _), (cr, _, _) in zip(local, cloud):
            unsure = p is None or lo <= p < hi
            esc += unsure
            flags.append(bool(cr if unsure else lr))
        tp = sum(f and t for f, t in zip(flags, truth))
        fp = sum(f and not t for f, t in zip(flags, truth))
        if r4(tp / pos) < 0.95 * cloud_recall:
            continue
        score = r4(2 * tp / (2 * tp + fp + pos - tp)) if tp else 0.0
        key = (r4(esc / len(truth)), -score, lo, hi)
        best = key if best is None else min(best, key)
    got = ladder.choose_band(pairs, fan=fan).first()
    assert (got["escalated"], -got["f1"], got["lo"], got["hi"]) == best


def test_drift(spark):
    base = runs(spark, [(i, i % 2 == 0, 0.5, 1, 1, 1) for i in range(10)])
    flipped = base.withColumn("revert", F.when(F.col("rev_id") < 2, ~F.col("revert")).otherwise(F.col("revert")))
    check = drift.compare(base, flipped).first()
    assert check["agreement"] == 0.8 and check["alerts"] == ["2/10 answers turned: 80.0% same, wanted 90%"]
    assert drift.compare(base, base).first()["alerts"] == []
    renamed = drift.compare(base, base.withColumn("model_version", F.lit("m@2"))).first()
    assert renamed["alerts"] == ["scorer was m@1, is m@2"]
    invalid = base.withColumn("revert", F.when(F.col("rev_id") != 1, F.col("revert")))
    assert any("unusable answers: 10.0%, earlier 0.0%" in a for a in drift.compare(base, invalid).first()["alerts"])
    assert any("nothing to hold against: 1 reruns" in a for a in drift.compare(base.where("rev_id > 0"), base).first()["alerts"])
    assert drift.flips(base, flipped).count() == 2


def test_sampling_ignores_order_and_partitions(spark):
    df = spark.range(400).select("id", (F.col("id") % 10 == 0).alias("pos"))
    one = sampling.sample(df, "id", 30, 1).select("id").collect()
    assert sorted(one) == sorted(sampling.sample(df.orderBy(F.desc("id")).repartition(9), "id", 30, 1).select("id").collect())
    strata = sampling.stratified(df, ["pos"], "id", 20, 1).groupBy("pos").count().collect()
    assert {r["pos"]: r["count"] for r in strata} == {True: 20, False: 20}
    assert sampling.stratified(df, ["pos"], "id", 100, 1).where("pos").count() == 40


def test_label_noise(spark):
    rows = [(True, "y")] * 6 + [(True, "n")] * 4 + [(False, "y")] + [(False, "n")] * 9 + [(True, "u")]
    r = audit.label_noise(spark.createDataFrame(rows, "reverted boolean, vandalism string"), 0.1).first()
    assert (r["reverted_not_vandalism_rate"], r["kept_but_vandalism_rate"], r["population_agreement"], r["unsure"]) == (0.4, 0.1, 0.87, 1)


def test_rates_and_windows(spark):
    base = DAY0 // 1000 // 3600 * 3600
    def samples(rows):
        return spark.createDataFrame([(base + m * 60, r, s) for m, s, r in rows], "s bigint, replicas bigint, scored bigint").select(F.timestamp_seconds("s").alias("t"), "replicas", F.lit(0).cast("bigint").alias("classifier_lag"), "scored")

    feed = [r["feed"] for r in load.rates(samples([(0, 100, 1), (1, 160, 1), (2, 230, 1), (30, 2000, 1), (31, 2050, 1)])).orderBy("t").collect()]
    assert feed == [60.0, 70.0, 50.0]
    many = samples([(m, m * 10 if m <= 30 else 300 + (m - 30) * 50, 1 if m < 30 else 5) for m in range(61)])
    wins = load.windows(load.rates(many), 30).orderBy("start").collect()
    assert len(wins) == 2 and wins[1]["replicas"] == 5.0
    assert load.windows(load.rates(samples([(m, m, 1) for m in range(11)])), 30).count() == 0


def test_trailing_kept_rate(spark):
    base = DAY0 // 60_000 * 60
    minutes = spark.createDataFrame([(base + 37 * 60 + 20,)], "s bigint").select(F.timestamp_seconds("s").alias("t"))
    per = spark.createDataFrame([(base + m * 60, 10 if m < 35 else 20) for m in range(30, 40)], "t bigint, kept bigint")
    assert load.attach_kept(minutes, per).first()["kept"] == 14.0
    msgs = [(DAY0, '{"filter":{"keep":true}}'), (DAY0, '{"filter":{"keep":false}}'), (DAY0 + 60_000, '{"filter":{"keep":true}}'), (DAY0, "{bad"), (DAY0, "{}")]
    df = spark.createDataFrame(msgs, "ms bigint, value string").select(F.timestamp_millis("ms").alias("arrived"), "value")
    assert sorted((r["all"], r["kept"]) for r in load.kept_per_minute(df).collect()) == [(1, 1), (2, 1)]


def test_freeze_and_thaw(spark, tmp_path):
    path = str(tmp_path / "set")
    tables.freeze(spark.range(20), path)
    assert tables.thaw(spark, path).count() == 20
    spark.range(1).write.mode("append").parquet(f"{path}/data")
    with pytest.raises(ValueError, match="manifest"):
        tables.thaw(spark, path)


def test_resume_and_sealed_sets(spark):
    class Echo:
        config = "echo__p1"

        def open(self):
            return lambda b: pd.DataFrame({"rev_id": b.rev_id, "raw": '{"revert": true, "p_revert": 1}', "latency_ms": 1.0, "tokens_in": 1, "tokens_out": 1, "model_version": "e"})

    e = edits(spark, [(i, "reverted") for i in range(5)])
    request = F.struct(F.lit("s").alias("system"), F.lit("u").alias("user"))
    done = runs(spark, [(i, True, 1.0, 1, 1, 1) for i in range(3)], Echo.config)
    assert sorted(r["rev_id"] for r in jobs.resume(e, done, Echo(), request).collect()) == [3, 4]
    sealed = e.withColumn("set", F.lit("sealed"))
    full = runs(spark, [(i, True, 1.0, 1, 1, 1) for i in range(5)], Echo.config, "sealed")
    with pytest.raises(ValueError, match="already scored"):
        jobs.resume(sealed, full, Echo(), request)


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_labels_equal_batch_over_restarts(spark, tmp_path, seed):
    rng = random.Random(seed)
    rules = replace(labels.LIVE, window_ms=2 * HOUR, outage_gap_ms=20 * MINUTE)
    events, now = [], DAY0
    for i in range(160):
        now += rng.choice([30_000, 300_000, 900_000, 1_500_000 if rng.random() < 0.2 else 0])
        at = now - rng.choice([0, 0, 60_000, 1_800_000 if rng.random() < 0.3 else 0])
        kind, title = rng.random(), f"P{rng.randrange(6)}"
        if kind < 0.5:
            events.append(edit(at, i if rng.random() < 0.9 else max(0, i - 40), title=title))
        elif kind < 0.75:
            events.append(tags(at, rng.randrange(max(1, i - 12), i + 1)))
        elif kind < 0.85:
            events.append(edit(at, 0, type="log", log_type="delete", log_action="delete", title=title, revision={"new": 0}))
        else:
            events.append(tick(at))
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    log_df = raw(spark, events)
    for lo in range(0, 160, 40):
        log_df.where(F.col("offset").between(lo, lo + 39)).coalesce(1).write.mode("append").json(src)
        streaming.label_stream(log.stream_files(spark, src, log.RAW_SCHEMA), out, state, rules).awaitTermination()
    got = sorted(map(tuple, streaming.read_labels(spark, out).select("source_offset", "rev_id", "label", "reverted_at").collect()))
    want = sorted(map(tuple, labels.label_log(parse.parse(log_df), rules).select("source_offset", "rev_id", "label", "reverted_at").collect()))
    assert got == want and len({r[2] for r in want}) >= 3


def test_catalog_is_consistent():
    entries = catalog()
    assert len(entries) > 120 and "filter_trade_off" in entries
    assert all(callable(fn) for fn, _ in entries.values())


def single_task_windows(plan):
    """Windows fed by one task, but for those over one row per bucket of a running value."""
    lines = [x.strip(" +-:*()0123456789") for x in plan.split("\n")]
    found = []
    for i, line in enumerate(lines):
        if line.startswith(("Window", "WindowGroupLimit")) and any("Exchange SinglePartition" in x for x in lines[i + 1 : i + 4]) and "__bucket" not in line:
            found.append(line[:200])
    return found


@pytest.mark.parametrize("name", [n for n in bench.HEADLINE if not n.startswith("stream_")] + ["feed_per_minute", "recording_gaps", "trailing_kept_rate", "trailing_15_point_mean", "load_report", "routing_headline"])
def test_plans_have_no_cross_joins_or_single_task_windows(spark, name):
    fn, _ = catalog()[name]
    plan = fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert single_task_windows(plan) == []


def test_scores_are_appended_once_and_whole(spark, tmp_path):
    path, long_raw = str(tmp_path / "runs"), '{"revert": true, "p_revert": 0.75, "reason": "' + "r" * 9000 + '"}'
    e = edits(spark, [(i, "reverted") for i in range(6)])
    given = spark.createDataFrame([(i, long_raw, 1.0, 1, 1, "v") for i in range(5)], jobs.ANSWER_SCHEMA)
    score = lambda todo: jobs.score_from(todo, given, "m__p1")
    jobs.score_into(e.where("rev_id < 3"), path, "m__p1", score)
    done = jobs.score_into(e, path, "m__p1", score)
    assert sorted((r["rev_id"], r["revert"], r["raw"] == long_raw) for r in done.collect()) == [(i, True, True) for i in range(5)]
    # The edit without an answer is asked for again, the others are not.
    assert jobs.score_into(e, path, "m__p1", score).count() == 5


def test_share_of_nothing_is_null(spark):
    assert spark.range(1).select(stats.share(F.lit(1), F.lit(0))).first()[0] is None
