import random

import pytest

from conftest import MINUTE, raw
from test_streaming import landed, steady
from tidemark.catalog import catalog
from tidemark.operators import audit, enrich, labels, parse
from tidemark.sources import log
from tidemark.streaming import jobs as streaming, labelling

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gap_runs_equal_brute_force_and_read_the_offsets_once(spark):
    rng = random.Random(5)
    offsets = [rng.randrange(-50, 400) for _ in range(200)] + [5_000_000, None]
    got = audit.gap_runs(spark.createDataFrame([(o,) for o in offsets], "offset bigint"))
    seen = sorted({o for o in offsets if o is not None})
    assert sorted(map(tuple, got.collect())) == [(a + 1, b - 1) for a, b in zip(seen, seen[1:]) if b - a > 1]
    assert "LeftAnti" not in plan(got)


def test_diffs_of_other_edits_are_cut_before_they_become_text(spark):
    cell = '<td class="diff-addedline"><div>note {}</div></td>'
    edits = spark.createDataFrame([(1,), (2,), (3,), (4,)], "rev_id bigint")
    diffs = spark.createDataFrame([(1, cell.format(1), None), (2, None, "suppressed"), (3, None, None), (9, cell.format(9), None)], "rev_id bigint, html string, reason string")
    got = enrich.with_diffs(edits, diffs)
    assert sorted(map(tuple, got.collect())) == [(1, "+ note 1", None), (2, "", "suppressed"), (3, "", None), (4, "", "not fetched")]
    text = plan(got)
    assert "LeftSemi" in text and text.index("regexp_extract_all") < text.index("Join LeftOuter") and "regexp_extract_all" not in text[text.index("Join LeftOuter"):]


@pytest.mark.parametrize("name", ["sampled_rows_in_tables", "live_trade_off", "label_confusion", "label_disagreement_causes", "label_agreement", "missing_offset_runs", "evaluation_set"])
def test_payloads_are_not_parsed_again_for_each_branch(spark, name):
    assert "from_json" not in plan(catalog()[name][0](spark, SMALL))


def test_labels_of_all_edits_are_never_broadcast(spark):
    text = plan(catalog()["evaluation_set"][0](spark, SMALL))
    assert "strategy=merge" in text


def test_a_run_of_streamed_labels_or_tags_is_one_file_a_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(labelling, "RUN_BITS", 5)
    monkeypatch.setattr(parse, "first_by_key", lambda df, key, order, one=parse.first_by_key: one(df, key, order).repartition(4))
    rules = labels.LabelRules(window_ms=20 * MINUTE, grace_ms=MINUTE, outage_gap_ms=20 * MINUTE)
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events = raw(spark, list(steady(240, seed=1)))
    landed(spark, src, events, 120)
    streaming.label_stream(log.stream_files(spark, src, log.RAW_SCHEMA), out, state, rules).awaitTermination()
    runs = [d for part in ("labels", "reverts") for d in (tmp_path / "out" / part).rglob("*") if d.is_dir() and list(d.glob("*.parquet"))]
    assert len(runs) > 4 and all(len(list(d.glob("*.parquet"))) == 1 for d in runs)
    got = sorted(map(tuple, streaming.read_labels(spark, out).select("source_offset", "label").collect()))
    assert got == sorted(map(tuple, labels.label_log(parse.parse(events), rules).select("source_offset", "label").collect())) and got
