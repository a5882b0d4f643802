import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import change, stats, text, trust
from tidemark.operators import quantiles, scan
from tidemark.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "user, bot, want",
    [("Tidy Machine", True, "bot"), ("198.51.100.23", None, "ip"), ("2001:db8:5::77", None, "ip"), ("2001:DB8:5::7F", False, "ip"), ("~2024-808-3", False, "temporary"), ("~2024-808", None, "temporary"),
     ("Ada of the Marsh", False, "registered"), (None, None, "unknown"), ("", True, "bot"), ("", None, "unknown"), ("cafe", None, "registered"), ("~20245-1", None, "registered")],
)
def test_user_class(spark, user, bot, want):
    assert one(spark, change.user_class(F.lit(user).cast("string"), F.lit(bot).cast("boolean"))) == want


def test_added_tags_keep_order_and_duplicates(spark):
    texts = lambda *x: F.array(*[F.lit(i) for i in x])
    assert one(spark, change.added_tags(texts("mobile edit", "mw-reverted", "mw-undo"), texts("mobile edit"))) == ["mw-reverted", "mw-undo"]
    assert one(spark, change.added_tags(texts("b", "a", "b"), F.lit(None).cast("array<string>"))) == ["b", "a", "b"]


def test_wilson_and_rounding(spark):
    w = one(spark, stats.wilson(F.lit(5), F.lit(10)))
    assert (w["rate"], w["low"], w["high"], w["n"]) == (0.5, 0.2366, 0.7634, 10)
    assert one(spark, stats.wilson(F.lit(0), F.lit(0)))["rate"] is None
    assert one(spark, stats.round_half_up(F.lit(-0.00005))) == 0.0
    assert one(spark, stats.round_half_up(F.lit(0.00005))) == 0.0001
    assert one(spark, stats.f1(F.lit(0), F.lit(3), F.lit(1))) == 0.0


@pytest.mark.parametrize("xs, ys, want", [([1, 2, 3], [2, 4, 6], 1.0), ([1, 2, 3], [3, 2, 1], -1.0), ([1, 2], [1, 2], None), ([1, 2, 3], [5, 5, 5], None)])
def test_pearson(spark, xs, ys, want):
    df = spark.createDataFrame(list(zip(map(float, xs), map(float, ys))), "x double, y double")
    assert df.agg(stats.pearson(F.col("x"), F.col("y")).alias("r")).first()["r"] == want


def test_nearest_rank(spark):
    rows = [("a", float(i)) for i in range(1, 11)] + [("b", float(i)) for i in range(1, 5)] + [("c", None)]
    out = {r["k"]: r for r in quantiles.summarise(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert (out["a"]["p95"], out["a"]["p50"], out["a"]["mean"], out["a"]["max"]) == (10.0, 5.0, 5.5, 10.0)
    assert out["b"]["p50"] == 2.0 and "c" not in out


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_equals_a_plain_window(spark, after, inclusive):
    rng = random.Random(3)
    # One key owns a third of the rows.
    rows = [(i, "hot" if rng.random() < 0.33 else f"k{rng.randrange(20)}", rng.randrange(1000) if rng.random() < 0.7 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "o bigint, k string, v bigint")
    folds = {"mx": ("max", F.col("v")), "mn": ("min", F.col("v")), "sm": ("sum", F.col("v"))}
    for keys in ([], ["k"]):
        got = scan.running(df, keys=keys, bucket=scan.offset_bucket(F.col("o"), 17), order=[F.col("o")], values=folds, after=after, inclusive=inclusive)
        for row in got.collect():
            side = [v for o, k, v in rows if (not keys or k == row["k"]) and v is not None and ((o > row["o"] if after else o < row["o"]) or (inclusive and o == row["o"]))]
            want = (max(side), min(side), sum(side)) if side else (None, None, None)
            assert (row["mx"], row["mn"], row["sm"]) == want


def test_numbered_is_dense_and_ordered(spark):
    rows = [(random.Random(i).random(), i) for i in range(500)]
    out = scan.numbered(spark.createDataFrame(rows, "v double, i bigint").repartition(7), "v", "i", slices=5).collect()
    assert [r["i"] for r in sorted(out, key=lambda r: r["offset"])] == [i for _, i in sorted(rows)]
    assert sorted(r["offset"] for r in out) == list(range(500))


@pytest.mark.parametrize(
    "cls, reg_days, edits, policy, keep",
    [("registered", 4.0, 10, "autoconfirmed", False), ("registered", 3.9, 10, "autoconfirmed", True), ("registered", 30.0, 500, "extendedconfirmed", False),
     ("registered", 29.9, 500, "extendedconfirmed", True), ("registered", 30.0, 499, "extendedconfirmed", True), ("registered", None, 500, "extendedconfirmed", False),
     ("temporary", 300.0, 5000, "extendedconfirmed", True), ("bot", None, 0, "bots", False), ("registered", 99.0, 9999, "bots", True)],
)
def test_trust_filter(spark, cls, reg_days, edits, policy, keep):
    now = 1_760_000_000
    reg = F.lit(None).cast("timestamp") if reg_days is None else F.timestamp_seconds(F.lit(now - reg_days * 86400))
    account = F.struct(reg.alias("registration"), F.lit(edits).cast("bigint").alias("editcount"))
    assert one(spark, trust.decide(F.lit(cls), account, F.lit(now), policy))["keep"] is keep


def test_unknown_account_is_kept(spark):
    account = F.lit(None).cast("struct<registration:timestamp,editcount:bigint>")
    assert one(spark, trust.decide(F.lit("registered"), account, F.lit(1), "autoconfirmed"))["rule"] == "kept"


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'x, "y"'), (2, "line1\nline2"), (3, ""), (4, "  padded ")]
    tables.write_csv(spark.createDataFrame(rows, "i int, s string"), str(tmp_path / "c"))
    back = {r["i"]: r["s"] for r in tables.read_csv(spark, str(tmp_path / "c"), "i int, s string").collect()}
    assert back == {1: 'x, "y"', 2: "line1\nline2", 3: "", 4: "padded"}


def cell(side, body):
    return f'<td class="diff-{side}line diff-side"><div>{body}</div></td>'


def test_diff_text_gives_whole_lines_with_marks_in_place(spark):
    old = 'Rivers rise <del class="diffchange">slowly</del> in &lt;May&gt;, they <del class="diffchange diffchange-inline">fall</del> by June'
    new = 'Rivers rise <ins class="diffchange">at once</ins> in &lt;May&gt;, they <ins class="diffchange">drop</ins> by June'
    html = f"<tr>{cell('deleted', old)}{cell('added', new)}</tr><tr>{cell('added', ' <b>Seven</b> weirs &amp; a lock ')}{cell('added', '  ')}</tr>"
    want = "- Rivers rise [-slowly-] in <May>, they [-fall-] by June\n+ Rivers rise {+at once+} in <May>, they {+drop+} by June\n+ Seven weirs & a lock"
    assert one(spark, text.diff_text(F.lit(html))) == want


def test_diff_text_of_any_length_is_whole(spark):
    spans = "".join(f"{'plain ' * 60}<ins class=\"diffchange\">new{i}</ins>" for i in range(40))
    line = one(spark, text.diff_text(F.lit(cell("added", spans))))
    assert line.count("{+") == 40 and line.count("plain") == 40 * 60 and len(line) > 14_000 and line.endswith("{+new39+}")


@pytest.mark.parametrize(
    "raw, want",
    [('{"p_revert": 0.125, "revert": false, "reason": "sourced"}', (False, 0.125, None)), ('  ```\n{"revert": true, "p_revert": 1}\n``` ', (True, 1.0, None)), ("", (None, None, "not JSON")), ("revert it: 0.7", (None, None, "not JSON")),
     ('{"revert": 1, "p_revert": 0.25}', (None, None, "wrong shape")), ('{"revert": false, "p_revert": -0.01}', (None, None, "wrong shape")), ('{"p_revert": 0.4}', (None, None, "wrong shape")), ('[true, 0.5]', (None, None, "wrong shape")),
     ('{"revert": true, "p_revert": 0.5, "reason": 3}', (None, None, "wrong shape"))],
)
def test_answers(spark, raw, want):
    got = one(spark, text.parse_answer(F.lit(raw)))
    assert (got["revert"], got["p_revert"], got["invalid"]) == want


@pytest.mark.parametrize(
    "columns, wanted",
    [
        (dict(title="Saltmarsh", is_new=False, minor=True, user_class="registered", age=418.9, count=3071, delta=56, comment=" tide tables ", diff="+ ebb", gone=None),
         ["Saltmarsh", "changes the page (said to be minor)", "member for 418 days with 3071 contributions", "+56", "tide tables", "+ ebb"]),
        (dict(title="Weir", is_new=True, minor=False, user_class="temporary", age=None, count=None, delta=0, comment=None, diff="+ Weirs hold water back.", gone=None),
         ["creates the page", "visitor with a temporary name", "<empty>", "whole text:\n+ Weirs hold water back."]),
        (dict(title="Lock", is_new=False, minor=None, user_class="registered", age=None, count=9, delta=-7, comment="", diff="", gone=None), ["member, history unknown", "-7", "<text unchanged>"]),
        (dict(title="Quay", is_new=False, minor=None, user_class="registered", age=0.2, count=1, delta=2, comment="x", diff="", gone="hidden"), ["member for under one day with 1 contributions", "<diff missing>"]),
    ],
)
def test_request_text_has_the_features_and_not_the_label(spark, columns, wanted):
    schema = "title string, is_new boolean, minor boolean, user_class string, account_age_days double, editcount bigint, size_delta bigint, comment string, diff string, diff_unavailable string, label string"
    row = spark.createDataFrame([(*columns.values(), "label-of-the-edit")], schema)
    body = row.select(text.render_edit().alias("t")).first()["t"]
    for part in wanted:
        assert part in body
    assert "label-of-the-edit" not in body


def test_an_unknown_template_field_is_an_error():
    with pytest.raises(ValueError, match="harbour"):
        text.fill("{{harbour}}", {})
