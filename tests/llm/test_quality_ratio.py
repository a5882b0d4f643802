import math
import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from helpers import AWKWARD, edits, words
from pyspark.sql import functions as F

from tidemark.llm import quality_ratio as q

BLANK = r"[^\x20\x09-\x0D]+"


def counts(text):
    text = text or ""
    found = re.findall(BLANK, text)
    windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    marked = {i + k for i in range(len(found) - 7) if windows[tuple(found[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(BLANK, x)]
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked))


def test_base_counts_equal_brute_force(spark):
    texts = [*AWKWARD, words(1, 50, 3), words(2, 200, 2), words(3, 40) + "\n" + words(3, 40), "a b c d e f g h " * 5, "x|y <b>**</b>\n\n a\n a\n  \n#", " ".join("abcdefgh") + " q " + " ".join("abcdefgh")]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = edits(spark, rows).select("rev_id", q.base_counts(F.coalesce("diff", F.lit(""))).alias("b")).collect()
    for r in found:
        assert tuple(r.b) == counts(texts[r.rev_id]), texts[r.rev_id]


def test_scores_equal_the_formula_and_junk_goes(spark):
    clean = [(i, words(i, 60)) for i in range(40)]
    junk = [(100 + i, " ".join(w + "***" for w in words(500 + i, 60).split())) for i in range(10)]
    rows = clean + junk + [(200 + i, t) for i, t in enumerate(AWKWARD)] + clean[:1]
    table = edits(spark, rows)
    trusted = spark.createDataFrame([(i,) for i in range(0, 40, 2)] + [(0,), (None,)], "rev_id bigint")
    out = q.judged(table, trusted).collect()
    assert len(out) == len(rows)
    grams = {}
    for r in table.select("rev_id", q.ngram_buckets(F.coalesce("diff", F.lit(""))).alias("g")).collect():
        grams.setdefault(r.rev_id, []).append(r.g)
    raw = Counter(b for gs in grams.values() for g in gs for b in g)
    # The first edit stands twice in the table, so it counts twice on both sides.
    target = Counter(b for i in range(0, 40, 2) for g in grams[i] for b in g)

    def p(c, b):
        return math.log((c[b] + q.SMOOTHING) / (sum(c.values()) + q.SMOOTHING * q.BUCKETS))

    for r in out:
        g = grams[r.rev_id][0]
        want = sum(p(target, b) - p(raw, b) for b in g) / len(g) if g else 0.0
        assert math.isclose(r.quality.score, want, abs_tol=1e-9)
    kept = {r.rev_id for r in out if r.quality.kept}
    assert kept == set(range(40))
    assert not any(r.quality.kept for r in out if (r.diff or "").strip() == "")


def test_a_frequent_clean_text_stays(spark):
    # A clean text without a label makes up a third of the rows; copies of a trusted and of a junk text are few.
    clean = [(i, words(i, 120)) for i in range(300)]
    junk = [(500 + i, " ".join(w + "***" for w in words(700 + i, 120).split())) for i in range(20)]
    hot = [(1000 + i, "".join(chr(97 + i % 26) + f"q{i} " for i in range(120))) for i in range(180)]
    copies = [(2000 + i, clean[0][1]) for i in range(20)] + [(2100 + i, junk[0][1]) for i in range(20)]
    trusted = spark.createDataFrame([(i,) for i in range(0, 300, 2)], "rev_id bigint")
    out = q.judged(edits(spark, clean + junk + hot + copies), trusted).collect()
    once = {r.rev_id: r.quality.score for r in q.judged(edits(spark, clean + junk + hot[:1]), trusted).collect()}
    kept = {r.rev_id for r in out if r.quality.kept}
    assert kept >= {i for i, _ in clean + hot + copies[:20]}
    # Copies move no score.
    assert all(math.isclose(r.quality.score, once[r.rev_id], abs_tol=1e-9) for r in out if r.rev_id in once)


def test_tokens_set_marks_apart(spark):
    r = spark.sql("select 'Ab,c ***x' as t").select(q.tokens(F.col("t")).alias("w"), F.size(q.ngram_buckets(F.col("t"))).alias("n")).first()
    assert r.w == ["Ab", ",", "c", "***", "x"] and r.n == 5 + 4


def test_empty_tables_and_no_trusted_edit(spark):
    none = spark.createDataFrame([], "rev_id bigint")
    assert q.judged(edits(spark, []), none).collect() == []
    assert len(q.judged(edits(spark, [(1, words(1, 30))]), none).collect()) == 1


def test_sample_is_bounded_and_fixed(spark):
    ids = spark.range(5000).withColumnRenamed("id", "rev_id")
    a, b = (sorted(r.rev_id for r in q.trusted_sample(ids.repartition(n), 500).collect()) for n in (1, 5))
    assert a == b and 400 < len(a) < 600


def test_no_labels_keep_all_that_passes_the_base_rules(spark):
    rows = [(i, words(i, 60)) for i in range(60)] + [(100 + i, " ".join(w + "***" for w in words(500 + i, 60).split())) for i in range(10)] + [(200, "short"), (201, None)]
    none = spark.createDataFrame([], "rev_id bigint")
    out = q.judged(edits(spark, rows), none, prior=q.PRIOR).collect()
    assert all(r.quality.kept == (not r.quality.base_failed) and abs(r.quality.score) < 1e-9 for r in out)
    assert sum(r.quality.kept for r in out) == 70


def test_few_labels_reject_no_more_than_many(spark):
    clean = [(i, words(i, 80)) for i in range(200)]
    junk = [(500 + i, " ".join(w + "***" for w in words(700 + i, 80).split())) for i in range(20)]
    table = edits(spark, clean + junk)
    kept = []
    for step in (1, 20):
        trusted = spark.createDataFrame([(i,) for i in range(0, 200, step)], "rev_id bigint")
        kept.append({r.rev_id for r in q.judged(table, trusted, prior=q.PRIOR).collect() if r.quality.kept})
    assert kept[0] <= kept[1] and set(range(200)) <= kept[0]


def test_a_prior_pulls_the_trusted_side_to_the_raw_one(spark):
    """Counts by plain Python over buckets computed by an own hash table: bucket numbers come from a lookup of single tokens."""
    texts = ["a b a c", "a d", "b b d e", "e"]
    names = {t: spark.sql(f"select pmod(xxhash64('{t}'), {q.BUCKETS}) as b").first().b for t in "abcde"}
    pairs = {(x, y): spark.sql(f"select pmod(xxhash64('{x}', '{y}'), {q.BUCKETS}) as b").first().b for x in "abcde" for y in "abcde"}
    grams = [[names[t] for t in s.split()] + [pairs[p] for p in zip(s.split(), s.split()[1:], strict=False)] for s in texts]
    raw, target = Counter(b for g in grams for b in g), Counter(b for g in grams[:2] for b in g)
    trusted = spark.createDataFrame([(0,), (1,)], "rev_id bigint")
    got = {r.bucket: r.ratio for r in q.ratio_table(edits(spark, list(enumerate(texts))), trusted, prior=50.0).collect()}
    assert got.keys() == raw.keys()
    mass = min(50, q.PRIOR_SHARE * sum(raw.values()))
    for b, ratio in got.items():
        p = (raw[b] + q.SMOOTHING) / (sum(raw.values()) + q.SMOOTHING * q.BUCKETS)
        assert math.isclose(ratio, math.log((target[b] + mass * p) / (sum(target.values()) + mass)) - math.log(p), abs_tol=1e-9)


def test_repeated_rows_without_trust_count_once(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, "d e"), (3, "d e"), (None, "f"), (None, "f")]
    none = spark.createDataFrame([], "rev_id bigint")
    found = q.ratio_table(edits(spark, rows), none)
    assert found.count() == 3 + 2 + 2 + 1 + 1
    once = q.ratio_table(edits(spark, [(1, "a b c"), (3, "d e"), (None, "f")]), none)
    assert {(r.bucket, round(r.ratio, 9)) for r in found.collect()} == {(r.bucket, round(r.ratio, 9)) for r in once.collect()}
