import re
import sys
from dataclasses import replace
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from helpers import AWKWARD
from pyspark.sql import functions as F

from tidemark.llm.blob_ledger import RULES, Ledger, redacted, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def spans(text):
    text = text or ""
    out = [("assign", *m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [s[:3] for s in sorted(out, key=lambda s: (s[1], s[3]))]


TEXTS = [
    *AWKWARD, "password = 'abcdef'", "PassWord:x token: key=abcdefgh", "secret: token: abcdefgh", "é😀 api_key=" + "0123456789abcdef" * 2, "AKIA" + "A" * 15, "AKIA" + "A" * 16 + "x AKIAAKIA" + "0" * 14,
    "token=abcdef token='ghijkl'", "a" * 40 + "token=" + "b" * 30, "ſecret=abcdefg toKen=abcdefg", "tokentoken=abcdef", "=" * 50 + "token==abcdef", "line\ntoken\n=abcdef",
]


def table(spark, texts):
    return spark.createDataFrame([(f"P{i % 3}", i, t, 0, 0) for i, t in enumerate(texts)], "title string, rev_id bigint, diff string, blob int, kind int")


def test_spans_equal_brute_force(spark):
    texts = TEXTS + ["token=hothot"] * 60
    out = secrets(table(spark, texts).repartition(5)).collect()
    assert len(out) == len(texts)
    for r in out:
        assert [tuple(s) for s in r.spans] == spans(texts[r.rev_id]), texts[r.rev_id]


def test_only_unseen_blobs_and_rule_versions_are_scanned(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    secrets(table(spark, TEXTS[:12]), ledger=ledger).collect()
    first = ledger.scanned().count()
    assert first == 3 * len({t or "" for t in TEXTS[:12]})
    secrets(table(spark, TEXTS), ledger=ledger).collect()
    assert ledger.scanned().count() == 3 * len({t or "" for t in TEXTS})
    newer = (*RULES[:2], replace(RULES[2], version=2, pattern="[0-9a-f]{30,}", hint="[0-9a-f]{30}"))
    out = secrets(table(spark, TEXTS), ledger=ledger, rules=newer).collect()
    assert ledger.scanned().count() == 4 * len({t or "" for t in TEXTS})
    assert sum(len([s for s in r.spans if s.kind == "hex"]) for r in out) < sum(len([s for s in spans(t) if s[0] == "hex"]) for t in TEXTS) + 1


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None, "token=abcdef"), (None, None, "token=abcdef"), ("P", 1, None)], "title string, rev_id bigint, diff string")
    out = secrets(df).collect()
    assert sorted(len(r.spans) for r in out) == [0, 1, 1]
    assert secrets(df.limit(0)).collect() == []


def test_masking_joins_what_touches(spark):
    out = secrets(table(spark, TEXTS))
    rows = table(spark, TEXTS).join(out.select("rev_id", "spans"), "rev_id").select("rev_id", redacted(F.col("diff"), F.col("spans"), "#").alias("m")).collect()
    for r in rows:
        text, found = TEXTS[r.rev_id], spans(TEXTS[r.rev_id])
        if text is None:
            assert r.m is None
            continue
        mark = [any(a <= i < b for _, a, b in found) for i in range(len(text))]
        want = "".join("#" if m and (i == 0 or not mark[i - 1]) else "" if m else c for i, (c, m) in enumerate(zip(text, mark)))
        assert r.m == want
