import hashlib
import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from helpers import AWKWARD, edits, words

from tidemark.llm.exact_runs import DigestMismatch, exact_duplicates, merged_runs


def expected(rows):
    groups = {}
    for rev, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((rev, text or ""))
    out = []
    for bare, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        sha = hashlib.sha256(bare.encode()).hexdigest()
        out += [(rev, keep, len(members), rev == keep, sha) for rev, _ in members]
    return sorted(out, key=str)


def got(df):
    return sorted([(r.rev_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()], key=str)


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_equals_brute_force_whatever_the_rounds(spark, rounds):
    r = random.Random(rounds)
    rows = [(i, words(r.randrange(12), 6, 5).replace(" ", r.choice([" ", "\n", "  "]))) for i in range(300)]
    # A third of all edits share one text; some rows are repeated.
    rows += [(1000 + i, "hot text") for i in range(150)] + rows[:5] + [(2000 + i, t) for i, t in enumerate(AWKWARD)] + [(None, "hot  text"), (None, "no id")]
    assert got(exact_duplicates(edits(spark, rows).repartition(7), rounds)) == expected(rows)


def test_empty_table(spark):
    assert exact_duplicates(edits(spark, [])).collect() == []


def test_most_code_points_win_then_the_smallest_id(spark):
    rows = [(5, "a b"), (3, "ab"), (4, "a b"), (9, "ab  ")]
    assert {r.keep_id for r in exact_duplicates(edits(spark, rows)).collect()} == {9}


def test_a_merge_refuses_texts_that_only_share_a_digest():
    runs = [iter([(b"d", 1, 5, 5, 1, 1)]), iter([(b"d", 2, 5, 5, 2, 1)])]
    with pytest.raises(DigestMismatch):
        list(merged_runs(runs))


def test_multiway_merge_keeps_order_and_counts():
    runs = [iter([(b"a", 1, 1, 3, 7, 1), (b"c", 3, 1, 1, 1, 2)]), iter([(b"a", 1, 1, 3, 4, 5)]), iter([])]
    assert list(merged_runs(runs)) == [(b"a", 1, 1, 3, 4, 6), (b"c", 3, 1, 1, 1, 2)]
