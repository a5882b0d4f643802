import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from helpers import AWKWARD, edits, words

from tidemark.llm.deep_shallow import blind_order, common_prefix, deep_shallow_order
from tidemark.llm.suffix_repeats import repeated_stretches


def expected(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (rev, _), t in zip(rows, texts, strict=True):
        runs = []
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        gone = {x for a, b in runs for x in range(a, b)}
        kept = bytes(c for i, c in enumerate(t) if i not in gone)
        out.append((rev, len(t), tuple(map(tuple, runs)), kept))
    return sorted(out, key=str)


def got(df, texts):
    return sorted([(r.rev_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept) if r.kept is not None else texts[r.rev_id]) for r in df.collect()], key=str)


def corpus():
    passage = words(7, 60)
    rows = [(i, words(i, 40) + " " + (passage if i % 3 else passage[20:250]) + " " + words(1000 + i, 30)) for i in range(40)]
    rows += [(100 + i, words(3, 90) if i < 5 else words(3, 90)[i:]) for i in range(9)]
    rows += [(200 + i, t) for i, t in enumerate(AWKWARD)]
    rows += [(300, "ab" * 300), (301, "And " * 120 + words(5, 50)), (302, "é" * 99 + "x"), (303, "é" * 100), (304, "z" * 199), (305, words(8, 30) * 3), (306, "aé" * 90 + words(2, 60))]
    return rows


@pytest.mark.parametrize("length,gram,crowd", [(200, 50, 5000), (200, 50, 3), (64, 16, 2)])
def test_equals_brute_force(spark, length, gram, crowd):
    rows = corpus()
    texts = {i: (t or "").encode() for i, t in rows}
    found = repeated_stretches(edits(spark, rows).repartition(4), length=length, gram=gram, crowd=crowd)
    assert got(found, texts) == expected(rows, length)


def test_repeats_missing_ids_and_empty_tables(spark):
    text, short = words(1, 80), "short"
    rows = [(1, text), (1, text), (None, text), (None, short), (None, short), (2, None)]
    found = repeated_stretches(edits(spark, rows)).collect()
    assert sorted((r.rev_id is None, r.n_bytes, len(r.spans)) for r in found) == sorted([(False, len(text), 1)] * 2 + [(True, len(text), 1)] + [(True, 5, 0)] * 2 + [(False, 0, 0)])
    assert repeated_stretches(edits(spark, [])).collect() == []


@pytest.mark.parametrize("shallow", [0, 8, 64])
def test_sorting_equals_sorted(shallow):
    r = random.Random(shallow)
    strings = [bytes(r.choices(b"ab", k=r.randint(0, 30))) for _ in range(500)] + [b"a" * n for n in range(100)] + [b"", b"", b"\x00", b"\xff" * 70]
    order = deep_shallow_order(strings, shallow)
    assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)
    assert [strings[i] for i in blind_order(strings, list(range(len(strings))))] == sorted(strings)
    assert common_prefix(b"abc", b"abd") == 2 and common_prefix(b"", b"x") == 0 and common_prefix(b"ab", b"abc") == 2
