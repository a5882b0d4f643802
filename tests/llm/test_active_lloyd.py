import math

import numpy as np
import pytest

from tidemark.llm.active_lloyd import LIMIT, compressed, nearest, reassigned, squared

COLUMNS = "vec_id bigint, vector array<float>, label int, x int, code string, distance int, error int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2, 3) for r in rows], COLUMNS)


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    ints = [[math.floor(1024 * float(np.float32(c))) for c in r[1]] for r in kept]
    width = len(ints[0]) // parts
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, ints[i]))[:entries]
    books = [[ints[i][p * width : (p + 1) * width] for i in order] for p in range(parts)]

    def assign():
        out = []
        for x in ints:
            best = []
            for p in range(parts):
                own = x[p * width : (p + 1) * width]
                best.append(min((sum((a - b) ** 2 for a, b in zip(own, e, strict=True)), j) for j, e in enumerate(books[p])))
            out.append(best)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [x[p * width : (p + 1) * width] for x, f in zip(ints, found, strict=True) if f[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    codes = sorted(((r[0], "".join(f"{j:02x}" for _, j in f), e, by_label[r[2]]) for r, f, e in zip(kept, found, errors, strict=True)), key=str)
    return codes, books


def rows_with_ties(n=90, width=8, seed=2):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(c) for c in np.round(r.normal(0, 1, width) * 2) / 1024], int(i % 3)) for i in r.permutation(n)]
    rows += [rows[0], rows[0], (None, rows[5][1], None), (n + 5, [0.0] * width, None)]
    return [*rows, (n + 1, None, 1), (n + 2, [None] * width, 1), (n + 3, [math.nan] * width, 1), (n + 4, [math.inf] + [0.0] * (width - 1), 1)]


@pytest.mark.parametrize("entries", [1, 7, 256])
def test_equals_plain_lloyd_rounds(spark, entries):
    rows = rows_with_ties()
    found = compressed(frame(spark, rows).repartition(3), entries=entries)
    codes, books = brute(rows, entries=entries)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found.codes.collect()), key=str) == codes
    assert found.codebooks.entries.tolist() == books


def test_active_entries_equal_a_whole_scan():
    r = np.random.default_rng(4)
    for _ in range(200):
        x, old = r.integers(-3, 4, (40, 3)), r.integers(-3, 4, (9, 3))
        code, distance = nearest(x, old)
        moved = r.random(9) < r.choice([0.0, 0.2, 0.8, 1.0])
        new = np.where(moved[:, None], r.integers(-3, 4, (9, 3)), old)
        got = reassigned(x, code, distance, new, moved)
        want = nearest(x, new)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_distances_are_exact_for_large_components():
    x = np.array([[LIMIT - 1, -LIMIT + 1], [5, 7]])
    e = np.array([[-LIMIT, LIMIT], [5, 8]])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in e] for p in x]
    assert squared(x, e).tolist() == want


def test_no_vectors_and_wrong_shapes(spark):
    for rows in ([], [(1, None, 1)], [(1, [math.nan], 2)]):
        found = compressed(frame(spark, rows))
        assert found.codebooks is None and found.codes.collect() == []
    empty = compressed(frame(spark, [(1, [], 1), (2, [], None)]))
    assert [(r.code, r.error) for r in empty.codes.collect()] == [("00000000", 0)] * 2
    for rows in ([(1, [1.0] * 6, 1)], [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)]):
        with pytest.raises(ValueError, match="components"):
            compressed(frame(spark, rows))
    with pytest.raises(Exception, match="beyond the limit"):
        compressed(frame(spark, [(1, [1e30] * 4, 1)]))
