import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from helpers import AWKWARD, edits, words

from tidemark.llm import near_forest
from tidemark.llm.components import components
from tidemark.llm.near_forest import near_duplicates


def shingles(text):
    lower = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def expected(rows):
    ids = [r[0] for r in rows]
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return sorted([(ids[i], len(sets[i]), least.get(root(i)), ids[i] is not None and ids[i] == least.get(root(i))) for i in range(len(rows))], key=str)


def got(df):
    return sorted([(r.rev_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()], key=str)


def varied(base, seed, changes):
    r, w = random.Random(seed), base.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rows, n = [], 0
    for g in range(8):
        base = words(g, 120)
        for k in range(12):
            rows.append((n, varied(base, n, k % 7)))
            n += 1
    # A chain whose ends are unlike each other, and a hot text.
    chain = words(99, 200).split()
    for k in range(10):
        rows.append((n, " ".join(chain[8 * k : 8 * k + 110])))
        n += 1
    rows += [(n + i, "Hot TEXT of seven words stands here") for i in range(60)]
    rows += [(n + 100 + i, t) for i, t in enumerate(AWKWARD)] + [(n + 200, "TWO words"), (n + 201, "two\twords"), (n + 202, "words two")]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    assert got(near_duplicates(edits(spark, rows).repartition(5))) == expected(rows)


@pytest.mark.parametrize("crowded", [0, 3])
def test_crowded_regions_are_read_deeper(spark, crowded, monkeypatch):
    # Workers get the module's functions by value, with the number set here.
    monkeypatch.setattr(near_forest, "CROWDED", crowded)
    rows = [(i, varied(words(1, 150), i, 4)) for i in range(40)]
    assert got(near_duplicates(edits(spark, rows))) == expected(rows)


def test_isolated_pairs_in_a_crowded_template_family(spark, monkeypatch):
    # Of 200 shingles 170 are the template's: 0.739 among all, 0.762 for a pair, and every tree's region is crowded.
    monkeypatch.setattr(near_forest, "CROWDED", 400)
    template = " ".join(f"t{i}" for i in range(174))
    rows = []
    for k in range(240):
        own = [f"p{k // 2}x{i}" for i in range(3)] + [f"o{k}x{i}" for i in range(27)]
        rows.append((k, f"{template} {' '.join(own)}"))
    want = expected(rows)
    assert len({c for _, _, c, _ in want}) == 120
    assert got(near_duplicates(edits(spark, rows))) == want


def asked_pairs(found):
    """(asks, asked) of every cell, from (cell, node, role)."""
    held = {}
    for cell, node, role in found:
        held.setdefault(cell, []).append((node, role))
    pairs = [(a, b) for rows in held.values() for a, r in rows if r & near_forest.ASKS for b, t in rows if t & near_forest.ASKED]
    return pairs, max(map(len, held.values()))


@pytest.mark.parametrize("outside", [3, 150])
def test_no_cell_holds_a_hot_region(spark, outside, monkeypatch):
    monkeypatch.setattr(near_forest, "CROWDED", 400)
    rows = [(7, 0, i, 0 if i < 1000 else i) for i in range(1000 + outside)]
    found = near_forest.cells(spark.createDataFrame(rows, "region bigint, tree int, node bigint, component bigint")).collect()
    pairs, largest = asked_pairs([(r.tile, r.node, r.role) for r in found])
    assert len(pairs) == len(set(pairs)) == outside * (1000 + outside)
    assert largest < 100


def test_full_sets_meet_in_bounded_parts():
    roles = [near_forest.ASKED] * 300 + [near_forest.ASKED | near_forest.ASKS | near_forest.OUTSIDE] * 40 + [near_forest.ASKS | near_forest.OUTSIDE] * 30
    found = list(near_forest.parts(roles, [10] * len(roles), 200))
    pairs, largest = asked_pairs([(part, k, role) for k, part, role in found])
    assert len(pairs) == len(set(pairs)) == 70 * 340
    assert largest <= 40
    assert list(near_forest.parts([], [], 200)) == [] and [x[1] for x in near_forest.parts([2, 7], [10**9, 10**9], 200)] != [0, 0]


def test_repeats_missing_ids_and_empty_tables(spark):
    rows = [(2, words(1, 50)), (2, words(1, 50)), (None, words(1, 50)), (None, words(2, 50)), (1, words(1, 50) + " x")]
    assert got(near_duplicates(edits(spark, rows))) == expected(rows)
    assert near_duplicates(edits(spark, [])).collect() == []
    assert got(near_duplicates(edits(spark, [(1, None), (2, "")]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    random.Random(3).shuffle(chain)
    star = [(500, 500 + i) for i in range(1, 80)]
    links = spark.createDataFrame(chain + star + [(7, 7), (8, 9), (9, 8), (10, 8)], "a bigint, b bigint")
    found = {r.node: r.component for r in components(links).collect()}
    assert {found[i] for i in range(100, 161)} == {100} and {found[500 + i] for i in range(80)} == {500}
    assert found[8] == found[9] == found[10] == 8 and 7 not in found
    assert components(links.limit(0)).collect() == []
