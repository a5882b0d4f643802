import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from helpers import AWKWARD

from tidemark.llm.word_pointers import Pointers, divergence, sorted_runs, term_counts

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "wiki string, user_class string, diff string, place bigint, slice int, block int, p double, n int, edits int, words int"


def terms_of(text):
    return WORD.findall((text or "").translate(TO_LOWER))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4.0, 5, 6, 7) for r in rows], COLUMNS)


def sample(n=160, seed=1):
    r = random.Random(seed)
    stems = [f"{a}{b}" for a in ("re", "Vert", "été", "straße", "internationalization", "internationalise", "中文", "ſ") for b in ("", "ing", "X" * 9, "é")]
    for i in range(n):
        wiki = r.choice(["en", "en", "de", None])
        yield wiki, r.choice(["bot", "registered", "registered", "temporary", None]), r.choice([" ", ", ", "1", "\n"]).join(r.choices(stems, k=r.randint(0, 12)))
    for t in AWKWARD:
        yield "en", "ip", t
    yield "fr", "bot", "only once"
    yield "fr", "ip", None


def brute(rows, min_edits=3, top=200):
    rows = [tuple(c or "" for c in r) for r in rows]
    edits, of_wiki, of_group = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for wiki, cls, text in rows:
        groups[wiki].add(cls)
        found = terms_of(text)
        edits[wiki].update(set(found))
        of_wiki[wiki].update(found)
        of_group[wiki, cls].update(found)
    out = {}
    for wiki, classes in groups.items():
        kept = [t for t, k in edits[wiki].items() if k >= min_edits]
        v = len(kept)

        def share(counts, v=v, kept=kept):
            size = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (size + v) for t in kept}

        whole = share(of_wiki[wiki])
        shares = {c: share(of_group[wiki, c]) for c in classes}
        for c, p in shares.items():
            pairs = [(o, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)) for o, q in shares.items() if o != c]
            own = [(t, (p[t] - whole[t]) ** 2 // whole[t]) for t in kept if of_group[wiki, c][t] and p[t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", own, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(wiki, c, part, item): (value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("shard_bytes", [1, 300, 10_000_000])
def test_counts_equal_a_plain_count(spark, shard_bytes):
    rows = list(sample())
    want, edits = Counter(), Counter()
    for wiki, cls, text in rows:
        found = Counter(terms_of(text))
        for t, n in found.items():
            want[wiki or "", cls or "", t] += n
            edits[wiki or "", cls or "", t] += 1
    got = {(r.wiki, r.user_class, r.term): (r.n, r.edits) for r in term_counts(frame(spark, rows).repartition(3), shard_bytes=shard_bytes).collect()}
    assert got == {k: (n, edits[k]) for k, n in want.items()}


@pytest.mark.parametrize("small", [0, 3, 4096])
def test_pointers_are_in_the_order_of_their_words(small):
    texts = [t or "" for _, _, t in sample(60, seed=3)] * 3
    p = Pointers(pa.array(texts, pa.string()).slice(2))
    order, new = sorted_runs(p, small)
    found = [p.word(i) for i in order]
    assert sorted(w for t in texts[2:] for w in terms_of(t)) == sorted(found)
    assert [w.encode() for w in found] == sorted(w.encode() for w in found)
    assert [a != b for a, b in zip(["", *found], found, strict=False)] == new.tolist()
    assert len(Pointers(pa.array([], pa.string())).start) == 0


@pytest.mark.parametrize("blocks", [(2048, 128), (3, 2)])
def test_divergence_equals_brute_force(spark, blocks, monkeypatch):
    from tidemark.llm import word_pointers

    monkeypatch.setattr(word_pointers, "BLOCK_WORDS", blocks[0])
    monkeypatch.setattr(word_pointers, "BLOCK_CLASSES", blocks[1])
    rows = list(sample())
    got = {(r.wiki, r.user_class, r.part, r.item): (r.value, r["rank"]) for r in divergence(frame(spark, rows).repartition(3), top=7).collect()}
    assert got == brute(rows, top=7)


def test_wikis_without_kept_words_and_no_rows(spark):
    got = divergence(frame(spark, [("a", "x", "one two"), ("a", "y", None)])).collect()
    assert [(r.user_class, r.part, r.item, r.value, r["rank"]) for r in sorted(got)] == [("x", "pair", "y", 0, 1), ("y", "pair", "x", 0, 1)]
    assert divergence(frame(spark, [])).collect() == []
    assert divergence(frame(spark, [("a", "x", "w")] * 3)).count() == 0
