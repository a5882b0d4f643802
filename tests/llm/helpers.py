"""Small edits for the operators of tidemark.llm, with columns that clash with their inner names."""

from __future__ import annotations

import random

CLASHING = ("digest", "salt", "node", "component", "keep_id", "k1", "gram", "spans", "blob", "quality", "ids", "shard", "rule", "offset2")


def edits(spark, rows, *extra):
    """(rev_id, diff) rows as a table; every clashing column holds a number."""
    names = [c for c in CLASHING if c not in extra]
    schema = "rev_id bigint, diff string" + "".join(f", {n} int" for n in names)
    data = [(r[0], r[1], *range(len(names))) for r in rows]
    return spark.createDataFrame(data, schema)


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


#: Texts every operator must take: none, empty, blanks, marks of other alphabets, long, controls.
AWKWARD = [None, "", " \t\n\x0b\x0c\r ", "é😀中文 ſtraße", "a", "x" * 30_000, "one two three four five six seven", "\x00\x1c\x85", "line\nline\nline\n"]
