"""Token ids by stretches between spaces, each encoded once per worker and kept while room lasts.

A vocabulary that cuts a text before a space that follows something else gives such
stretches the same ids alone and in their text. Ids are kept as little-endian unsigned
32-bit integers, so a text's ids are one join of bytes.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

#: Entries of a generation; two are kept, and an entry takes some 200 bytes.
ENTRIES = 600_000
#: A space whose left neighbour is no white space of any definition starts a stretch.
_CUT = re.compile(r"(?<=\S)(?= )")
#: Two characters of white space of any kind, the second a space.
_ODD = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]


def of_worker(key: tuple, make: Callable):
    """What ``make`` gives, once for each Python worker: a worker outlives its tasks, their functions do not."""
    home = sys.__dict__.setdefault("_tidemark_of_worker", {})
    if key not in home:
        home[key] = make()
    return home[key]


def stretches(text: str) -> tuple[str, list[str]]:
    """A text's first stretch, and the others without the space they start with."""
    if text[:1] == " " or any(pair in text for pair in _ODD):
        first, *rest = _CUT.split(text)
        return first, [r[1:] for r in rest]
    first, *rest = text.split(" ")
    return first, rest


class Known:
    """Ids by string: those in use lately, and those before them. What is asked for again stays."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode, self.ids, self.earlier = encode, {}, {}

    def learn(self, wanted: set[str]) -> dict[str, bytes]:
        """All of ``wanted``, and perhaps more."""
        if len(self.ids) > ENTRIES:
            self.ids, self.earlier = {}, self.ids
        missing = wanted.difference(self.ids)
        earlier = self.earlier
        again = [w for w in missing if w in earlier]
        self.ids.update(zip(again, map(earlier.__getitem__, again)))
        new = list(missing.difference(again))
        self.ids.update(zip(new, self.encode(new), strict=True))
        return self.ids


class ChunkCache:
    """``encode`` gets stretches with the space they start with; ``lead`` puts one before each text that is not empty."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], lead: bool = False):
        self.lead = lead
        self.first = Known(encode)
        self.spaced = Known(lambda words: encode([" " + w for w in words]))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; missing stretches of all texts are encoded together."""
        cut = [stretches(t) for t in texts]
        if self.lead:
            cut = [("", [f, *r] if f or r else r) for f, r in cut]
        first = self.first.learn({f for f, _ in cut})
        spaced = self.spaced.learn(set().union(*(r for _, r in cut))).__getitem__
        return [first[f] + b"".join(map(spaced, r)) for f, r in cut]
