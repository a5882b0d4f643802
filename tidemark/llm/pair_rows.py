"""Words of a batch merged side by side: in each, the adjacent pair of lowest rank, leftmost among equals, merges first.

Tokens are numbered in the order of their ranks. A pair waits in its word's row under the number of the token
that it makes; a step takes the least of every row, merges it and looks up its two new pairs. Left to the caller
are long words, those with a symbol that is no token, and those that come to make a token whose rank others share.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Symbols of a word up to which a row is looked through at each step.
LONGEST = 64
#: Words whose lengths differ by less than this share rows; so many at least make rows worth while.
STEP, FEWEST = 4, 16
_NONE = np.int32(2**31 - 1)


class PairRows:
    """``ranks`` of tokens, each a string or bytes."""

    def __init__(self, ranks: dict):
        #: The tokens by number, and the number of each.
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.number = {t: i for i, t in enumerate(self.tokens)}
        by_rank = np.array([ranks[t] for t in self.tokens], np.int64)
        same = np.concatenate([[False], by_rank[1:] == by_rank[:-1], [False]])
        self.shared = same[1:] | same[:-1]
        self.pad = len(ranks)
        found = {}
        for token, i in self.number.items():
            for cut in range(1, len(token)):
                a, b = self.number.get(token[:cut]), self.number.get(token[cut:])
                if a is not None and b is not None:
                    found[a * (self.pad + 1) + b] = i
        # The last key is more than any pair's, so a search always ends at one.
        self.keys = np.array([*sorted(found), 2**62], np.int64)
        self.unions = np.array([*(found[k] for k in sorted(found)), _NONE], np.int32)

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * (self.pad + 1) + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.unions[at], _NONE)

    def _merged(self, symbols: np.ndarray) -> np.ndarray:
        """Rows after all merges, with -1 where a place was merged away or the row is left. The first and last column are padding."""
        n = symbols.shape[1]
        pairs = np.full(symbols.shape, _NONE, np.int32)
        pairs[:, :-1] = self._ranked(symbols[:, :-1], symbols[:, 1:])
        after = np.tile(np.arange(1, n + 1, dtype=np.int32), (len(symbols), 1))
        before = after - 2
        rows = np.arange(len(symbols))
        while True:
            i = pairs[rows].argmin(1)
            union = pairs[rows, i]
            live = union != _NONE
            left = self.shared[np.where(live, union, 0)] & live
            if left.any():
                symbols[rows[left]] = -1
                live &= ~left
            if not live.all():
                rows, i, union = rows[live], i[live], union[live]
            if not len(rows):
                return symbols
            j, h = after[rows, i], before[rows, i]
            k = after[rows, j]
            symbols[rows, i], symbols[rows, j] = union, -1
            pairs[rows, j] = _NONE
            after[rows, i], before[rows, k] = k, i
            pairs[rows, i] = self._ranked(union, symbols[rows, k])
            pairs[rows, h] = self._ranked(symbols[rows, h], union)

    def merge(self, sizes: Sequence[int], symbols: np.ndarray, ids: np.ndarray) -> dict[int, bytes]:
        """By word, the bytes of its ``ids`` (one for each number). ``symbols`` are those of all words in a row, -1 for what is no token."""
        sizes = np.asarray(sizes, np.int64)
        first = np.cumsum(sizes) - sizes
        odd = np.concatenate([[0], np.cumsum(symbols < 0)])
        fit = (sizes <= LONGEST) & (odd[first + sizes] == odd[first])
        width = np.where(fit, -(-sizes // STEP) * STEP, 0)
        out: dict[int, bytes] = {}
        for w in np.unique(width[width > 0]).tolist():
            words = np.flatnonzero(width == w)
            if len(words) < FEWEST:
                continue
            inside = np.arange(w) < sizes[words, None]
            table = np.full((len(words), w + 2), self.pad, np.int32)
            table[:, 1:-1][inside] = symbols[(first[words, None] + np.arange(w))[inside]]
            table = self._merged(table)
            kept = (table >= 0) & (table != self.pad)
            whole, counts = ids[table[kept]].tobytes(), kept.sum(1)
            ends = (np.cumsum(counts) * ids.itemsize).tolist()
            out.update((at, whole[a:b]) for at, a, b in zip(words.tolist(), [0, *ends], ends, strict=False) if a < b)
        return out
