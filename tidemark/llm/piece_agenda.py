"""Edit texts to pieces and back, by a score-ordered agenda of adjacent symbol pairs.

The vocabulary is a merge type: a text starts as single characters, every adjacent pair
whose union is a piece waits on an agenda, and the pair with the best score, leftmost among
equals, merges first and puts its new neighbours on the agenda. What is no piece in the end
becomes its UTF-8 bytes.

No piece of such a vocabulary holds a space mark after another character (checked when it is
loaded), so no merge crosses from one word into the next mark, and a word is worked out once.
The agendas of a batch's new words are rows of one table; long or odd words have a heap each.
In every Arrow batch the sentencepiece library encodes all texts whole as well; any difference
fails the job. It also decodes.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.chunk_cache import ChunkCache, of_worker
from tidemark.llm.common import edit_columns
from tidemark.llm.pair_rows import PairRows

MARK = "▁"
#: Texts encoded, checked and decoded at a time.
SLICE = 256
ENCODED = "rev_id bigint, ids binary, decoded string"
_ARROW = pa.schema([("rev_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


class EncodingMismatch(ValueError):
    """The agenda and the library disagree on a text."""


class Pieces:
    """Scores and ids of a merge vocabulary."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        for piece in self.ids:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} crosses words")
        # Equal scores are one rank, so that among them the leftmost pair merges first.
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = {p: order[sp.get_score(i)] for p, i in self.ids.items()}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.rows = PairRows(self.rank)
        self.row_ids = np.array([self.ids[p] for p in self.rows.tokens], "<u4")
        self.symbol = np.full(0x110000, -1, np.int32)
        for piece, i in self.rows.number.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.foreign = re.compile(f"([^{re.escape(''.join(sorted(set().union(*self.ids))))}])")

    def merge(self, word: str) -> list[int]:
        """Ids of a stretch of characters."""
        rank = self.rank.get
        symbols = list(word)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # The rank of the pair that starts at each place now; an entry with another rank is stale.
        now = [rank(a + b) for a, b in zip(symbols, symbols[1:], strict=False)]
        now.append(None)
        agenda = [r * n + i for i, r in enumerate(now) if r is not None]
        heapify(agenda)
        while agenda:
            r, i = divmod(heappop(agenda), n)
            if now[i] != r:
                continue
            j = after[i]
            union = symbols[i] = symbols[i] + symbols[j]
            symbols[j] = now[j] = now[i] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = now[i] = rank(union + symbols[k])
                if r is not None:
                    heappush(agenda, r * n + i)
            h = before[i]
            if h >= 0:
                r = now[h] = rank(symbols[h] + union)
                if r is not None:
                    heappush(agenda, r * n + h)
        ids = self.ids
        out: list[int] = []
        for s in symbols:
            if s is not None:
                if s in ids:
                    out.append(ids[s])
                else:
                    out += [self.byte_ids[b] for b in s.encode()]
        return out


    def merged(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        # A character of no piece merges with nothing, so what stands between such ones is merged by itself.
        parts = [self.foreign.split(w) for w in words]
        plain = list(chain.from_iterable(p[::2] for p in parts))
        codes = np.frombuffer("".join(plain).encode("utf-32-le"), "<u4")
        found = self.rows.merge([len(w) for w in plain], self.symbol[codes], self.row_ids)
        ids = iter([found[i] if i in found else array("I", self.merge(w)).tobytes() for i, w in enumerate(plain)])
        return [next(ids) if len(p) == 1 else b"".join(array("I", self.merge(s)).tobytes() if i % 2 else next(ids) for i, s in enumerate(p)) for p in parts]


def pieces_of(model: str) -> Pieces:
    return of_worker(("pieces", model), lambda: Pieces(model))


def _cache(pieces: Pieces) -> ChunkCache:
    # The library puts a space before a text that is not empty.
    return ChunkCache(lambda words: pieces.merged([w.replace(" ", MARK) for w in words]), lead=True)


def _coder(model: str):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        cache = of_worker(("piece chunks", model), lambda: _cache(pieces))
        begin, end = array("I", [pieces.begin]).tobytes(), array("I", [pieces.end]).tobytes()
        library = pieces.library
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                texts = part.column(1).to_pylist()
                # A mark in a text is a space to the library.
                found = [begin + ids + end for ids in cache.ids([t.replace(MARK, " ") for t in texts])]
                wanted = library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
                for text, ids, want in zip(texts, found, wanted, strict=True):
                    if array("I", want).tobytes() != ids:
                        raise EncodingMismatch(text[:200])
                # These are the ids found, as the library likes them.
                decoded = library.decode(wanted, num_threads=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary()), pa.array(decoded, pa.string())], schema=_ARROW)

    return code


def encoded(edits: DataFrame, model: str) -> DataFrame:
    """One row per edit: rev_id, ids with begin and end, and the text they decode to.

    ``edits`` needs ``rev_id`` and ``diff``; other columns are ignored. ``model`` is the path of
    a merge-type sentencepiece model that every executor can read. ``ids`` are little-endian
    unsigned 32-bit integers. A NULL or empty text has the two marks only and decodes to an
    empty one; repeated rows are encoded alike. No rows in, none out. An edit that the
    library encodes otherwise fails the job.
    """
    return edit_columns(edits).mapInArrow(_coder(model), ENCODED)
