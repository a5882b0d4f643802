"""Edit texts packed into token windows with minimum bin slack.

A text's ids end with a separator and are cut into pieces: as many full windows as it
fills, and a remainder. Full pieces are windows of their own. Remainders are packed without
further cuts: each window takes the largest one left and then the multiset of the others that
comes closest to the capacity, found by a subset-sum over lengths held as a bitset and read
back as a count for each length. Whatever lengths a task holds, the search is over at most
``window`` distinct ones, never over texts.

Each task packs the texts of its own partition, so nothing is shuffled and memory is bounded
by the partition. Only a partition's last windows are not full.
"""

from __future__ import annotations

import os
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.chunk_cache import ChunkCache, of_worker
from tidemark.llm.common import edit_columns

WINDOW = 1024
SEPARATOR = 0
#: Texts tokenised at a time.
SLICE = 256
#: Fixed value: the character a byte-level vocabulary writes for a space.
SPACE_MARK = "Ġ"
PIECES = "rev_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_ARROW = pa.schema(
    [("rev_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length give the largest sum up to ``capacity``.

    Bit s of ``sums`` is set if some multiset sums to s. A length's copies are added in
    steps of 1, 2, 4, ... so that every count up to the stock can be formed.
    """
    mask = (1 << (capacity + 1)) - 1
    full = 1 << capacity
    sums, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, step = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(step, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            left -= take
            step *= 2
        if sums & full:
            break
    at, chosen = sums.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not (before >> at) & 1:
            chosen[length] += take
            at -= length * take
    return dict(chosen)


def windows(lengths: dict[int, int], window: int = WINDOW) -> Iterator[dict[int, int]]:
    """The content of one window after another, as a count for each length, until all are used."""
    left = dict(lengths)

    def use(length: int, n: int) -> None:
        left[length] -= n
        if not left[length]:
            del left[length]

    while left:
        largest = max(left)
        use(largest, 1)
        more = fullest(left, window - largest) if largest < window else {}
        for length, n in more.items():
            use(length, n)
        content = defaultdict(int, more)
        content[largest] += 1
        yield dict(content)


class Encoder:
    """Ids by a tokenizers file, as little-endian unsigned 32-bit integers.

    A byte-level file of this kind cuts a text before a space that follows something else, so the
    stretches between are encoded by themselves, each once per worker while room lasts. One of ASCII letters
    only is one pre-token and goes to the file's model at once. A text that holds the string of a
    special token, which may reach over such a cut, is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = sorted(t.content for t in self.library.get_added_tokens_decoder().values())
        self.model = self.library.model
        self.known = ChunkCache(self.stretches)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def stretches(self, texts: list[str]) -> list[bytes]:
        out, rest = [], []
        for at, t in enumerate(texts):
            letters = t[1:] if t[:1] == " " else t
            if letters.isascii() and letters.isalpha():
                marked = SPACE_MARK + letters if letters is not t else t
                out.append(array("I", [token.id for token in self.model.tokenize(marked)]).tobytes())
            else:
                out.append(b"")
                rest.append(at)
        for at, ids in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            out[at] = ids
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        odd = [any(s in t for s in self.special) for t in texts]
        rest = iter(self.whole([t for t, o in zip(texts, odd, strict=True) if o]))
        plain = iter(self.known.ids([t for t, o in zip(texts, odd, strict=True) if not o]))
        return [next(rest if o else plain) for o in odd]


def _packer(path: str, window: int, separator: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = of_worker(("tokenizers", path), lambda: Encoder(path))
        end = array("I", [separator]).tobytes()
        base = TaskContext.get().partitionId() << 40
        rest: dict[int, list[tuple]] = defaultdict(list)
        n = 0
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                out: list[tuple] = []
                for rev_id, ids in zip(part.column(0).to_pylist(), encoder.ids(part.column(1).to_pylist()), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        if len(piece) == 4 * window:
                            out.append((rev_id, start, window, piece, total, base + n, 0))
                            n += 1
                        else:
                            rest[len(piece) // 4].append((rev_id, start, piece, total))
                if out:
                    yield _arrow(out)
        out = []
        for content in windows({length: len(pieces) for length, pieces in rest.items()}, window):
            offset = 0
            for length in sorted(content, reverse=True):
                for _ in range(content[length]):
                    rev_id, start, piece, total = rest[length].pop()
                    out.append((rev_id, start, length, piece, total, base + n, offset))
                    offset += length
            n += 1
            if len(out) >= 2000:
                yield _arrow(out)
                out = []
        if out:
            yield _arrow(out)

    return pack


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def packed(edits: DataFrame, tokenizer: str, *, window: int = WINDOW, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: rev_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``edits`` needs ``rev_id`` and ``diff``; other columns are ignored. ``tokenizer`` is the
    path of a tokenizers file that every executor can read. ``ids`` are little-endian unsigned
    32-bit integers; ``doc_tokens`` counts the separator. A NULL or empty text is its
    separator alone. Texts of any length are cut, none is shortened. Repeated rows are packed
    as often as they stand, and a NULL ``rev_id`` stays NULL. No rows in, none out. A sequence
    is numbered by its partition and its place there.
    """
    return edit_columns(edits).mapInArrow(_packer(tokenizer, window, separator), PIECES)
