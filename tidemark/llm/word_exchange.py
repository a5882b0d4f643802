"""Edit texts to byte-level token ids and back, by one exchange of their distinct words.

A pattern cuts every text into words (pre-tokens), and a word's ids depend on nothing else. So:

1. Explode: edits are read in blocks. A block numbers its distinct words by first occurrence, its
   places, and deals ``(word, place)`` by a hash of the word; words that go the same way share a row.
2. Exchange: equal words of the whole corpus meet in one task, and each distinct word is encoded
   once. A word that fills a third of the corpus arrives once from each block it occurs in.
3. Join back: the ids return to ``(block, place)``, where they meet the block's sequence of places.
4. Reassemble: each place in the sequence gets its ids, and the sequence is cut into edits.

Texts are cut between words and spaces first, and each such stretch is put to the pattern once a block.
The sequences are read from the texts a second time instead of being stored beside the words,
which would write them twice; a digest of the block's words proves that both readings agree.
Decoding joins ids with the table of token bytes, one row for each token of the vocabulary.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import blake2b
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunk_cache import of_worker, stretches
from tidemark.llm.common import edit_columns, shuffle_width
from tidemark.llm.pair_rows import PairRows

#: Characters of a block; a longer text is a block of its own.
BLOCK_CHARS = 16_000_000
#: Words that are not merged in rows: up to this many bytes they are merged by scanning, longer ones by a heap.
SHORT = 48
#: Edits handed on at a time.
SLICE = 2_000
_BLOCK_BITS = 31
_NO_RANK = 1 << 62
_PARTS = "block bigint, check string, rev_ids array<bigint>, counts array<int>, packed binary"
_DEALT = f"share int, {_PARTS}"
CODED = "rev_id bigint, ids array<int>"
DECODED = "rev_id bigint, ids array<int>, decoded binary"


class TextsChanged(RuntimeError):
    """The edits differed between two readings of one query."""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a file with one base-64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Merges:
    """Ids of a word: adjacent parts whose union has the lowest rank merge first, the leftmost among equals."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.rows = PairRows(ranks)
        self.row_ids = np.array([ranks[t] for t in self.rows.tokens], "<u4")
        self.symbol = np.array([self.rows.number.get(bytes([b]), -1) for b in range(256)], np.int32)

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        plain = [w for w in words if w not in self.ranks]
        symbols = self.symbol[np.frombuffer(b"".join(plain), np.uint8)]
        found = self.rows.merge([len(w) for w in plain], symbols, self.row_ids)
        by_word = {plain[i]: ids for i, ids in found.items()}
        return [by_word[w] if w in by_word else array("I", self.ids(w)).tobytes() for w in words]

    def ids(self, word: bytes) -> list[int]:
        known = self.ranks.get(word)
        if known is not None:
            return [known]
        return self._scanned(word) if len(word) <= SHORT else self._queued(word)

    def _scanned(self, word: bytes) -> list[int]:
        get = self.ranks.get
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [get(word[i : i + 2], _NO_RANK) for i in range(len(word) - 1)]
        while pairs:
            best = min(pairs)
            if best == _NO_RANK:
                break
            at = pairs.index(best)
            union = parts[at] + parts.pop(at + 1)
            parts[at] = union
            del pairs[at]
            if at < len(pairs):
                pairs[at] = get(union + parts[at + 1], _NO_RANK)
            if at:
                pairs[at - 1] = get(parts[at - 1] + union, _NO_RANK)
        return [self.ranks[p] for p in parts]

    def _queued(self, word: bytes) -> list[int]:
        get, n = self.ranks.get, len(word)
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is merged away
        before = list(range(-1, n - 1))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            _, i, stop = heappop(queue)
            middle = end[i]
            # An entry is stale if either part has changed since.
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(word[i : end[stop]])) is not None:
                    heappush(queue, (r, i, end[stop]))
            h = before[i]
            if h >= 0 and (r := get(word[h:stop])) is not None:
                heappush(queue, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return out


@cache
def class_differences() -> dict[int, str]:
    """Characters that ``regex`` and the tiktoken library class differently, each with a stand-in of the library's class.

    The two know letters and numbers of different Unicode versions; both are asked once, on the driver.
    """
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    theirs, differing = {}, set()
    for name in (r"\p{L}", r"\p{N}"):
        probe = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs[name] = set(bytes(probe.encode_ordinary(every)).decode())
        differing |= theirs[name] ^ set(regex.findall(name, every))
    return {ord(c): STANDS[next((n for n in theirs if c in theirs[n]), "")] for c in differing}


# A letter, a number and an unassigned character in every version.
STANDS = {r"\p{L}": "é", r"\p{N}": "٣", "": "͸"}


class Cutter:
    """The words of a text by a pattern with Unicode classes, as the tiktoken library cuts them.

    A text with a character that the library classes differently is cut with the stand-in in its place.
    """

    def __init__(self, pattern: str, stand: dict[int, str]):
        import regex

        self.find, self.stand = regex.compile(pattern), stand
        self.differing = {chr(c) for c in stand}

    def words(self, text: str) -> list[str]:
        if text.isascii() or self.differing.isdisjoint(text):
            return self.find.findall(text)
        return [text[m.start() : m.end()] for m in self.find.finditer(text.translate(self.stand))]


def cutter_of(pattern: str, stand: dict[int, str]) -> Cutter:
    return of_worker(("word cutter", pattern), lambda: Cutter(pattern, stand))


def _blocks(batches: Iterator[pa.RecordBatch], block_chars: int) -> Iterator[tuple[int, list, list[str]]]:
    """(block, rev_ids, texts): the task's edits in order, cut where a block is full."""
    number: int | None = None
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        if number is None and batch.num_rows:
            number = batch.column(2)[0].as_py() << _BLOCK_BITS
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            for rev_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if texts and size + len(text) > block_chars:
                    yield number, ids, texts
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(rev_id)
                texts.append(text)
                size += len(text)
    if texts:
        yield number, ids, texts


def _digest(words: list[str]) -> str:
    found = blake2b("".join(words).encode(), digest_size=16)
    found.update(np.array([len(w) for w in words], "<u4").tobytes())
    return found.hexdigest()


class _Block:
    """The distinct words of a block, and texts as sequences of their places.

    Words are numbered text by text, those of a text's new stretches in the order of the stretches, so two
    readings of the same texts number alike.
    """

    def __init__(self, cut: Callable[[str], list[str]], sequences: bool):
        self.cut, self.sequences, self.places = cut, sequences, {}
        self.first: dict[str, tuple | None] = {}
        self.spaced: dict[str, tuple | None] = {}

    def _numbered(self, stretch: str) -> tuple | None:
        places = self.places
        found = [places.setdefault(w, len(places)) for w in self.cut(stretch)]
        return tuple(found) if self.sequences else None

    def _learn(self, new: list[str]) -> None:
        """Put new stretches to the pattern together: in a row they are cut as they are alone, each at its space."""
        row = [r for r in new if r and not r[-1].isspace()]
        words = self.cut(" " + " ".join(row)) if row else []
        ends, bounds = list(accumulate(map(len, words))), list(accumulate(len(r) + 1 for r in row))
        if row and (ends[-1:] != bounds[-1:] or not set(bounds).issubset(ends)):
            # The pattern leaves something out: then only a stretch by itself tells which words are its own.
            row = []
        else:
            places = self.places
            found = [places.setdefault(w, len(places)) for w in words]
            if self.sequences:
                cuts = np.searchsorted(ends, bounds).tolist() if row else []
                self.spaced.update((r, tuple(found[a:b])) for r, a, b in zip(row, [0, *(c + 1 for c in cuts)], [c + 1 for c in cuts], strict=False))
            else:
                self.spaced.update(dict.fromkeys(row))
        for r in new if not row else (r for r in new if not r or r[-1].isspace()):
            self.spaced[r] = self._numbered(" " + r)

    def add(self, text: str) -> np.ndarray | None:
        """The text's words are counted in; its places, where sequences are wanted."""
        first, rest = stretches(text)
        if first not in self.first:
            self.first[first] = self._numbered(first)
        self._learn(sorted(set(rest).difference(self.spaced)))
        if not self.sequences:
            return None
        out = array("I", self.first[first])
        out.extend(chain.from_iterable(map(self.spaced.__getitem__, rest)))
        return np.frombuffer(out, "<u4")


_PARTS_ARROW = pa.schema([("block", pa.int64()), ("check", pa.string()), ("rev_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("packed", pa.binary())])
_DEALT_ARROW = pa.schema([("share", pa.int32()), *_PARTS_ARROW])


def _packed(places: np.ndarray, items: list[bytes]) -> dict:
    """Places and the bytes that belong to them as columns of one row."""
    sizes = np.array([len(i) for i in items], "<u4")
    whole = b"".join([places.astype("<u4").tobytes(), sizes.tobytes(), *items])
    return {"counts": [len(items), int(sizes.sum())], "packed": pa.compress(whole, "zstd", asbytes=True)}


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Places, sizes and bytes of one row."""
    n, m = row["counts"]
    whole = pa.decompress(row["packed"], 8 * n + m, "zstd", asbytes=True)
    return np.frombuffer(whole, "<u4", n), np.frombuffer(whole, "<u4", n, 4 * n), whole[8 * n :]


def _runs(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with the positions that hold it, in order."""
    order = np.argsort(keys, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(keys[order])) + 1).tolist(), len(order)]
    for a, b in zip(edges, edges[1:], strict=False):
        if a < b:
            yield int(keys[order[a]]), order[a:b]


def _exploder(pattern: str, stand: dict[int, str], block_chars: int, shares: int):
    """The distinct words of each block with their places, a row for each share of the words."""

    def dealt(number: int, texts: list[str]) -> pa.RecordBatch:
        block = _Block(cutter_of(pattern, stand).words, False)
        for t in texts:
            block.add(t)
        places = list(block.places)
        del block
        check = _digest(places)
        words = [w.encode() for w in places]
        share = np.array([crc32(w) for w in words], np.int64) % shares
        rows = [{"share": k, "block": number, **_packed(at, [words[i] for i in at.tolist()])} for k, at in _runs(share)]
        return pa.RecordBatch.from_pylist([{"share": number % shares, "block": number, "check": check}, *rows], _DEALT_ARROW)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts in _blocks(batches, block_chars):
            found = dealt(number, texts)
            # No text of this block stays while the next one is read.
            del texts
            yield found

    return explode


def _sequencer(pattern: str, stand: dict[int, str], block_chars: int):
    """The texts of each block as one sequence of places."""

    def placed(number: int, rev_ids: list, texts: list[str]) -> pa.RecordBatch:
        block = _Block(cutter_of(pattern, stand).words, True)
        found = [block.add(t) for t in texts]
        check = _digest(list(block.places))
        del block
        counts = [len(f) for f in found]
        found = np.concatenate(found)
        row = {"block": number, "check": check, "rev_ids": rev_ids, "counts": counts, "packed": pa.compress(pa.py_buffer(found), "zstd", asbytes=True)}
        return pa.RecordBatch.from_pylist([row], _PARTS_ARROW)

    def sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rev_ids, texts in _blocks(batches, block_chars):
            found = placed(number, rev_ids, texts)
            del texts
            yield found

    return sequence


def _encoder(ranks: str):
    """Ids of one share of all words, each word encoded when it first arrives."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = of_worker(("merges", ranks), lambda: Merges(read_ranks(ranks))).merged
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for row in batch.drop_columns(["share"]).to_pylist():
                if row["check"] is None:
                    places, sizes, whole = _unpacked(row)
                    ends = np.cumsum(sizes, dtype=np.int64).tolist()
                    words = [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                    new = list(set(words).difference(known))
                    known.update(zip(new, merged(new), strict=True))
                    row = {"block": row["block"], **_packed(places, [known[w] for w in words])}
                yield pa.RecordBatch.from_pylist([row], _PARTS_ARROW)

    return encode


def _joined(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """The edits of one block with their ids, from its sequence, both digests of its words, and their ids by place."""
    schema = pa.schema([("rev_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    heads = [r for r in rows if r["check"] is not None]
    whole = next((h for h in heads if h["packed"] is not None), None)
    if len(heads) != 2 or whole is None or heads[0]["check"] != heads[1]["check"]:
        raise TextsChanged("store the edits before they are encoded")
    counts = np.array(whole["counts"], np.int64)
    sequence = np.frombuffer(pa.decompress(whole["packed"], int(counts.sum()) * 4, "zstd", asbytes=True), "<u4")
    parts = [_unpacked(r) for r in rows if r["check"] is None]
    places, sizes = (np.concatenate([p[k] for p in parts] or [np.empty(0, "<u4")]) for k in (0, 1))
    ids = np.frombuffer(b"".join(p[2] for p in parts), "<i4")
    by_word = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes // 4)]), pa.int32()), pa.array(ids))
    by_place = np.empty(len(places), np.int64)
    by_place[places] = np.arange(len(places))
    first = np.concatenate([[0], np.cumsum(counts)])
    for at in range(0, len(counts), SLICE):
        edges = first[at : at + SLICE + 1]
        taken = by_word.take(pa.array(by_place[sequence[edges[0] : edges[-1]]]))
        bounds = taken.offsets.to_numpy()
        found = pa.ListArray.from_arrays(pa.array((bounds[edges - edges[0]] - bounds[0]).astype(np.int32)), taken.flatten())
        yield pa.RecordBatch.from_arrays([pa.array(whole["rev_ids"][at : at + SLICE], pa.int64()), found], schema=schema)


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for batch in batches:
        # A row at a time: a batch may hold many blocks.
        for at in range(batch.num_rows):
            (row,) = batch.slice(at, 1).to_pylist()
            if rows and row["block"] != rows[0]["block"]:
                yield from _joined(rows)
                rows = []
            rows.append(row)
    if rows:
        yield from _joined(rows)


def _exchanged(edits: DataFrame, ranks: str, pattern: str, block_chars: int) -> DataFrame:
    """The sequence of each block and the ids of its words, in one task and next to each other."""
    # Not the task's own number: in a union with other tasks that is another one.
    texts = edit_columns(edits, F.spark_partition_id().alias("task"))
    stand, shares = class_differences(), shuffle_width(edits.sparkSession)
    words = texts.mapInArrow(_exploder(pattern, stand, block_chars, shares), _DEALT)
    ids = words.repartitionById(shares, F.col("share")).mapInArrow(_encoder(ranks), _PARTS)
    sequences = texts.mapInArrow(_sequencer(pattern, stand, block_chars), _PARTS)
    return ids.unionByName(sequences).repartition("block").sortWithinPartitions("block")


def coded(edits: DataFrame, ranks: str, pattern: str, *, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per edit: rev_id and the ids of its text.

    ``edits`` needs ``rev_id`` and ``diff``; other columns are ignored. ``ranks`` is the path of
    a file of byte-level ranks that every executor can read, ``pattern`` what cuts texts into
    words; each match is encoded by itself, and what no match covers is left out. It must not match
    across a space that follows anything but white space, as patterns with an optional leading space do not. A NULL or empty
    text has no ids; repeated rows are encoded alike, and a NULL ``rev_id`` stays NULL.
    No rows in, none out. A task holds one block, or one text if it is longer. ``edits`` is read
    twice in one query and must give the same rows in the same order both times, as files and
    stored tables do; if it does not, the job fails. Distinct words are spread over as many tasks as
    ``spark.sql.shuffle.partitions`` says, and each holds its own.
    """
    return _exchanged(edits, ranks, pattern, block_chars).mapInArrow(_reassemble, CODED)


def _decoder(ranks: str):
    schema = pa.schema([("rev_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def table() -> pa.Array:
        found = read_ranks(ranks)
        by_id = [None] * (max(found.values(), default=-1) + 1)
        for token, i in found.items():
            by_id[i] = token
        return pa.array(by_id, pa.binary())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = of_worker(("token bytes", ranks), table)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lists = part.column(1)
                taken = tokens.take(lists.flatten())
                if taken.null_count:
                    raise ValueError("an id is not in the vocabulary")
                edges = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
                bounds = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, taken.offset * 4)
                data = taken.buffers()[2] or pa.py_buffer(b"")
                offsets = pa.py_buffer(np.ascontiguousarray(bounds[edges]).tobytes())
                whole = pa.Array.from_buffers(pa.binary(), len(lists), [None, offsets, data])
                yield pa.RecordBatch.from_arrays([part.column(0), lists, whole], schema=schema)

    return decode


def decoded(codes: DataFrame, ranks: str) -> DataFrame:
    """One row per row of ``codes``: rev_id, ids and the bytes that they stand for (``decoded``).

    ``codes`` needs ``rev_id`` and ``ids`` (array of int); other columns are ignored. The token
    table has one row for each token of ``ranks``, by id, and each batch of ids is joined with it. NULL or
    no ids give no bytes; an id outside the table fails the job. No rows in, none out.
    """
    return codes.select(F.col("rev_id").cast("bigint").alias("rev_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decoder(ranks), DECODED)


def coded_and_decoded(edits: DataFrame, ranks: str, pattern: str, *, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``decoded(coded(...))``, where the worker that joins the ids back decodes them too.

    Two Python steps in a row hold two workers a core and every id once more between them.
    """
    decode = _decoder(ranks)
    return _exchanged(edits, ranks, pattern, block_chars).mapInArrow(lambda batches: decode(_reassemble(batches)), DECODED)
