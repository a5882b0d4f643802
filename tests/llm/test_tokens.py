import random
import sys
import zlib
from array import array
from itertools import combinations_with_replacement
from pathlib import Path

import public_tokenizers
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from helpers import AWKWARD, edits, words

from tidemark.llm.bin_slack import Encoder, fullest, packed, windows
from tidemark.llm.piece_agenda import MARK, encoded, pieces_of

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "the", "ing", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", "​", "é", "ß", "中", "😀", "'s", "12", "!", "<|endoftext|>", "<s>", "</s>", MARK, "<0x0A>", "\x00", "﻿", "<unk>"]


def odd_texts(n):
    for seed in range(n):
        r = random.Random(seed)
        yield "".join(r.choices(PARTS, k=r.randint(0, 15)))


TEXTS = [*AWKWARD, *odd_texts(400), words(1, 3000), "word" * 2000, " lead", "trail ", *["hot text"] * 40]


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id")]
    out = packed(edits(spark, rows).repartition(3), BPE).collect()
    for i, t in rows:
        ids = array("I", [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]).tobytes()
        pieces = sorted((r for r in out if r.rev_id == i), key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in pieces) == ids, t
        assert all(p.doc_tokens == len(ids) // 4 and p.length == len(p.ids) // 4 for p in pieces)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    full = sum(sum(n for _, n in p) == 1024 for p in sequences.values())
    assert full >= len(sequences) - 2 * 3
    assert packed(edits(spark, []), BPE).collect() == []
    assert zlib.crc32(b"") == 0


def test_stretches_equal_the_library():
    encoder = Encoder(BPE)
    r = random.Random(9)
    texts = ["", " ", *("".join(r.choices(" abcXYZé9'.\n", k=r.randint(1, 9))) for _ in range(2000)), *(" " + w for w in words(4, 300).split()), "letters", " letters", "İ", " ſ"]
    assert encoder.stretches(texts) == encoder.whole(texts) == encoder.ids(texts)


def test_the_fullest_window_equals_brute_force():
    r = random.Random(5)
    for _ in range(200):
        counts = {r.randint(1, 20): r.randint(1, 3) for _ in range(r.randint(0, 5))}
        capacity = r.randint(0, 40)
        best = 0
        stock = [n for n, c in counts.items() for _ in range(c)]
        for mask in range(1 << len(stock)):
            total = sum(n for i, n in enumerate(stock) if mask >> i & 1)
            best = max(best, total if total <= capacity else 0)
        chosen = fullest(counts, capacity)
        assert all(0 < c <= counts[n] for n, c in chosen.items())
        assert sum(n * c for n, c in chosen.items()) == best


def test_windows_use_every_length_once():
    r = random.Random(6)
    counts = {r.randint(1, 100): r.randint(1, 9) for _ in range(40)}
    content = list(windows(counts, 100))
    assert all(0 < sum(n * c for n, c in w.items()) <= 100 for w in content)
    used = {}
    for w in content:
        for n, c in w.items():
            used[n] = used.get(n, 0) + c
    assert used == counts and list(windows({}, 100)) == []


def test_encoding_and_decoding_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id")]
    out = encoded(edits(spark, rows).repartition(3), MODEL).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        ids = library.encode(texts[r.rev_id] or "", add_bos=True, add_eos=True)
        assert bytes(r.ids) == array("I", ids).tobytes() and r.decoded == library.decode(ids)
    assert encoded(edits(spark, []), MODEL).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_agenda_equals_the_library_on_single_words(seed):
    pieces = pieces_of(MODEL)
    r = random.Random(seed)
    for _ in range(300):
        word = "".join(r.choices("abcdeinorstéñ0.中", k=r.randint(1, 40)))
        assert pieces.merge(MARK + word) == pieces.library.encode(word)


def test_short_alphabets_exhaustively():
    pieces = pieces_of(MODEL)
    for n in range(1, 6):
        for letters in combinations_with_replacement("aet", n):
            word = "".join(letters)
            assert pieces.merge(MARK + word) == pieces.library.encode(word)
