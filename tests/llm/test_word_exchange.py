import random
import sys
from pathlib import Path

import public_tokenizers
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from helpers import AWKWARD, edits, words

from tidemark.llm.word_exchange import Cutter, Merges, TextsChanged, _joined, class_differences, coded, decoded, read_ranks
from tidemark.llm.word_exchange_query import op11_byte_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PARTS = ["a", "the", "ing", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", "​", "é", "ß", "中", "😀", "'s", "'ll", "12", "!", "<|endoftext|>", "\x00", "﻿", "ՠ", "֋", "𑷠"]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def odd_texts(n):
    for seed in range(n):
        r = random.Random(seed)
        yield "".join(r.choices(PARTS, k=r.randint(0, 15)))


TEXTS = [*AWKWARD, *odd_texts(400), words(1, 3000), "word" * 2000, " lead", "trail ", *["hot text"] * 40]


@pytest.mark.parametrize("block_chars", [1, 500, 10_000_000])
def test_ids_and_bytes_equal_the_library(spark, library, block_chars):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, TEXTS[3])]
    found = decoded(coded(edits(spark, rows, "ids").repartition(3), RANKS, PATTERN, block_chars=block_chars), RANKS).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        text = texts[r.rev_id] or ""
        assert r.ids == library.encode_ordinary(text), text[:100]
        assert bytes(r.decoded) == text.encode()


def test_no_rows_and_no_ids(spark):
    assert coded(edits(spark, []), RANKS, PATTERN).collect() == []
    rows = spark.createDataFrame([(1, None), (2, []), (None, [64])], "rev_id bigint, ids array<int>")
    assert [bytes(r.decoded) for r in decoded(rows, RANKS).orderBy("rev_id").collect()] == [b"a", b"", b""]


def test_an_id_outside_the_vocabulary_fails(spark):
    rows = spark.createDataFrame([(1, [50_256])], "rev_id bigint, ids array<int>")
    with pytest.raises(Exception):  # noqa: B017
        decoded(rows, RANKS).collect()


@pytest.mark.parametrize("seed", range(4))
def test_scanned_and_queued_merges_equal_the_library(library, seed):
    merges = Merges(read_ranks(RANKS))
    r = random.Random(seed)
    for _ in range(300):
        word = "".join(r.choices("abcdeinorstéñ0.中 ", k=r.randint(2, 60))).encode()
        want = library._encode_single_piece(word)
        assert merges._scanned(word) == want and merges._queued(word) == want


def test_words_follow_the_classes_of_the_library():
    """With single bytes only and one class as the pattern, the library shows what it takes for a letter."""
    import tiktoken

    cutter = Cutter(PATTERN, class_differences())
    probe = tiktoken.Encoding("letters", pat_str=r"\p{L}", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    for code in [*range(0x500, 0x600), *range(0x880, 0x8A0), *range(0x11DD0, 0x11DF0), 0x1F600, 0x323B0]:
        letter = bool(probe.encode_ordinary(chr(code)))
        assert (len(cutter.words("x" + chr(code) + "x")) == 1) == letter, hex(code)


def test_readings_that_differ_are_noticed():
    import pyarrow as pa

    empty = pa.compress(b"", "zstd", asbytes=True)
    heads = [{"block": 1, "check": "a", "counts": None, "packed": None}, {"block": 1, "check": "b", "counts": [0], "packed": empty, "rev_ids": [1]}]
    with pytest.raises(TextsChanged):
        list(_joined(heads))
    with pytest.raises(TextsChanged):
        list(_joined(heads[:1]))
    heads[1]["check"] = "a"
    assert [b.to_pylist() for b in _joined(heads)] == [[{"rev_id": 1, "ids": []}]]


def test_the_query_equals_the_library(spark, library, tmp_path):
    import hashlib

    rows = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in op11_byte_bpe(spark, str(tmp_path)).collect():
        ids = library.encode_ordinary(TEXTS[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()


def test_a_pattern_may_leave_characters_out(spark):
    """Letters only: digits, marks and spaces belong to no word and get no ids."""
    import regex

    texts = ["ab1cd ef", "12 34", " x  y ", "é-中 a'b", "a\u00a0 b c1"]
    merges = Merges(read_ranks(RANKS))
    found = coded(edits(spark, list(enumerate(texts))), RANKS, r"\p{L}+").collect()
    for r in found:
        assert r.ids == [i for w in regex.findall(r"\p{L}+", texts[r.rev_id]) for i in merges.ids(w.encode())]


def test_ids_are_decoded_by_the_worker_that_joins_them_back(spark, tmp_path):
    """After the last exchange the query has one Python step: two would hold two workers a core."""
    spark.createDataFrame([(1, "some text")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = op11_byte_bpe(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    last = plan.split("Sort [block")[0]
    assert last != plan and last.count("MapInArrow") == 1


def test_no_text_of_a_block_stays_while_the_next_is_read():
    """The texts of 10 blocks come in one Arrow batch; strings of no more than a block and a slice exist at a time."""
    import tracemalloc

    import pyarrow as pa

    from tidemark.llm.word_exchange import SLICE, _sequencer

    n, size = 10 * SLICE, 1_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["a" * size] * n), pa.array([0] * n)], ["rev_id", "diff", "task"])
    sequence = _sequencer(PATTERN, {}, SLICE * size)
    list(sequence(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    try:
        found = sum(1 for _ in sequence(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == 10
    assert peak < 5 * SLICE * size
