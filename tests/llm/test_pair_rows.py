import random
import sys
from array import array
from pathlib import Path

import numpy as np
import public_tokenizers

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.llm.pair_rows import FEWEST, LONGEST, PairRows
from tidemark.llm.piece_agenda import MARK, pieces_of
from tidemark.llm.word_exchange import Merges, read_ranks

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def by_definition(word, ranks):
    parts = list(word)
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return parts
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_rows_equal_the_definition_and_leave_what_is_odd():
    r = random.Random(3)
    for seed in range(20):
        r.seed(seed)
        tokens = {*"abc", *("".join(r.choices("abc", k=r.randint(2, 5))) for _ in range(30))}
        # Every rank is unique but that of two tokens.
        ranks = {t: i for i, t in enumerate(sorted(tokens, key=lambda _: r.random()))}
        doubled = [t for t in tokens if len(t) == 2][:2]
        ranks.update(dict.fromkeys(doubled, min((ranks[t] for t in doubled), default=0)))
        rows = PairRows(ranks)
        words = ["".join(r.choices("abc" if r.random() < 0.9 else "abcx", k=r.randint(0, LONGEST + 9))) for _ in range(600)]
        symbols = np.array([rows.number.get(c, -1) for c in "".join(words)], np.int32)
        found = rows.merge([len(w) for w in words], symbols, np.arange(len(ranks), dtype="<u4"))
        assert len(found) > FEWEST or len(doubled) == 2
        for i, ids in found.items():
            assert words[i] and "x" not in words[i] and len(words[i]) <= LONGEST
            assert [rows.tokens[k] for k in array("I", ids)] == by_definition(words[i], ranks)
    assert PairRows({}).merge([], np.empty(0, np.int32), np.empty(0, "<u4")) == {}


def test_new_words_of_a_batch_equal_the_heap_and_the_library_and_rarely_need_the_heap(monkeypatch):
    pieces = pieces_of(MODEL)
    r = random.Random(8)
    words = [MARK + "".join(r.choices("abcdeinorstéñ0.中\n😀\x00", k=r.randint(0, 30))) for _ in range(5000)]
    words += ["", MARK, MARK * 2 + "a", MARK * 40, "e" * 200, *[MARK * 3 + "in"] * 40]
    want = [array("I", pieces.merge(w)).tobytes() for w in words]
    heaps, one = [], pieces.merge
    monkeypatch.setattr(pieces, "merge", lambda w: heaps.append(w) or one(w))
    assert pieces.merged(words) == want
    assert sum(len(w) > 1 for w in heaps) < 200
    for w, ids in zip(words[:5000], want):
        assert len(w) == 1 or pieces.library.encode(w[1:]) == array("I", ids).tolist()


def test_new_words_of_a_share_equal_single_merges():
    merges = Merges(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    r = random.Random(4)
    words = ["".join(r.choices(" abcdehinorstéñ中.\n😀\x00", k=r.randint(1, 30))).encode() for _ in range(4000)]
    words += [b"e" * 300, b" the", b"\xff\xfe", *[b" zq\xe9"] * 3]
    singles = []
    for w in words:
        singles.append(array("I", merges.ids(w)).tobytes())
    alone, one = [], merges.ids
    merges.ids = lambda w: alone.append(w) or one(w)
    assert merges.merged(words) == singles
    assert sum(w not in merges.ranks for w in alone) < 200
