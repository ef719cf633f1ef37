import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridfold.llm import packing
from gridfold.llm.queries import tokenizer_path

ODD = [
    "it's we're don't O'Reilly 12²³ ½", "x<|endoftext|>y", "ΣΑΣ ﬁ İstanbul á 你好", "nb\xa0sp\x85z a\x1cb", "", "   ", "!!'s?? 'S 'LL",
    "naïve café!!! " + "x" * 5000, "w " * 9000,
]


def ids_of(text):
    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("memory", [5, 10**6])
def test_ids_equal_the_tokenizer(monkeypatch, memory):
    monkeypatch.setattr(packing, "REMEMBERED", memory)
    encode = packing.WordEncoder(tokenizer_path())
    texts = ODD * 40
    assert [np.frombuffer(x, "<u4").tolist() + [1] for x in encode(texts)] == [ids_of(t) for t in ODD] * 40


def test_words_in_use_are_learnt_once(monkeypatch):
    """Words that come again outlast a full memory, and ids stay those of the tokenizer."""
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    encode, learnt, learn = packing.WordEncoder(tokenizer_path()), Counter(), packing.WordEncoder._learn
    monkeypatch.setattr(encode, "_learn", lambda parts: (learnt.update(parts), learn(encode, parts)))
    texts = [f"Often, naïve é{'abcdefghij'[i % 10]}x{i} ²b'll x.y,, ÀÖ× q" for i in range(1000)]
    plain = Tokenizer.from_file(tokenizer_path())
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert learnt["often"] == learnt["naïve"] == 1


def test_workers_forget_words_after_a_task(spark, documents):
    """Reused workers go on to other steps without the words of the texts they packed."""
    rows = [(i, f"word{i} naïve {'x' * i}") for i in range(40)]
    assert packing.token_pieces(documents(rows), tokenizer_path()).count() == 40

    def held(batches):
        from gridfold.llm.packing import _ENCODERS

        n = sum(len(e.known) + len(e.older) for e in _ENCODERS.values())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows)], ["n"])

    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {0}


def test_pieces_are_whole(documents):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, "again"), (3, "again"), (-4, "q")]
    got = packing.packed_documents(documents(rows, extra="length"), tokenizer_path(), 64).collect()
    want = Counter()
    for d, t in rows:
        ids = ids_of(t)
        for p in range(0, len(ids), 64):
            want[(d, p, len(ids[p : p + 64]), zlib.crc32(np.array(ids[p : p + 64], "<u4").tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    check_places([(r.sequence_id, r.offset, r.length) for r in got], 64)


def check_places(places, size):
    end = {}
    for s, o, n in sorted(places):
        assert o == end.get(s, 0), "a gap or an overlap"
        end[s] = o + n
    assert all(v <= size for v in end.values())
    assert sorted(end) == list(range(len(end)))
    return end


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 300), max_size=40))
def test_histogram_packs_everything_once(counts):
    placed, ranks = [], Counter()
    for length, rank, n, first, offset in packing.pack_histogram(counts, 50):
        assert rank == ranks[length]
        ranks[length] += n
        placed += [(first + i, offset, length) for i in range(n)]
    assert ranks == Counter(counts)
    fill = check_places(placed, 50)
    if counts:  # shortest pack first leaves at most one more sequence than twice the need
        assert len(fill) <= 2 * sum(n * c for n, c in counts.items()) / 50 + 1


def test_salted_ranks_and_padding(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 50)
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0L AS start", "if(id % 3 = 0, 100L, 1 + id * 7919 % 99) AS length")
    rows = packing.pack(pieces, 100, ["doc_id", "start"]).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    fill = check_places([(r.sequence_id, r.offset, r.length) for r in rows], 100)
    assert sum(fill.values()) / (100 * len(fill)) > 0.98


def test_sequences_hold_the_ids(documents):
    rows = [(1, "one two three"), (2, None), (3, "word " * 100)]
    found = packing.sequences(documents(rows), tokenizer_path(), 32).collect()
    assert sorted(i for r in found for i in r.ids) == sorted(i for _, t in rows for i in ids_of(t))
    assert packing.packed_documents(documents(rows).limit(0), tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack_histogram({9: 1}, 8)
