from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm.tokenizer import MergeAutomaton, compile_automaton, count_tokens, decode_corpus, default_vocabulary, encode_corpus

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path, pattern = default_vocabulary()
    with open(path, "rb") as f:
        mine = compile_automaton(f.read(), pattern)
    theirs = tokenizers.Tokenizer.from_file(path)
    theirs.encode_special_tokens = True
    return mine, theirs


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ab \n'ts0é日", max_size=60), st.text("etaoin", min_size=1, max_size=40)))
def test_same_ids_and_exact_round_trip(both, text):
    mine, theirs = both
    assert mine.encode(text) == theirs.encode(text, add_special_tokens=False).ids
    assert mine.decode(mine.encode(text)) == text


def test_odd_texts(both):
    mine, theirs = both
    for text in ["<|endoftext|>", "a" * 5000, " " * 700 + "x", "=" * 333, "\u0000﻿", "ﬁ " * 50, "👩‍👩‍👧" * 9, "word " * 3000]:
        assert mine.encode(text) == theirs.encode(text, add_special_tokens=False).ids
    assert mine.encode(None) == mine.encode("") == []


def test_small_automaton_by_hand():
    """Merges a+b, ab+c, b+c, a+a on three letters: b+c fires only where no a stands before."""
    vocabulary = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258, b"aa": 259}
    m = MergeAutomaton(vocabulary, [(b"a", b"b"), (b"ab", b"c"), (b"b", b"c"), (b"a", b"a")], r"\S+")
    assert m.encode_word(b"abc") == [257] and m.encode_word(b"bbc") == [98, 258] and m.encode_word(b"aaab") == [259, 256] and m.encode_word(b"aaa") == [259, 97]


def test_frames(spark, rows):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, " \n ", "x")], "doc_id long, text string, ids string")
    got = rows(encode_corpus(df), "doc_id", "ids")
    assert got == [(1, [15496, 995]), (2, []), (3, []), (3, []), (None, [220, 198, 220])]
    assert rows(decode_corpus(encode_corpus(df))) == [(1, "Hello world"), (2, ""), (3, ""), (3, ""), (None, " \n ")]
    assert rows(count_tokens(df, "text"), "doc_id", "n_tokens") == [(1, 2), (2, 0), (3, 0), (3, 0), (None, 3)]
    assert encode_corpus(df.limit(0)).count() == 0
