"""Wavelet matrix, suffix array and FM-index against plain counting."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscope.llm.decontam import FMIndex, Phrases, search_shard, suffix_array, words_of
from corpuscope.llm.wavelet import WaveletMatrix


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=600))
def test_wavelet_matrix(values):
    a = np.array(values, dtype=np.uint16)
    w = WaveletMatrix.from_bytes(WaveletMatrix.build(a, 6).to_bytes())
    assert (w.decode() == a).all()
    if len(a):
        at = np.arange(len(a))
        symbol, rank = w.access(at)
        assert (symbol == a).all() and all(r == (a[:i] == a[i]).sum() for i, r in zip(at, rank))
        for s in set(values):
            assert w.count(s) == values.count(s) and (w.select(s, np.arange(w.count(s))) == np.flatnonzero(a == s)).all()
    assert w.count(41) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120))
def test_suffix_array_and_search(values):
    s = np.array([0, *values, 0], dtype=np.int32)
    seps = int((s == 0).sum())
    v = s + seps
    v[s == 0] = np.arange(seps)
    assert (suffix_array(s) == sorted(range(len(s)), key=lambda i: v[i:].tolist())).all()
    index = FMIndex(s, 3)
    patterns = np.array([[1, 2], [0, 3], [2, 2], [3, 1]], dtype=np.int32)
    length = np.array([2, 1, 2, 2])
    who, lo, hi = index.search(patterns, length)
    found = {int(p): sorted(index.locate(np.arange(a, b)).tolist()) for p, a, b in zip(who, lo, hi)}
    for k, (p, n) in enumerate(zip(patterns.tolist(), length)):
        p = p[len(p) - n :]
        want = [i for i in range(len(s) - n + 1) if s[i : i + n].tolist() == p]
        assert found.get(k, []) == want


def test_search_shard_marks_every_occurrence():
    phrases = Phrases([("x", "a b c"), ("y", "b c d"), (None, "z z"), ("e", "...")], 2)
    get = phrases.vocabulary.get
    ids = np.array([get(w, 0) for w in words_of("A b, c q b c D z z z")], dtype=np.int32)
    a, b, w = search_shard([(7, 0, ids)], phrases)[7]
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 2), (1, 3), (4, 6), (5, 7), (7, 9), (8, 10)]
