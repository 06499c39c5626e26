from __future__ import annotations

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstat.llm import text as T

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBc é\t\n \x0b|", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.booleans(), st.integers(1, 40))
def test_words_as_by_pattern(texts, fold, size):
    seen = {}
    row = 0
    for a, b, w in T.chunks(pa.array(texts, pa.string()), fold, size):
        assert a == row and b > a
        row = b
        for d in range(a, b):
            expected = brute.words(texts[d], fold)
            i, j = w.first[d - a], w.first[d - a + 1]
            raw = [w.raw(k, k + 1) for k in range(i, j)]
            assert [x.lower() if fold else x for x in raw] == expected
            for x, h in zip(expected, w.hash[i:j], strict=True):
                assert seen.setdefault(x, h) == h
    assert row == len(texts)
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 6))
def test_runs_are_equal_for_equal_words(texts, n):
    seen = {}
    for a, b, w in T.chunks(pa.array(texts, pa.string()), False):
        h, first = w.runs(n)
        for d in range(a, b):
            expected = brute.words(texts[d])
            own = h[first[d - a] : first[d - a + 1]]
            grams = [tuple(expected[i : i + n]) for i in range(len(expected) - n + 1)]
            assert len(own) == len(grams)
            for x, y in zip(grams, own, strict=True):
                assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


def test_sliced_and_large_columns():
    column = pa.array(["drop", "a b", None, "c"]).slice(1)
    (a, b, w), = T.chunks(column, False)
    assert (a, b) == (0, 3) and w.counts.tolist() == [2, 0, 1]
    (_, _, w), = T.chunks(pa.array(["a b"], pa.large_string()), False)
    assert w.counts.tolist() == [2]


def test_distinct_per_group():
    values, first = T.distinct_per_group(np.array([3, 1, 3, 2, 2], np.uint64), np.array([0, 3, 3, 5]))
    assert values.tolist() == [1, 3, 2] and first.tolist() == [0, 2, 2, 3]


@pytest.mark.parametrize("rows", [0, 1])
def test_empty_column(rows):
    found = list(T.chunks(pa.array([""] * rows, pa.string()), True))
    assert sum(len(w.hash) for *_, w in found) == 0
