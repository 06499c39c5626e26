from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstat.llm import repeats as R
from loomstat.llm import text as T


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 30))
def test_sliding_min(values, width):
    got = R.sliding_min(np.array(values, dtype=np.uint64), width).tolist()
    assert got == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=25), min_size=1, max_size=5))
def test_depth_of_subtrees(pieces):
    first = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64)
    got = R.repeated_depth(np.array([x for p in pieces for x in p], dtype=np.uint64), first)
    suffixes = [p[i:] for p in pieces for i in range(len(p))]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    assert got.tolist() == [max([common(a, b) for j, b in enumerate(suffixes) if j != i], default=0) for i, a in enumerate(suffixes)]


def test_equal_windows_have_equal_anchors():
    import pyarrow as pa

    rng = random.Random(0)
    body = " ".join(f"w{rng.randrange(3)}" for _ in range(400))
    (_, _, words), = T.chunks(pa.array([body, "x " + body, body[40:]]), False)
    i0, i1, place, key = R.anchors(words, 12, 5)
    whole, limits = words.runs(12)
    by_word = {}
    for a, b, p, k in zip(i0, i1, place, key, strict=True):
        for i in range(a, b + 1):
            assert i not in by_word and 0 <= p - i <= 12 - 5
            by_word[i] = (p - i, k)
    seen = {}
    for d in range(3):
        for j in range(limits[d], limits[d + 1]):
            word = words.first[d] + j - limits[d]
            assert seen.setdefault(whole[j], by_word[word]) == by_word[word]


def corpus(seed):
    rng = random.Random(seed)
    passages = [[f"p{k}_{i}" for i in range(rng.randrange(3, 40))] for k in range(5)] + [["the"] * 30, ["a", "b"] * 12]
    rows = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(20))]
        rows.append(rng.choice([" ", "\n", " \t "]).join(words))
    return rows + ["", None, " \n", rows[0], "The " * 9]


@pytest.mark.parametrize(("window", "prefix", "hot", "limit"), [(8, 3, 11, 1 << 20), (8, 8, 11, 1 << 20), (10, 4, 3, 1 << 20), (8, 3, 3, 16)])
def test_same_as_all_windows(spark, window, prefix, hot, limit):
    """Ordinary prefixes, a prefix as long as the window, extended hot prefixes, a filter in many passes."""
    texts = corpus(window + hot)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in
           R.remove_repeats(docs, window=window, prefix=prefix, hot_level=hot, filter_bytes=limit).collect()}
    expected = dict(enumerate(brute.kept_words(texts, window)))
    assert sum(e[1] for e in expected.values()) > 100
    assert got == expected


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "x a b c"), (None, None), (2, "q r s t")],
                                 "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in R.remove_repeats(docs, window=3, prefix=2).collect())
    assert got == [("1", 4, 4, ""), ("1", 4, 4, ""), ("2", 4, 0, "q r s t"), ("None", 0, 0, ""), ("None", 4, 3, "x")]
    assert R.remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="prefix"):
        R.remove_repeats(docs, window=3, prefix=4)
