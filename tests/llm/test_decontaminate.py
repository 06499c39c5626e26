from __future__ import annotations

import random

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstat.llm import decontaminate as D


def distance(item, text):
    """Smallest edit distance of the item to any stretch, by the textbook table; and the first end."""
    row = list(range(len(item) + 1))
    best, end = row[-1], 0
    for j, w in enumerate(text, 1):
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (x != w)))
        row = new
        if row[-1] < best:
            best, end = row[-1], j
    return best, end


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.lists(st.integers(0, 3), max_size=120))
def test_myers_as_by_table(item, text):
    places = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    assert D.search(D.Item(0, len(item), 0, places), text) == distance(item, text)


@pytest.mark.parametrize("m", range(1, 30))
def test_pieces(m):
    k = D.budget(m, 0.2)
    cut = D.pieces(m, k)
    assert len(cut) == k + 1 and cut[0][0] == 0 and cut[-1][1] == m
    assert all(b > a for a, b in cut) and all(x[1] == y[0] for x, y in zip(cut, cut[1:], strict=False))


def spoil(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        how = rng.randrange(3)
        if how == 0:
            words[at] = f"z{rng.randrange(99)}"
        elif how == 1:
            words.insert(at, f"z{rng.randrange(99)}")
        elif len(words) > 1:
            del words[at]
    return words


@pytest.mark.parametrize("pass_words", [10**6, 20])
def test_same_as_all_pairs(spark, pass_words):
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 70)))) for i in range(12)]
    items += [(90, None), (91, " \t")]
    docs = []
    for d in range(60):
        words = [f"W{rng.randrange(30)}" for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            own = items[rng.randrange(12)][1].split()
            at = rng.randrange(len(words) + 1)
            words[at:at] = spoil(rng, own, rng.randrange(0, 2 + len(own) // 4))
        docs.append((d, " ".join(words), "x"))
    docs += [(70, None, "x"), (71, "", "x"), (None, items[3][1], "x"), (5, items[3][1], "x")]
    expected = []
    for d, t, _ in docs:
        for i, x in items:
            item = brute.words(x, True)
            if item:
                best, end = distance(item, brute.words(t, True))
                if best <= D.budget(len(item), 0.2):
                    expected.append((str(d), i, best, end))
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(str(r[0]), *r[1:]) for r in D.find_items(df, bench, pass_words=pass_words).collect()]
    assert [x[:3] for x in sorted(got)] == [x[:3] for x in sorted(expected)]
    left = D.clean(df, bench, pass_words=pass_words)
    assert left.columns == df.columns
    found = {(d, t) for d, t, _ in docs} - {(r.doc_id, r.text) for r in left.collect()}
    assert {str(d) for d, _ in found} == {x[0] for x in expected}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "a b")], "item_id string, text string")
    assert D.find_items(docs, bench).collect()[0].item_id == "q"
    assert D.find_items(docs, bench.limit(0)).count() == 0
    assert D.clean(docs, bench.limit(0)).count() == 1
    assert D.find_items(docs.limit(0), bench).count() == 0
