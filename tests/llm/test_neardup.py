from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import Row

from loomstat.llm import neardup as N
from loomstat.llm.components import components


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def corpus(seed, groups=12, copies=6, length=90):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, length))]
        for _ in range(rng.randrange(1, copies)):
            rows.append((n, " ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 20)))))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "  \t"), (n + 3, "one two"), (n + 4, "ONE  two\n"), (n + 5, "two one")]
    rng.shuffle(rows)
    return rows


def result(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = N.near_duplicates(docs, **options).collect()
    assert len(got) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}, got


@pytest.mark.parametrize(("seed", "size"), [(1, 4), (2, 5)])
def test_same_as_all_pairs(spark, seed, size):
    rows = corpus(seed)
    got, full = result(spark, rows, size=size)
    assert got == brute.near_duplicates(rows, size, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in full)


def test_crowded_bucket_in_small_blocks(spark):
    """One large group of near copies, most pairs below the threshold: blocks find the links beside the leader's."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(0, 6)))) for i in range(70)]
    expected = brute.near_duplicates(rows, 4, 80)
    assert len({c for _, c in expected.values()}) > 3
    assert result(spark, rows, size=4, block=8)[0] == expected


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (1, "A b c d  e"), (None, None)],
                                 "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(docs, size=4).collect())
    assert got == [("1", 2, 1, True), ("3", 2, 1, False), ("3", 2, 1, False), ("None", 0, None, True), ("None", 2, None, True)]
    assert N.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(TypeError):
        N.near_duplicates(docs.withColumn("doc_id", docs.doc_id.cast("string")))


def test_one_id_with_two_texts_that_each_have_a_near_copy(spark):
    one, two = ([f"{c}{i}" for i in range(60)] for c in "ab")
    near = lambda words: " ".join([*words[:-1], "other"])
    one, two, close_one, close_two = " ".join(one), " ".join(two), near(one), near(two)
    rows = [(1, one), (1, two), (2, close_one), (3, close_two), (4, one), (5, " ".join(f"c{i}" for i in range(60)))]
    for first in (0, 3):
        docs = spark.createDataFrame(rows[first:] + rows[:first], "doc_id long, text string").repartition(3)
        got = sorted((r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(docs, size=4).collect())
        assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 5, True)]
    # The second text of id 4 is a copy of id 0; the first leads a group of its own.
    rows = [(4, one), (4, two), (0, close_two), (7, close_one)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect())
    assert got == [(0, 0, True), (4, 0, False), (4, 4, True), (7, 4, False)]


def test_one_text_of_the_smallest_id_is_kept(spark):
    base = [f"a{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (1, " ".join(base)), (1, " ".join([*base[:-1], "other"])), (2, " ".join(base).upper())]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert {r.component_id for r in got} == {1}
    assert sum(r.kept for r in got) in (1, 2) and not any(r.kept for r in got if r.doc_id == 2)


def test_pipeline_keeps_one_document_of_a_group(spark):
    import corpus_pipeline

    one, two = ([f"{c}{i}" for i in range(60)] for c in "ab")
    close = " ".join([*two[:-1], "other"])
    one, two = " ".join(one), " ".join(two)
    rows = [(1, one), (1, one), (2, one), (4, two), (4, one), (5, close), (6, ""), (6, ""), (None, one), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(corpus_pipeline.drop_near_duplicates(spark, docs, "").collect(), key=str)
    assert got == sorted([(1, one), (4, two), (6, ""), (6, ""), (None, one), (None, one)], key=lambda r: str(docs_row(*r)))


def docs_row(doc_id, text):
    return Row(doc_id=doc_id, text=text)


def test_ranks_are_a_superminhash():
    rng = np.random.default_rng(0)
    m = 64
    for n in (1, 5, 64, 3000):
        values = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        ranks = N.superminhash(values, np.array([0, len(values)]), m)[0]
        assert len(np.unique(ranks)) == m  # no two components share a rank
        if n == 1:  # the single element visits every component once, one each round
            assert sorted((ranks >> np.uint64(32)).tolist()) == list(range(m))
        again = N.superminhash(np.concatenate([values[::-1], values[:1]]), np.array([0, len(values), len(values) + 1]), m)
        assert (again[0] == ranks).all()
    errors = []
    for _ in range(120):
        pool = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        both = np.concatenate([pool[:50], pool[10:]])
        r = N.superminhash(both, np.array([0, 50, 100]), m)
        errors.append((r[0] == r[1]).mean() - 40 / 60)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 0.9 * (2 / 3 * 1 / 3 / m) ** 0.5  # less than independent hashes have


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(40)], [(99, i) for i in range(30)], [(5, 5)], [(1, 2), (2, 1), (3, 4), (4, 1), (9, 8)],
    [(0, None), (None, None), (7, 6)], []])
def test_components(spark, edges):
    root = {}
    for u, v in edges:
        if u is not None and v is not None:
            a, b = root.setdefault(u, u), root.setdefault(v, v)
            for k in root:
                if root[k] in (a, b):
                    root[k] = min(a, b)
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.root for r in got.collect()} == root
