from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomstat.llm import mixing as M


def fill(budget, nodes):
    """[(weight, capacity)] → budgets, by sharing what full nodes leave, round after round."""
    got = [0.0] * len(nodes)
    open_ = {i for i, (w, c) in enumerate(nodes) if c > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(nodes[i][0] for i in open_)
        full = {i for i in open_ if got[i] + left * nodes[i][0] / total >= nodes[i][1] - 1e-9}
        if not full:
            for i in open_:
                got[i] += left * nodes[i][0] / total
            break
        for i in full:
            left -= nodes[i][1] - got[i]
            got[i] = nodes[i][1]
        # The others start again from nothing, so that weights hold among them.
        left += sum(got[i] for i in open_ - full)
        for i in open_ - full:
            got[i] = 0.0
        open_ -= full
    return got


@pytest.mark.parametrize("seed", range(4))
def test_water_fill(spark, seed):
    rng = random.Random(seed)
    rows = [(g, f"n{i}", float(rng.randrange(1, 9)), rng.randrange(0, 500), 1000) for g in range(3) for i in range(rng.randrange(1, 8))]
    got = {(r.g, r.name): r.budget for r in M.water_fill(
        spark.createDataFrame(rows, "g int, name string, weight double, capacity long, given long"), ["g"]).collect()}
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        for r, e in zip(own, fill(1000, [(r[2], r[3]) for r in own]), strict=True):
            assert got[g, r[1]] == pytest.approx(e, abs=1)


def test_shortage_goes_to_siblings_before_ancestors(spark):
    supply = spark.createDataFrame([("a", "x", 10), ("a", "y", 500), ("b", "x", 500), ("b", "y", 500)], "d string, s string, tokens long")
    got = {(r.d, r.s): r.budget for r in M.leaf_budgets(supply, ["d", "s"], None, 400, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 100, ("b", "y"): 100}
    weights = spark.createDataFrame([("a", None, 3.0), ("b", "x", 0.0)], "d string, s string, weight double")
    got = {(r.d, r.s): r.budget for r in M.leaf_budgets(supply, ["d", "s"], weights, 1200, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 500, ("b", "x"): 0, ("b", "y"): 500}


def test_excluded_children_leave_their_share_to_siblings_of_the_parent(spark):
    supply = spark.createDataFrame([("a", "x", 500), ("b", "x", 500), ("b", "y", 10)], "d string, s string, tokens long")
    weights = spark.createDataFrame([("b", "x", 0.0)], "d string, s string, weight double")
    got = {(r.d, r.s): r.budget for r in M.leaf_budgets(supply, ["d", "s"], weights, 400, 1).collect()}
    assert got == {("a", "x"): 390, ("b", "x"): 0, ("b", "y"): 10}
    deep = spark.createDataFrame([("a", "k", "x", 500), ("b", "k", "x", 500), ("b", "k", "y", 10), ("b", "l", "z", 30), ("c", "k", "x", 70)],
                                 "d string, e string, s string, tokens long")
    weights = spark.createDataFrame([("b", "k", "x", 0.0), ("c", "k", None, -1.0)], "d string, e string, s string, weight double")
    got = {(r.d, r.e, r.s): r.budget for r in M.leaf_budgets(deep, ["d", "e", "s"], weights, 400, 2).collect()}
    assert got == {("a", "k", "x"): 320, ("b", "k", "x"): 0, ("b", "k", "y"): 20, ("b", "l", "z"): 60, ("c", "k", "x"): 0}


def docs_of(spark, n=300):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), rng.choice(["p", "p", "q", None]), rng.choice("st"), 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, budget int")


@pytest.mark.parametrize(("epochs", "share", "bucket"), [(1, 0.5, 5), (3, 1.7, 40), (1, 1.0, 2000)])
def test_token_prefix_of_seeded_epochs(spark, epochs, share, bucket):
    docs = docs_of(spark)
    got = M.mix(docs, ["lang", "source"], share=share, max_epochs=epochs, bucket_docs=bucket)
    assert got.columns == [*docs.columns, "_epoch", "_tokens", "_taken"]
    rows = got.collect()
    total = docs.select(F.sum(M.word_count(F.col("text")))).first()[0]
    taken = sum(r._taken for r in rows)
    assert 0 <= share * total - taken <= 20 + 0.001 * total if share <= epochs else True
    other = M.mix(docs.repartition(7), ["lang", "source"], share=share, max_epochs=epochs, bucket_docs=7).collect()
    assert sorted(map(str, rows)) == sorted(map(str, other))  # neither partitions nor buckets matter
    leaves = {}
    for r in rows:
        leaves.setdefault((r.lang, r.source, r._epoch), []).append(r)
    cut = [[r for r in own if r._taken < r._tokens] for own in leaves.values()]
    assert all(len(c) <= 1 for c in cut)  # one document of a leaf is cut at most
    assert all(r._taken <= r._tokens and r._epoch < epochs for r in rows)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "p", None), (1, "a b", "p", None), (None, None, None, "s"), (2, "", "p", "s")],
                                 "doc_id long, text string, lang string, source string")
    assert M.mix(docs, ["lang", "source"], share=1.0).count() >= 2
    assert M.mix(docs.limit(0), ["lang", "source"], share=1.0).count() == 0
    assert M.mix(docs, ["lang"], budget=0).count() == 0
    with pytest.raises(ValueError, match="budget"):
        M.mix(docs, ["lang"])
    with pytest.raises(ValueError, match="_epoch"):
        M.mix(docs.withColumn("_epoch", F.lit(1)), ["lang"], share=1.0)
