from __future__ import annotations

import dataclasses

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

from loomstat.operators import models, trees
from loomstat.operators.trees import FlatTrees, Growth


def table(n=1200, seed=0):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 12, n), rng.normal(size=n).round(1), rng.integers(0, 2, n)], 1).astype(float)
    return x, np.sin(x[:, 0]) + x[:, 1] ** 2 * x[:, 2] + 0.1 * rng.normal(size=n)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    x, y = table()
    path = str(tmp_path_factory.mktemp("trees") / "rows")
    rows = [(i, Vectors.dense(r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    spark.createDataFrame(rows, ["k", "features", "label_t"]).repartition(5).write.parquet(path)
    return spark.read.parquet(path), x, y


class Brute:
    """Exact greedy boosting over all midpoints, one row at a time."""

    def __init__(self, how):
        self.how = how

    def score(self, g, h):
        return max(abs(g) - self.how.l1, 0.0) ** 2 / (h + self.how.l2) if h + self.how.l2 > 0 else 0.0

    def leaf(self, g, h):
        return -np.sign(g) * max(abs(g) - self.how.l1, 0.0) / (h + self.how.l2) * self.how.rate if h + self.how.l2 > 0 else 0.0

    def node(self, x, g, depth):
        best = None
        if depth < self.how.depth and len(g) >= self.how.split_least:
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[:, f] <= cut
                    if min(low.sum(), (~low).sum()) < self.how.least:
                        continue
                    gain = self.score(g[low].sum(), low.sum()) + self.score(g[~low].sum(), (~low).sum()) - self.score(g.sum(), len(g))
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, cut)
        if best is None:
            return self.leaf(g.sum(), len(g))
        gain, f, cut = best
        low = x[:, f] <= cut
        sides = self.node(x[low], g[low], depth + 1), self.node(x[~low], g[~low], depth + 1)
        if gain < self.how.gamma and not any(isinstance(s, tuple) for s in sides):
            return self.leaf(g.sum(), len(g))
        return f, cut, *sides

    def value(self, node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    def boost(self, x, y, n):
        p = np.full(len(y), y.mean())
        for _ in range(n):
            tree = self.node(x, p - y, 0)
            p = p + np.array([self.value(tree, row) for row in x])
        return p


@pytest.mark.parametrize("how", [
    Growth(depth=3, l2=1.0), Growth(depth=2, rate=0.1, l1=15.0, l2=20.0), Growth(depth=4, gamma=25.0, l2=1.0), Growth(depth=3, least=90.0),
    Growth(depth=5, split_least=300.0), Growth(depth=0, l2=3.0)])
def test_boosting_as_exact_greedy(made, how):
    df, x, y = made
    got = trees.boost(df, "label_t", 3, how, key=["k"])
    assert got.predict(x) == pytest.approx(Brute(how).boost(x, y, 3), abs=1e-9)


def test_every_parameter_changes_the_fit(made):
    df, x, _ = made
    base = {"n_estimators": 3, "max_depth": 4}
    seen = [trees_of(df, "xgboost", base, x)]
    for more in ({"reg_alpha": 10.0}, {"reg_lambda": 30.0}, {"gamma": 20.0}, {"min_child_weight": 100}, {"subsample": 0.5}, {"colsample_bytree": 0.4}, {"learning_rate": 0.1}):
        seen.append(trees_of(df, "xgboost", base | more, x))
    for family in ("random_forest", "gradient_boosting"):
        seen += [trees_of(df, family, base | {"min_samples_split": s}, x) for s in (3, 200)]
    for i, a in enumerate(seen):
        assert all(np.abs(a - b).max() > 1e-6 for b in seen[:i])


def trees_of(df, family, params, x):
    part = models.fit(family, df, ["t"], params, ["k"]).parts["t"]
    assert isinstance(part, FlatTrees)
    return part.predict(x)


def test_cells_added_up_by_spark(made, monkeypatch):
    df, x, _ = made
    how = Growth(depth=4, l2=1.0, rows=0.7, columns=0.7, per_node="sqrt")
    here = trees.boost(df, "label_t", 4, how, key=["k"])
    monkeypatch.setattr(trees, "CELLS", 0)
    monkeypatch.setattr(trees, "REWRITE", 2)
    there = trees.boost(df, "label_t", 4, how, key=["k"])
    assert there.predict(x) == pytest.approx(here.predict(x), abs=1e-9)


def test_draws_depend_on_the_key_alone(made):
    df, x, _ = made
    how = Growth(depth=3, rows=0.5, bootstrap=False)
    a = trees.boost(df, "label_t", 3, how, key=["k"]).predict(x)
    assert trees.boost(df.repartition(3, "label_t"), "label_t", 3, how, key=["k"]).predict(x) == pytest.approx(a, abs=1e-9)


def test_bootstrapped_forest(made):
    df, x, y = made
    got = trees.forest(df, "label_t", 12, Growth(depth=8, split_least=10.0, bootstrap=True), key=["k"])
    assert 1 - ((y - got.predict(x)) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.9
    weights = trees._weights(np.random.default_rng(0).integers(0, 1 << 62, 50_000).astype(np.uint64), 3, Growth(bootstrap=True))
    assert weights.mean() == pytest.approx(1, abs=0.02) and weights.var() == pytest.approx(1, abs=0.05)


def test_rows_stay_in_their_tasks(made):
    """A level is one scan of the blocks; only cells come out of it."""
    df, _, _ = made
    binned = trees.bin_rows(df, "label_t", key=["k"])
    cells = trees._cells(binned, [trees._Tree(0)], [], Growth(), [np.arange(3)], forest=True)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Sort" not in plan
    assert cells.count() <= binned.tasks * (1 + 12 + 256 + 2)


def test_many_values_are_cut_at_quantiles(spark):
    rng = np.random.default_rng(1)
    x = rng.exponential(size=(4000, 1))
    df = spark.createDataFrame([(Vectors.dense(r), float(np.log(r[0]))) for r in x], ["features", "label_t"])
    edges = trees.bin_rows(df, "label_t").edges[0]
    share = np.searchsorted(np.sort(x[:, 0]), edges, side="right") / len(x)
    assert len(edges) == 255 and np.abs(share - np.arange(1, 256) / 256).max() < 0.002


@pytest.mark.parametrize(("model", "size"), [(GBTRegressor, {"maxIter": 4}), (RandomForestRegressor, {"numTrees": 4})])
def test_flat_form_of_sparks_trees(spark, made, model, size):
    df, x, _ = made
    fitted = model(maxDepth=4, labelCol="label_t", seed=1, **size).fit(df)
    flat = trees.from_spark(fitted, 3)
    want = {r.k: r.prediction for r in fitted.transform(df).collect()}
    assert flat.predict(x) == pytest.approx([want[k] for k in range(len(x))], abs=1e-9)


def test_binary_attributes_of_sparks_trees(spark):
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    rows = spark.createDataFrame([(w, float(i % 7), float(len(w) * (i % 7))) for i, w in enumerate(["a", "bb", "cccc"] * 40)], ["w", "v", "label_t"])
    rows = StringIndexer(inputCol="w", outputCol="i").fit(rows).transform(rows)
    rows = OneHotEncoder(inputCols=["i"], outputCols=["e"]).fit(rows).transform(rows)
    rows = VectorAssembler(inputCols=["e", "v"], outputCol="features").transform(rows)
    fitted = GBTRegressor(maxIter=3, maxDepth=3, labelCol="label_t").fit(rows)
    got = fitted.transform(rows).select("features", "prediction").collect()
    flat = trees.from_spark(fitted, 3)
    assert flat.predict(np.array([r.features.toArray() for r in got])) == pytest.approx([r.prediction for r in got], abs=1e-9)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1 << 30))
def test_swapped_features(seed):
    rng = np.random.default_rng(seed)
    parts = []
    for _ in range(rng.integers(1, 5)):
        n = int(rng.integers(0, 4))
        feature = np.array([*rng.integers(0, 3, n), *[-1] * (n + 1)], np.int32)
        free, left, right = list(range(1, 2 * n + 1)), np.zeros(2 * n + 1, np.int64), np.zeros(2 * n + 1, np.int64)
        for i in range(n):
            left[i], right[i] = free.pop(0), free.pop(0)
        parts.append(FlatTrees(feature, rng.normal(size=2 * n + 1), left, right, rng.normal(size=2 * n + 1), np.ones(2 * n + 1), np.zeros(1, np.int64), 3))
    whole = trees.joined(parts, 3, base=1.5)
    x, other = rng.normal(size=(9, 3)), rng.normal(size=(9, 3))
    before, got = x.copy(), whole.swapped(x, other)
    assert (x == before).all()
    for j in range(3):
        own = x.copy()
        own[:, j] = other[:, j]
        assert got[:, j] == pytest.approx(whole.predict(own))
    assert whole.predict(x) == pytest.approx(1.5 + sum(p.predict(x) for p in parts))
    assert sum(g.predict(x) for g in whole.groups(60)) == pytest.approx(whole.predict(x))


def test_transform_in_groups(spark, made, monkeypatch):
    df, x, _ = made
    got = trees.boost(df, "label_t", 3, Growth(depth=2), key=["k"])
    monkeypatch.setattr(trees.FlatTrees, "groups", lambda self, most=0, whole=trees.FlatTrees.groups: whole(self, 100))
    seen = {r.k: r.p for r in got.transform(df, "features", "p").collect()}
    assert [seen[k] for k in range(len(x))] == pytest.approx(got.predict(x).tolist())


def test_odd_tables(spark):
    fields = "k long, features array<double>, label_t double"
    from pyspark.ml.functions import array_to_vector

    def vectors(rows):
        return spark.createDataFrame(rows, fields).withColumn("features", array_to_vector("features"))

    empty = trees.boost(vectors([]), "label_t", 3, Growth())
    assert empty.predict(np.zeros((2, 0))).tolist() == [0, 0]
    assert trees.boost(vectors([(1, [1.0], None)]), "label_t", 3, Growth()).predict(np.zeros((2, 1))).tolist() == [0, 0]
    one = trees.boost(vectors([(1, [1.0], 5.0), (2, [2.0], None)]), "label_t", 3, Growth())
    assert one.predict(np.array([[1.0], [9.0]])).tolist() == [5, 5] and not one.featureImportances.toArray().any()
    nan = trees.boost(vectors([(i, [float("nan") if i % 2 else 1.0, 3.0], float(i % 2)) for i in range(40)]), "label_t", 1, Growth(rate=1.0, depth=1))
    assert nan.predict(np.array([[1.0, 3.0], [float("nan"), 3.0]])).tolist() == [0.5, 0.5]  # one value is not cut
    split = vectors([(i, [float("nan") if i % 3 == 2 else float(i % 3)], float(i % 3)) for i in range(60)])
    assert trees.boost(split, "label_t", 1, Growth(rate=1.0, depth=1)).predict(np.array([[0.0], [1.0], [float("nan")]])).tolist() == pytest.approx([0, 1.5, 1.5])


def test_small_trees_are_walked_for_whole_blocks(monkeypatch):
    """Both ways give the same nodes; the one for small trees makes no pass over the rows per level."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 256, (5, 3000)).astype(np.uint8)
    tree = trees._Tree(0)
    for node in range(31):
        if node < len(tree.feature) and rng.random() < 0.8:
            tree.feature[node], tree.cut[node] = int(rng.integers(5)), int(rng.integers(0, 256))
            for side in ("left", "right"):
                getattr(tree, side)[node] = len(tree.feature)
                for column, v in ((tree.feature, -1), (tree.cut, 0), (tree.left, 0), (tree.right, 0), (tree.value, 0.0), (tree.slot, 0)):
                    column.append(v)
    got = [trees._walk(x, t.arrays()) for t in (tree, trees._Tree(1))]
    monkeypatch.setattr(trees, "SMALL", 0)
    for found, t in zip(got, (tree, trees._Tree(1)), strict=True):
        assert found.dtype == np.uint8
        assert found.tolist() == trees._walk(x, t.arrays()).tolist()


def test_features_are_counted_together():
    """Few features of few bins take one count by their combination; its sums are those of every feature alone, and less is walked again when rows are many."""
    rng = np.random.default_rng(4)
    bins = [256, 11, 50, 7, 2, 2, 2, 1]
    x = np.stack([rng.integers(0, b, 5000) for b in bins]).astype(np.uint8)
    own = np.flatnonzero(rng.random(5000) < 0.7)
    slot, g, h = rng.integers(0, 3, len(own)), rng.normal(size=len(own)), rng.integers(1, 4, len(own)).astype(float)
    for features in ([0, 1, 2, 3, 4, 5, 6, 7], [1, 4], [7], []):
        for weight in (None, h):
            counted = trees.Counted(bins, features, 3)
            assert len(counted.groups) <= max(1, (len(features) + 1) // 2) and sorted(f for c in counted.groups for f in c) == sorted(features)
            for a, b in ((0, 1000), (1000, len(own))):
                counted.add(x, own[a:b], slot[a:b], g[a:b], None if weight is None else weight[a:b])
            seen = {}
            for s, f, place, gs, hs in counted.found(5):
                seen |= {(int(a) - 5, int(b), int(c)): (d, e) for a, b, c, d, e in zip(s, f, place, gs, hs, strict=True)}
            want = {}
            for f in (-1, *features):
                place = x[f, own] if f >= 0 else np.zeros(len(own), int)
                for i, (a, c) in enumerate(zip(slot, place, strict=True)):
                    old = want.get((int(a), f, int(c)), (0.0, 0.0))
                    want[int(a), f, int(c)] = (old[0] + g[i], old[1] + (1 if weight is None else h[i]))
            assert seen.keys() == want.keys()
            assert all(seen[k] == pytest.approx(v) for k, v in want.items())


def test_more_rows_wait_for_fewer_trees(made):
    binned = trees.bin_rows(made[0], "label_t", key=["k"])
    waits = [dataclasses.replace(binned, rows=n).rewrite(4) for n in (1000, 10**8, 10**12)]
    assert waits[0] == trees.REWRITE > waits[1] >= waits[2] >= 1


@pytest.mark.parametrize("how", [Growth(depth=5, least=20.0, bootstrap=True), Growth(depth=6, least=15.0, split_least=60.0, per_node="sqrt", bootstrap=True),
                                 Growth(depth=3, least=10.0, rows=0.5), Growth(depth=0)])
def test_trees_of_tasks_that_hold_all_rows(made, how):
    """They are those grown level by level; sums of their predictions give the errors."""
    df, x, y = made
    grown = trees.forest(df, "label_t", 7, how, key=["k"])
    for asked in (df.where("k % 3 = 0"), df.limit(0)):
        rows = asked.select("features", "label_t").where("label_t is not null").collect()
        miss = np.array([r.label_t for r in rows]) - (grown.predict(np.array([r.features.toArray() for r in rows])) if rows else 0.0)
        (n, error), (_, one) = trees.forest_errors(df, asked, "label_t", [(7, how), (1, how)], key=["k"])
        assert n == len(rows) and error == pytest.approx(float((miss * miss).sum()), rel=1e-6)
        assert one != error or not rows or how.depth == 0 and not how.bootstrap


def test_rows_of_many_slots_are_sorted(made):
    """Deep trees separate all rows that differ."""
    rng = np.random.default_rng(2)
    x = np.stack([rng.permutation(256), rng.integers(0, 4, 256)]).astype(np.uint8)
    rows = trees.Whole(x, rng.normal(size=256), rng.integers(0, 1 << 62, 256).astype(np.uint64), [256, 4], x, np.zeros(256))
    tree = trees.whole_tree(rows, 1, Growth(depth=30))
    assert tree[4][trees._walk(x, tree)] == pytest.approx(rows.y) and (tree[0] < 0).sum() == 256
