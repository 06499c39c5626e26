from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from loomstat import fixed
from loomstat.operators import evaluate, explain, features, kernel, models, neighbours, search
from loomstat.operators.kernel import FeatureMap, fit_kernel
from loomstat.operators.trees import FlatTrees
from loomstat.plans import model_queries
from loomstat.session import materialise


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=400), rng.normal(size=400)
    y = np.exp(1 + 0.5 * a - 0.3 * b + 0.05 * rng.normal(size=400))
    rows = [(i, None if i % 17 == 0 else float(a[i]), float(b[i]), "uvw"[i % 3], float(y[i])) for i in range(400)]
    return spark.createDataFrame(rows, "k int, a double, b double, c string, t double")


@pytest.fixture(scope="module")
def ready(wide):
    return features.prepare(wide, ["k"], ["a", "b"], ["c"], {"t": "log1p"}).stored()


def test_split_is_stable_and_complete(wide):
    one = {r.k: r.split for r in features.assign_split(wide, ["k"]).collect()}
    two = {r.k: r.split for r in features.assign_split(wide.repartition(7), ["k"]).collect()}
    assert one == two and len(one) == 400
    assert 0.12 < sum(v == "test" for v in one.values()) / 400 < 0.28


def test_contiguous_folds(spark):
    df = spark.range(100, 123).select(F.col("id").alias("k"))
    folds = [r.fold for r in features.assign_contiguous_fold(df.repartition(3), "k", 5).orderBy("k").collect()]
    assert folds == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4


def test_preprocessor_matches_numpy(spark):
    rows = [(1.0, 5.0, 2.0), (None, 5.0, 1.0), (4.0, 5.0, 2.0), (float("nan"), 5.0, None), (10.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "x double, flat double, code double").withColumn("void", F.lit(None).cast("double"))
    fitted = features.fit_preprocessor(df, ["x", "flat", "void"], ["code"])
    filled = np.array([1, 4, 4, 4, 10.0])
    assert fitted.numeric[0] == ("x", 4.0, pytest.approx(filled.mean()), pytest.approx(filled.std()))
    assert [n for n, *_ in fitted.numeric] == ["x", "flat"]
    # The tie between 1 and 2 goes to the smaller one.
    assert fitted.categorical == (("code", 1.0, (1.0, 2.0)),)
    assert fitted.names == ["num__x", "num__flat", "cat__code_1.0", "cat__code_2.0"]
    out = [list(r) for r in fitted.transform_columns(df).collect()]
    assert [r[1] for r in out] == [0.0] * 5
    assert [r[2:] for r in out] == [[0, 1], [1, 0], [0, 1], [1, 0], [1, 0]]
    unseen = fitted.transform(spark.createDataFrame([(None, 5.0, 9.0)], df.drop("void").schema), [])
    assert list(unseen.first()[0].toArray()) == [pytest.approx((4 - filled.mean()) / filled.std()), 0, 0, 0]
    assert features.Preprocessor.from_json(fitted.to_json()) == fitted


def test_scaled_training_features(ready):
    x = np.array([r.x for r in ready.train.select(vector_to_array("features").alias("x")).collect()])
    assert x[:, :2].mean(axis=0) == pytest.approx([0, 0], abs=1e-9)
    assert x[:, :2].std(axis=0) == pytest.approx([1, 1])
    assert set(x[:, 2:].sum(axis=1)) == {1.0}


def test_target_round_trip(spark):
    df = spark.createDataFrame([(1.0, 3.0), (5.0, 0.0)], "a double, b double")
    t = features.fit_targets(df, {"a": "log", "b": "log1p"}, scale=True)
    back = t.transform(df).select(t.invert("a", F.col("label_a")), t.invert("b", F.col("label_b"))).collect()
    assert [tuple(r) for r in back] == [pytest.approx((1.0, 3.0)), pytest.approx((5.0, 0.0), abs=1e-12)]


def matrix(rows, label="label_t"):
    got = rows.select(vector_to_array("features").alias("x"), label).collect()
    return np.array([r.x for r in got]), np.array([r[label] for r in got])


def test_ols_and_ridge_closed_form(ready):
    x, y = matrix(ready.train)
    ones = np.column_stack([np.ones(len(x)), x])
    beta = np.linalg.lstsq(ones, y, rcond=None)[0]
    got = models.fit("linear", ready.train, ["t"]).predict(ready.train).select("prediction_t").collect()
    assert [r[0] for r in got] == pytest.approx(list(ones @ beta), abs=1e-5)
    centred, mid = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(centred.T @ centred + 10.0 * np.eye(x.shape[1]), centred.T @ mid)
    ridge = models.fit("ridge", ready.train, ["t"], {"alpha": 10.0}).parts["t"]
    assert list(ridge.coefficients) == pytest.approx(list(want), abs=1e-8)


@pytest.mark.parametrize("family,params,least", [
    ("linear", {}, 0.85), ("ridge", {"alpha": 1.0}, 0.85), ("random_forest", {"n_estimators": 10, "max_depth": 6}, 0.7),
    ("gradient_boosting", {"n_estimators": 15}, 0.7), ("xgboost", {"n_estimators": 8, "max_depth": 4, "colsample_bytree": 0.9}, 0.7),
    ("knn", {"n_neighbors": 5, "weights": "distance"}, 0.99), ("svr", {"C": 10.0, "size": 64}, 0.7),
])
def test_family_learns_and_reloads(spark, ready, tmp_path, family, params, least):
    fitted = models.fit(family, ready.train, ["t"], params, ["k"])
    table = evaluate.report(fitted, ready.train, ready.targets, ["k"])
    assert evaluate.metrics(table).first()["R2"] > least
    fitted.save(spark, str(tmp_path / family))
    again = models.Fitted.load(spark, str(tmp_path / family))
    a = fitted.predict(ready.test, ["k"]).select("k", "prediction_t").orderBy("k").collect()
    b = again.predict(ready.test, ["k"]).select("k", "prediction_t").orderBy("k").collect()
    assert [r[1] for r in a] == pytest.approx([r[1] for r in b])


def test_several_targets(wide):
    both = wide.withColumn("u", F.col("t") * 2)
    ready = features.prepare(both, ["k"], ["a", "b"], [], {"t": "log1p", "u": None})
    fitted = models.fit("linear", ready.train, ["t", "u"])
    table = evaluate.metrics(evaluate.report(fitted, ready.test, ready.targets, ["k"]))
    assert evaluate.wide_metrics(table, ["t", "u"]).columns == ["Model", "R2 - t", "R2 - u", "RMSE - t", "RMSE - u"]
    knn = models.fit("knn", ready.train, ["t", "u"], {}, ["k"]).predict(ready.test, ["k"])
    assert knn.filter("prediction_t is null or prediction_u is null").count() == 0


def test_broken_models_are_reported(spark, ready, tmp_path):
    path = str(tmp_path / "models")
    good = models.fit("linear", ready.train, ["t"])
    other = models.Fitted("Wrong", "linear", ["z"], {}, {"z": good.parts["t"]})
    models.save_models(spark, [other, good], path)
    assert [n for n, _ in models.manifest_paths(spark, path)] == ["Wrong", "Linear Regression"]
    with pytest.warns(UserWarning, match="skipped Wrong"):
        table, status = evaluate.score_saved(spark, path, ready.test, ready.targets, ["k"])
    assert [(r.Model, r.status) for r in status.orderBy("position").collect()] == [
        ("Wrong", "skipped"), ("Linear Regression", "scored")]
    assert evaluate.metrics(table).count() == 1


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 16}, {"cell_rows": 16, "block_bytes": 400}, {"cell_rows": 1, "block_bytes": 100}])
def test_nearest_is_exact(spark, p, sizes):
    rng = np.random.default_rng(2)
    # A third of all rows are copies of one point.
    train = np.vstack([rng.normal(size=(120, 3)), np.tile([0.5, 0.5, 0.5], (60, 1))])
    queries = np.vstack([rng.normal(size=(40, 3)), [[0.5, 0.5, 0.5]], [[90.0, 0, 0]]])

    def frame(m):
        return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "id int, x array<double>")

    found = neighbours.nearest(frame(queries), frame(train), 8, "id", "id", "x", p, **sizes).collect()
    gap = np.abs(queries[:, None, :] - train[None, :, :])
    distance = gap.sum(axis=2) if p == 1 else np.sqrt((gap ** 2).sum(axis=2))
    assert len(found) == len(queries) * 8
    for q in range(len(queries)):
        want = sorted(range(len(train)), key=lambda t, q=q: (round(distance[q, t], 12), t))[:8]
        got = sorted((r for r in found if r.qid == q), key=lambda r: r.rank)
        assert [r.distance for r in got] == pytest.approx([distance[q, t] for t in want])
        assert [r.tid for r in got] == want


def test_clustered_queries_visit_few_cells(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 8)) * 50
    points = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(points)], "id int, x array<double>")
    stored = []

    def kept(rows):
        stored.append(materialise(rows))
        return stored[-1]

    monkeypatch.setattr(neighbours, "materialise", kept)
    found = neighbours.nearest(df.filter("id < 200"), df, 3, "id", "id", "x", cell_rows=100).collect()
    cells = stored[0].select("cell").distinct().count()
    routed = stored[-1].count()  # (query, further cell) pairs
    assert cells >= 12 and routed <= 0.2 * 200 * cells
    for q in (0, 77):
        gap = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        want = np.argsort(gap, kind="stable")[:3].tolist()
        assert [r.tid for r in sorted((r for r in found if r.qid == q), key=lambda r: r.rank)] == want


def test_nearest_with_few_rows(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "id int, x array<double>")
    assert neighbours.nearest(df, df, 5, "id", "id", "x").count() == 4
    assert neighbours.nearest(df, df.limit(0), 5, "id", "id", "x").count() == 0


def test_kernel_loss_falls_and_map_approximates(spark, ready):
    fitted = fit_kernel(ready.train, "label_t", size=64, steps=6)
    assert min(fitted.losses) < fitted.losses[0]
    assert all(b <= a * (1 + 1e-9) for a, b in zip(fitted.losses, fitted.losses[1:], strict=False))
    w, offset = FeatureMap("rbf", 2, 0.5, 20000, 1).draw()
    a, b = np.array([0.3, -0.2]), np.array([0.1, 0.7])
    za, zb = (np.sqrt(2 / 20000) * np.cos(v @ w + offset) for v in (a, b))
    assert za @ zb == pytest.approx(np.exp(-0.5 * ((a - b) ** 2).sum()), abs=0.03)
    for kernel in ("linear", "poly"):
        assert fit_kernel(ready.train, "label_t", kernel=kernel, size=64, steps=3).losses


def test_linear_kernel_reaches_the_optimum(spark):
    """No small move of the solution lowers the objective."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 2))
    y = x @ [2.0, -1.0] + 3 + rng.standard_t(2, size=80)
    df = spark.createDataFrame([([float(a) for a in r], float(t)) for r, t in zip(x, y, strict=True)], "x array<double>, y double")
    fitted = fit_kernel(df.select(array_to_vector("x").alias("features"), "y"), "y", kernel="linear", C=0.5, epsilon=0.2, tolerance=1e-7)

    def objective(w, b):
        return 0.5 * w @ w + 0.5 * np.maximum(np.abs(y - x @ w - b) - 0.2, 0).sum()

    w, b = np.array(fitted.coefficients), fitted.intercept
    assert objective(w, b) == pytest.approx(min(fitted.losses))
    for move in np.eye(3) * 0.02:
        for sign in (-1, 1):
            assert objective(w + sign * move[:2], b + sign * move[2]) > objective(w, b) * (1 - 1e-3)


def test_metrics_edge_cases(spark):
    rows = [("const", 1.0, 1.0), ("const", 1.0, 1.0), ("off", 1.0, 2.0), ("off", 1.0, 1.0), ("one", 1.0, 3.0),
            ("good", 1.0, 1.0), ("good", 3.0, 3.0)]
    df = spark.createDataFrame(rows, "Model string, True double, Predicted double")
    got = {r.Model: (r.R2, r.RMSE) for r in evaluate.metrics(df, ["Model"]).collect()}
    assert got == {"const": (1.0, 0.0), "off": (0.0, pytest.approx(0.5 ** 0.5)), "one": (None, 2.0), "good": (1.0, 0.0)}


def test_importances(spark, ready):
    table = spark.createDataFrame([("m", "t", "cat__x_2.0", 1.0), ("m", "t", "cat__x_1", 2.0), ("m", "t", "num__a_b", 1.0),
                                   ("m", "t", "cat__sex_Male", 0.0), ("z", "t", "num__a", 0.0)],
                                  "Model string, Target string, Feature string, Importance double")
    rolled = {(r.Model, r.Feature): r.Importance for r in explain.normalise(explain.collapse_levels(table)).collect()}
    assert rolled == {("m", "x"): 0.75, ("m", "a_b"): 0.25, ("m", "sex_Male"): 0.0}
    shares = explain.share_within(table, ["Model"], "Importance", "s")
    assert {r.s for r in shares.filter("Model = 'z'").collect()} == {0.0}
    top = explain.top_n(table, ["Model"], "Importance", 2)
    assert [r.Feature for r in top.filter("Model = 'm'").orderBy("rank").collect()] == ["cat__x_1", "cat__x_2.0"]
    forest = models.fit("random_forest", ready.train, ["t"], {"n_estimators": 5, "max_depth": 4})
    raw = explain.model_importances(spark, forest, ready.preprocessor.names)
    total = explain.collapse_levels(raw, bases=ready.preprocessor.bases)
    assert {r.Feature for r in total.collect()} == {"a", "b", "c"}
    assert total.agg(F.sum("Importance")).first()[0] == pytest.approx(1.0)
    assert explain.model_importances(spark, models.Fitted("KNN", "knn", ["t"]), []) is None


@pytest.mark.parametrize("bucket", [10_000, 25])
def test_permutation_ranks_features(ready, bucket):
    fitted = models.fit("linear", ready.train, ["t"])
    got = {r.Feature: r.Importance for r in explain.permutation_importance(
        fitted, ready.train, ["k"], ready.preprocessor.names, 3, bucket_rows=bucket).collect()}
    assert got["num__a"] > got["num__b"] > 0.05 > abs(got["cat__c_u"])


@pytest.mark.parametrize(("family", "params"), [("ridge", {"alpha": 2.0}), ("svr", {"size": 32, "steps": 5}), ("random_forest", {"n_estimators": 4, "max_depth": 4}),
                                                ("gradient_boosting", {"n_estimators": 4}), ("xgboost", {"n_estimators": 4, "max_depth": 3})])
def test_swapping_inside_tasks_as_row_by_row(ready, monkeypatch, family, params):
    fitted = models.fit(family, ready.train, ["t"], params)

    def run():
        rows = explain.permutation_importance(fitted, ready.test, ["k"], ready.preprocessor.names, 2, bucket_rows=20).collect()
        return {r.Feature: (r.Importance, r.Deviation) for r in rows}

    inside = run()
    monkeypatch.setattr(explain, "numpy_prediction", lambda part, width: None)
    outside = run()
    assert inside.keys() == outside.keys() == set(ready.preprocessor.names)
    for name in inside:
        assert inside[name] == pytest.approx(outside[name], rel=1e-9, abs=1e-9)


def test_permutation_for_neighbours(ready):
    fitted = models.fit("knn", ready.train, ["t"], {"n_neighbors": 5}, ["k"])
    got = explain.permutation_importance(fitted, ready.test, ["k"], ready.preprocessor.names, 2)
    assert got.count() == len(ready.preprocessor.names)


def test_search_spaces():
    points = search.grid_points(fixed.GRIDS["random_forest"])
    assert len(points) == 32 and len({json.dumps(p) for p in points}) == 32
    assert len(search.random_points(fixed.WIDE_GRIDS["ridge"], 100)) == 5
    for space in (*fixed.STUDY_SPACES.values(), *fixed.RANDOM_SPACES.values()):
        one, two = search.random_points(space, 3, 1), search.random_points(space, 3, 1)
        assert one == two
        for name, (kind, *ends) in space.items():
            for point in one:
                inside = point[name] in ends[0] if kind == "choice" else ends[0] <= point[name] <= ends[1]
                assert inside


def test_searches(ready):
    best, trials = search.grid_search(ready.train, "ridge", ["t"], {"alpha": [0.01, 1e6]}, 3, ["k"])
    assert best == {"alpha": 0.01} and trials.count() == 2
    best, _ = search.random_search(ready.train, "knn", ["t"], {"n_neighbors": ("int", 5, 9)}, 2, ["k"], n=2)
    assert 5 <= best["n_neighbors"] <= 9


def test_study_resumes_and_keeps_its_budget(spark, ready, tmp_path):
    calls = []

    def objective(point, rows):
        calls.append(point)
        return -abs(point["alpha"] - 3.0)

    store = str(tmp_path / "trials")
    space = {"alpha": ("float", 0.0, 10.0)}
    search.study(ready.train, "s", objective, space, store, trials=5, seconds=600)
    best, trials = search.study(ready.train, "s", objective, space, store, trials=10, seconds=600)
    assert len(calls) == 10 and trials.count() == 10
    assert best == min(calls, key=lambda p: abs(p["alpha"] - 3.0))
    search.study(ready.train, "s", objective, space, store, trials=20, seconds=0)
    assert len(calls) <= 11
    top = search.best_trial(trials).first()
    assert search.read_params(top.params) == best
    history = [r.best for r in search.history(trials, run=3).orderBy("trial").collect()]
    assert history == sorted(history) and history[-1] == top.value
    importance = search.parameter_importance(trials, ["alpha"]).collect()
    assert importance[0].importance == pytest.approx(1.0)


def test_cv_summary_uses_population_std(spark):
    folds = spark.createDataFrame([("m", 2, 0, "t", 0.2, 1.0, 5), ("m", 2, 1, "t", 0.4, 3.0, 5)],
                                  "Model string, CV int, fold int, Target string, R2 double, RMSE double, n long")
    r = search.cv_summary(folds).first()
    assert (r.r2_mean, r.r2_std, r.rmse_mean, r.rmse_std) == pytest.approx((0.3, 0.1, 2.0, 1.0))


def test_vectors_may_be_arrays(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id int, x array<double>")
    v = df.withColumn("x", array_to_vector("x"))
    assert v.select(neighbours.as_array(v, "x").alias("y")).first().y == [1.0, 2.0]


def test_contiguous_folds_of_other_keys(spark):
    """Keys beyond double precision, words, and missing keys."""
    large = spark.range(12).select((F.col("id") + 2**60).alias("k"))
    folds = [r.fold for r in features.assign_contiguous_fold(large.repartition(3), "k", 3).orderBy("k").collect()]
    assert folds == [0] * 4 + [1] * 4 + [2] * 4
    words = spark.createDataFrame([("a",), ("b",), (None,), ("c",), ("d",), ("e",)], "k string")
    got = {r.k: r.fold for r in features.assign_contiguous_fold(words, "k", 3).collect()}
    assert got == {None: 0, "a": 0, "b": 1, "c": 1, "d": 2, "e": 2}
    missing = spark.createDataFrame([(None,)] * 4 + [(1,), (2,)], "k int")
    assert {r.fold for r in features.assign_contiguous_fold(missing, "k", 3).filter("k is null").collect()} == {0}
    assert features.assign_contiguous_fold(words.limit(0), "k", 3).count() == 0


def test_any_number_of_levels(spark):
    df = spark.range(10_500).select(F.col("id").alias("k"), (F.col("id") % 10_001).alias("code"),
                                    (F.col("id") % 7).cast("double").alias("label_t"))
    fitted = features.fit_preprocessor(df, [], ["code"])
    assert fitted.width == 10_001 and fitted.categorical == (("code", 0, 10_001),)
    rows = fitted.transform(df, ["k", "label_t"])
    one = rows.filter("k = 10002").first().features
    assert one.size == 10_001 and one.indices.tolist() == [1] and one.values.tolist() == [1.0]
    model = models.fit("linear", rows.limit(500), ["t"])
    assert model.width == 10_001 and model.predict(rows.limit(5)).count() == 5


def test_sparse_vectors_as_one_column_per_level(spark):
    rows = [(1.0, "x", 2.0, True), (None, None, 1.0, False), (3.0, "y", 2.0, True), (4.0, "x", None, None)]
    df = spark.createDataFrame(rows, "n double, s string, code double, flag boolean")
    fitted = features.fit_preprocessor(df, ["n"], ["s", "code", "flag"])
    new = df.unionByName(spark.createDataFrame([(9.0, "unseen", 7.0, True)], df.schema))
    wide = [list(r) for r in fitted.transform_columns(new).collect()]
    assert [r.features.toArray().tolist() for r in fitted.transform(new, []).collect()] == wide
    assert models.vector_width(fitted.transform(new, [])) == len(fitted.names)


def test_models_of_another_width_are_skipped(spark, ready, tmp_path):
    narrow = ready.train.select("k", "label_t", array_to_vector(F.slice(vector_to_array("features"), 1, 2)).alias("features"))
    good = [models.fit("linear", ready.train, ["t"]), models.fit("knn", ready.train, ["t"], key=["k"])]
    bad = models.fit("ridge", narrow, ["t"])
    models.save_models(spark, [good[0], bad, good[1]], str(tmp_path / "m"))
    with pytest.warns(UserWarning, match="2 features"):
        table, status = evaluate.score_saved(spark, str(tmp_path / "m"), ready.test, ready.targets, ["k"])
    assert [r.status for r in status.orderBy("position").collect()] == ["scored", "skipped", "scored"]
    assert {r.Model for r in table.select("Model").distinct().collect()} == {"Linear Regression", "KNN"}


def test_models_that_fail_in_a_task_are_skipped_alone(spark, ready, tmp_path):
    """Predictions are lazy: the failure shows only when the model's own job runs, beside those of good ones."""
    width = models.vector_width(ready.train)
    damaged = FlatTrees(np.zeros(1, np.int32), np.zeros(1), np.full(1, 7), np.full(1, 9), np.zeros(1), np.zeros(1), np.zeros(1, np.int64), width)
    good = [models.fit("linear", ready.train, ["t"]), models.fit("ridge", ready.train, ["t"])]
    models.save_models(spark, [good[0], models.Fitted("Damaged", "xgboost", ["t"], {}, {"t": damaged}, width), good[1]], str(tmp_path / "m"))
    with pytest.warns(UserWarning, match="skipped Damaged"):
        table, status = evaluate.score_saved(spark, str(tmp_path / "m"), ready.test, ready.targets, ["k"])
    found = {r.Model: (r.status, r.reason) for r in status.collect()}
    assert {n: s for n, (s, _) in found.items()} == {"Linear Regression": "scored", "Damaged": "skipped", "Ridge Regression": "scored"}
    assert "out of bounds" in found["Damaged"][1]
    assert evaluate.metrics(table).count() == 2


def grid_effects(values):
    """Main effects and the rest of a full grid, as shares of its variance."""
    a, b, t = values.mean(axis=1).var(), values.mean(axis=0).var(), values.var()
    return a / t, b / t, 1 - (a + b) / t


def test_variance_of_a_full_grid(spark):
    rng = np.random.default_rng(6)
    values = rng.normal(size=(4, 9)) + rng.normal(size=(4, 1)) * 2
    rows = [({"word": "abcd"[i], "n": str(j + 5)}, float(values[i, j])) for i in range(4) for j in range(9)]
    trials = spark.createDataFrame(rows, "params map<string,string>, value double")
    got = {(r.param, r.other): r.share for r in search.variance_shares(trials, ["word", "n"], trees=1, bootstrap=False).collect()}
    want = grid_effects(values)
    assert (got["word", None], got["n", None], got["word", "n"]) == pytest.approx(want, abs=1e-9)
    one = search.parameter_importance(trials, ["word", "n"], trees=8).collect()
    assert sum(r.importance for r in one) == pytest.approx(1) and {r.param for r in one} == {"word", "n"}


def test_variance_of_boxes_as_by_a_fine_grid():
    """Leaves of uneven size: the decomposition of a tree equals that of its values on a fine grid."""
    rng = np.random.default_rng(8)
    feature = np.array([0, 1, 2, -1, -1, 1, -1, -1, -1], np.int32)
    flat = FlatTrees(feature, np.array([0.3, 0.6, 0.45, 0, 0, 0.2, 0, 0, 0.0]), np.array([1, 3, 5, 0, 0, 6, 0, 0, 0]), np.array([2, 4, 8, 0, 0, 7, 0, 0, 0]),
                     rng.normal(size=9), np.zeros(9), np.zeros(1, np.int64), 3)
    got = search._tree_shares(*search._boxes(flat, 0, np.zeros(3), np.ones(3)))
    at = (np.arange(20) + 0.5) / 20
    cube = flat.predict(np.stack(np.meshgrid(at, at, at, indexing="ij"), -1).reshape(-1, 3)).reshape(20, 20, 20)
    total = cube.var()
    for i in range(3):
        others = tuple(k for k in range(3) if k != i)
        assert got[i, i] == pytest.approx(cube.mean(axis=others).var() / total, abs=1e-9)
        for j in range(i + 1, 3):
            third = 3 - i - j
            pair = cube.mean(axis=third).var() / total - got[i, i] - got[j, j]
            assert got[i, j] == pytest.approx(max(pair, 0), abs=1e-9)


def test_trials_that_do_not_vary(spark):
    trials = spark.createDataFrame([({"a": str(i)}, 1.0) for i in range(5)], "params map<string,string>, value double")
    assert [(r.param, r.importance) for r in search.parameter_importance(trials, ["a"]).collect()] == [("a", 0.0)]
    assert [(r.param, r.importance) for r in search.parameter_importance(trials.limit(0), ["a"]).collect()] == [("a", 0.0)]


def test_rows_without_prediction_count_nowhere(spark):
    table = spark.createDataFrame([("m", "t", 1.0, 1.0), ("m", "t", 2.0, 3.0), ("m", "t", 5.0, None), ("m", "t", float("nan"), 1.0)],
                                  "Model string, Target string, True double, Predicted double")
    row = evaluate.metrics(table).first()
    assert (row.n, row.R2, row.RMSE) == (2, pytest.approx(-1.0), pytest.approx(0.5**0.5))
    assert evaluate.unpredicted(table).first().rows == 2


def test_row_ids_do_not_run_together(spark):
    rows = spark.createDataFrame([("a|b", "c", 1.0), ("a", "b|c", 2.0), (None, "c", 3.0), ("null", "c", 4.0)], "p string, q string, x double")
    assert rows.select(models.row_id(["p", "q"]).alias("i")).distinct().count() == 4


def test_points_that_lead_to_one_fit(spark):
    points = [{"max_depth": d, "min_samples_split": s} for d in (None, 30, 5) for s in (1, 2, 5)]
    assert models.distinct_points("random_forest", points) == [{"max_depth": 30}, {"max_depth": 30, "min_samples_split": 5}, {"max_depth": 5},
                                                               {"max_depth": 5, "min_samples_split": 5}]
    assert len(models.distinct_points("xgboost", [{"reg_alpha": 1.0, "max_depth": 3}, {"reg_alpha": 2.0, "max_depth": 3}])) == 2
    rows = spark.createDataFrame([(1.0, 2.0)], "label_t double, x double")
    with pytest.raises(ValueError, match="deeper than 30"):
        models.make_estimator("random_forest", rows, "t", {"max_depth": 31})


@pytest.mark.parametrize("family", ["linear", "ridge", "random_forest", "gradient_boosting", "xgboost", "svr"])
def test_targets_without_rows_are_refused(ready, family):
    for rows in (ready.train.limit(0), ready.train.withColumn("label_t", F.lit(None).cast("double"))):
        with pytest.raises(ValueError, match="t: no labelled rows"):
            models.fit(family, rows, ["t"], {"n_estimators": 2} if family not in ("linear", "ridge", "svr") else {}, ["k"])


def test_neighbours_without_rows_predict_null(ready):
    empty = models.fit("knn", ready.train.limit(0), ["t"], {}, ["k"])
    assert {r.prediction_t for r in empty.predict(ready.test.limit(3), ["k"]).collect()} == {None}


def test_kernel_fit_of_infinite_labels(ready):
    rows = ready.train.withColumn("label_t", F.lit(float("nan")))
    with pytest.raises(ValueError, match="finite"):
        fit_kernel(rows, "label_t", size=8, steps=3)


def test_linear_trials_share_one_reading(spark, ready, monkeypatch):
    """Trials of a linear family on the same rows score from the same sums, as fold_scores does one by one."""
    from loomstat.operators import linear_cv

    rows, read = ready.train, []
    original = linear_cv.fold_sums
    monkeypatch.setattr(linear_cv, "fold_sums", lambda *a, **kw: read.append(1) or original(*a, **kw))
    targets = ready.targets.names
    objective = search.cv_objective("ridge", targets, ["k"], k=3)
    got = [objective({"alpha": a}, rows) for a in (0.1, 10.0, 1000.0)]
    assert len(read) == 1
    want = [search.cv_score(search.fold_scores(rows, "ridge", targets, {"alpha": a}, 3, ["k"])) for a in (0.1, 10.0, 1000.0)]
    assert got == pytest.approx(want, rel=1e-12) and len(set(got)) == 3
    objective({"alpha": 1.0}, rows.limit(50))
    assert len(read) == 5  # other rows are read anew


def test_trees_are_grown_on_bounded_partitions(ready, monkeypatch):
    """The rows of a partition do not grow with the table; the same trees come out."""
    plain = models.fit("gradient_boosting", ready.train, ["t"], {"n_estimators": 2, "max_depth": 2}, ["k"])
    monkeypatch.setattr(models, "TREE_ROWS", 20)
    seen, original = [], models.make_estimator

    def estimator(family, df, *rest):
        seen.append(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
        return original(family, df, *rest)

    monkeypatch.setattr(models, "make_estimator", estimator)
    fitted = models.fit("gradient_boosting", ready.train, ["t"], {"n_estimators": 2, "max_depth": 2}, ["k"])
    assert sum(seen[0]) == ready.train.count() and len(seen[0]) >= sum(seen[0]) / 20 and max(seen[0]) <= 60
    want, got = ({r.k: r.prediction_t for r in m.predict(ready.test, ["k"]).collect()} for m in (plain, fitted))
    assert got == pytest.approx(want, rel=1e-9)


def test_variance_shares_grow_from_sums_by_setting(spark, monkeypatch):
    """A few settings are enough for the trees, however many trials there are; Spark's forest on the trials gives the same shares."""
    trials = spark.range(4000).selectExpr(
        "map('a', cast(id % 7 as string), 'b', cast(pmod(id * id, 11) as string), 'w', element_at(array('x', 'y', 'z'), cast(id % 3 + 1 as int))) as params",
        "cast((id % 7) * 2 + pmod(id * id, 11) * (id % 3) + pmod(hash(id), 5) as double) as value")

    def shares(**how):
        return {(r.param, r.other): r.share for r in search.variance_shares(trials, ["a", "b", "w"], **how).collect()}

    with monkeypatch.context() as patch:
        patch.setattr(search, "SETTINGS", 0)
        whole = shares(trees=1, bootstrap=False)
    monkeypatch.setattr(search, "RandomForestRegressor", None)
    assert shares(trees=1, bootstrap=False) == pytest.approx(whole, abs=1e-9)
    assert shares(trees=6) == pytest.approx(whole, abs=0.05)


def test_tree_search_moves_its_rows_once(spark, monkeypatch):
    """Folds lie in partitions of few rows before the fits, which then move nothing."""
    rows = spark.range(600).selectExpr("id", "cast(id % 13 as double) as a", "cast(id % 7 as double) as label_y").coalesce(1)
    rows = VectorAssembler(inputCols=["a"], outputCol="features").transform(rows).select("id", "features", "label_y")
    kind, moved = type(rows), []
    repartition = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *how: (moved.append(how), repartition(self, *how))[1])
    monkeypatch.setattr(models, "TREE_ROWS", 100)
    _, trials = search.random_search(rows, "random_forest", ["y"], {"n_estimators": [2], "max_depth": [2, 3]}, 3, ["id"], n=2)
    assert moved == [(6, "id")]
    assert trials.count() == 2


def test_kernel_pass_reads_flat_columns(spark):
    """The sums of a pass over Arrow columns are those of all rows at once."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(1300, 3)), rng.normal(size=1300)
    fmap = FeatureMap("rbf", 3, 0.2, 5, 1)
    solution = (rng.normal(size=5), 0.3)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").coalesce(1)

    class Rows:
        def mapInArrow(self, run, schema):  # noqa: N802 - as Spark calls it
            return rows.mapInArrow(run, schema)

    loss, total = kernel._pass(Rows(), fmap, 0.1, solution)
    z = fmap.function()(x)
    miss = y - z @ solution[0] - solution[1]
    above, below = np.maximum(np.abs(miss - 0.1), 1e-6), np.maximum(np.abs(miss + 0.1), 1e-6)
    weight = 0.25 / above + 0.25 / below
    target = y + (0.25 * (above - 0.1) / above + 0.25 * (0.1 - below) / below) / weight
    whole = np.hstack([np.ones((1300, 1)), z, target[:, None]])
    assert loss == pytest.approx(np.maximum(np.abs(miss) - 0.1, 0).sum())
    assert total == pytest.approx(whole.T @ (whole * weight[:, None]))


def test_random_search_covers_the_whole_space(spark, monkeypatch):
    """The registered search draws from the fixed space of forests, in the fixed number of folds."""
    asked, kind = [], model_queries.search
    monkeypatch.setattr(model_queries, "_prepared", lambda *_: type("Ready", (), {"train": None}))
    monkeypatch.setattr(kind, "random_search", lambda rows, family, targets, space, k, key, **how: (asked.append((family, space, k, how)), (None, spark.range(0)))[1])
    monkeypatch.setattr(kind, "best_trial", lambda trials: trials)
    model_queries.random_search_trees(spark, "")
    assert asked == [("random_forest", fixed.RANDOM_SPACES["random_forest"], fixed.RANDOM_FOLDS, {"n": fixed.RANDOM_DRAWS})]


def test_features_are_mapped_without_slow_cosines(monkeypatch):
    """The map is the cosine to double precision, also of many turns, and what is not finite stays so."""
    fmap, rng = FeatureMap("rbf", 3, 2.0, 17, 1), np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(150, 3)) * s for s in (1e-9, 1.0, 1e3)] + [np.zeros((1, 3))])
    weights, offset = fmap.draw()
    want = np.sqrt(2.0 / 17) * np.cos(x @ weights + offset)
    monkeypatch.setattr(np, "cos", None)
    assert fmap.function()(x) == pytest.approx(want, abs=1e-12)
    assert fmap.function()(x[:300]) == pytest.approx(want[:300], abs=1e-14)
    with np.errstate(invalid="ignore"):
        assert np.isnan(fmap.function()(np.array([[np.inf, 0.0, 0.0], [np.nan, 0.0, 0.0]]))).all()
    assert fmap.function()(x[:0]).shape == (0, 17)
