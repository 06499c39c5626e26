"""Queries that fit, score, compare and explain models."""

from __future__ import annotations

import random

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import (
    RANDOM_DRAWS,
    RANDOM_FOLDS,
    RANDOM_SPACES,
    SEED,
    STUDY_FOLDS,
    STUDY_TRIALS,
    WIDE_CV_STUDY_FOLDS,
    WIDE_DRAWS,
    WIDE_FOLDS,
    WIDE_GRIDS,
)
from ..functions import columns as names
from ..operators import combine, distribution, evaluate, explain, features, models, neighbours, search, trees
from ..session import materialise, scratch_path
from ..sources import tables as sources
from ..streaming import scoring as streaming
from .feature_queries import CHARGES_SQL, LINE_KEY, charges, hash_sql
from .tables import rounded, table

NUMERIC = ["l_extendedprice", "l_discount", "l_quantity", "p_size"]
CATEGORICAL = ["l_returnflag", "p_type"]
CV_FOLDS = [3, 5, 10, 20]
ONE_FEATURE = {"price model": "l_extendedprice", "quantity model": "l_quantity", "discount model": "l_discount"}
TARGETS = ["net", "charge"]


# Small deterministic models ----------------------------------------------------

def _with_vector(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df.drop("features"))


def _labelled(spark: SparkSession, folder: str) -> tuple[DataFrame, features.TargetTransform]:
    """Charges with split and log labels for both targets."""
    split = features.assign_split(charges(spark, folder), LINE_KEY)
    transform = features.fit_targets(split, dict.fromkeys(TARGETS, "log1p"))
    labelled = transform.transform(split).select(*LINE_KEY, "split", *ONE_FEATURE.values(),
                                                 *[f"label_{t}" for t in TARGETS])
    return materialise(labelled), transform


def one_feature_residuals(spark: SparkSession, folder: str) -> DataFrame:
    """Residuals of three one-feature linear models for two targets, on both splits."""
    rows, transform = _labelled(spark, folder)
    parts = []
    for name, column in ONE_FEATURE.items():
        vectors = _with_vector(rows, [column])
        fitted = models.fit("linear", vectors.filter("split = 'train'"), TARGETS, name=name)
        parts.append(evaluate.report(fitted, vectors, transform, [*LINE_KEY, "split"]))
    return combine.concat_rows(parts)


def _residual_sql() -> str:
    """The same residual table in SQL, as CTEs ending in ``r``."""
    fits = " UNION ALL ".join(f"""
        SELECT '{m}' AS "Model", '{t}' AS "Target", regr_slope(ln(1 + {t}), {c}) AS b,
               regr_intercept(ln(1 + {t}), {c}) AS a FROM t WHERE split = 'train'"""
                              for m, c in ONE_FEATURE.items() for t in TARGETS)
    feature = "CASE \"Model\" " + " ".join(f"WHEN '{m}' THEN {c}" for m, c in ONE_FEATURE.items()) + " END"
    return f"""WITH t AS {CHARGES_SQL}, f AS ({fits}),
        r AS (SELECT split, "Model", "Target", CASE "Target" WHEN 'net' THEN net ELSE charge END AS y,
                     exp(a + b * {feature}) - 1 AS g FROM t, f),
        m AS (SELECT split, "Model", "Target", 1 - sum((y - g) ** 2) / (count(*) * var_pop(y)) AS "R2",
                     sqrt(avg((y - g) ** 2)) AS "RMSE", count(*) AS n FROM r GROUP BY ALL)"""


RESIDUALS = _residual_sql()


def metrics_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.metrics(one_feature_residuals(spark, folder), ["split", "Model", "Target"]), 6, RMSE=3)


def metrics_wide(spark: SparkSession, folder: str) -> DataFrame:
    test = evaluate.metrics(one_feature_residuals(spark, folder).filter("split = 'test'"))
    return rounded(evaluate.wide_metrics(test, TARGETS), 4, **{f"RMSE - {t}": 3 for t in TARGETS})


def split_summary(spark: SparkSession, folder: str) -> DataFrame:
    both = one_feature_residuals(spark, folder)
    return rounded(evaluate.split_summary(evaluate.metrics(both.filter("split = 'train'")),
                                          evaluate.metrics(both.filter("split = 'test'"))), 4)


def _comparison(spark: SparkSession, folder: str) -> DataFrame:
    both = one_feature_residuals(spark, folder)
    return evaluate.compare(evaluate.metrics(both.filter("split = 'train'")),
                            evaluate.metrics(both.filter("split = 'test'")))


def metric_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_comparison(spark, folder), 6)


def plot_limits(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.plot_limits(_comparison(spark, folder)), 6)


def residual_kinds(spark: SparkSession, folder: str) -> DataFrame:
    kinds = evaluate.residual_kinds(one_feature_residuals(spark, folder))
    return rounded(kinds.groupBy("split", "Model", "Target").agg(*[
        F.avg(f"Residual_{k}").alias(k.lower()) for k in ("Original", "Log", "Relative")]), 4)


def residual_slice(spark: SparkSession, folder: str) -> DataFrame:
    """One model and target out of a residual table stored by model and target."""
    path = scratch_path(spark, "residuals")
    sources.save_table(one_feature_residuals(spark, folder), path, ["Model", "Target"])
    part = sources.load_table(spark, path).filter((F.col("Model") == "price model") & (F.col("Target") == "charge"))
    return rounded(part.groupBy("split", "Model", "Target").agg(
        F.count(F.lit(1)).alias("n"), F.min("Residual").alias("smallest"), F.max("Residual").alias("largest")), 3)


def residual_density(spark: SparkSession, folder: str) -> DataFrame:
    test = one_feature_residuals(spark, folder).filter("split = 'test'")
    return rounded(distribution.grouped_density(test, "Residual", "Target", ["Model"], 40).withColumn(
        "density", F.col("density") * 1e6).select("Target", "Model", "bin", "n", "density"), 4)


def residual_density_auto(spark: SparkSession, folder: str) -> DataFrame:
    """As :func:`residual_density` from the stored residual file with declared types, the number of bins by the automatic rule."""
    path = sources.store_csv(one_feature_residuals(spark, folder).filter("split = 'test'").select(
        "Model", "Target", "Residual", "True", "Predicted"), "residuals-csv")
    test = sources.read_csv(spark, path, sources.RESIDUALS_SCHEMA)
    return rounded(distribution.grouped_density(test, "Residual", "Target", ["Model"], "auto").withColumn(
        "density", F.col("density") * 1e6).select("Target", "Model", "bin", "n", "density"), 4)


def measure_pivot_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Measure sheet over a published view of the wide metrics file, read with its declared types, as a workbook reads it."""
    test = evaluate.metrics(one_feature_residuals(spark, folder).filter("split = 'test'"))
    path = sources.store_csv(evaluate.wide_metrics(test, TARGETS), "metrics-csv")
    sources.publish_views(spark, {"test_metrics": sources.read_csv(spark, path, sources.metrics_schema(TARGETS))})
    return rounded(evaluate.measure_sheet(spark.table("test_metrics"), "Model",
                                          [f"RMSE - {t}" for t in TARGETS]), 3)


def name_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    kind = F.when(F.col("p_type") == "PROMO", F.lit("  Linear Regression ")).otherwise(
        F.concat(F.lit(" "), F.upper("p_name")))
    return part.select(
        "p_partkey",
        names.canonical_model_name(kind).alias("model"),
        names.model_name_of_file(F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(".pkl"))).alias("file_model"),
        names.base_feature_name(F.concat(F.lit("cat__size_"), F.col("p_size"), F.lit(".0"))).alias("level_base"),
        names.base_feature_name(F.concat(F.lit("num__"), F.col("p_type"))).alias("number_base"),
        names.tuned_model_type(F.concat(F.lit("Tuned: "), F.col("p_type"), F.lit(" (CV="), F.col("p_size"), F.lit(")")))
        .alias("tuned"),
    )


# Fits on prepared vectors ------------------------------------------------------

def _prepared(spark: SparkSession, folder: str, numeric=NUMERIC, categorical=CATEGORICAL) -> features.Prepared:
    """Stored feature vectors over a stored clean table.

    Storing the vectors measured slightly faster than deriving them again, even for one fit.
    """
    clean_table = materialise(charges(spark, folder).select(*LINE_KEY, *numeric, *categorical, "charge"))
    return features.prepare(clean_table, LINE_KEY, numeric, categorical, {"charge": "log1p"}).stored()


def _split_metrics(ready: features.Prepared, fitted: models.Fitted) -> DataFrame:
    scored = evaluate.residuals(fitted.predict(ready.rows, LINE_KEY), fitted.name, ready.targets, ["split"])
    return evaluate.metrics(scored, ["split", "Model", "Target"])


def _fit_query(family: str, **params):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ready = _prepared(spark, folder)
        return rounded(_split_metrics(ready, models.fit(family, ready.train, ["charge"], params, LINE_KEY)), 6)

    return run


def ols_fit_score(spark: SparkSession, folder: str) -> DataFrame:
    """Two features, so that SQL can state the closed form."""
    ready = _prepared(spark, folder, ["l_extendedprice", "l_discount"], [])
    return rounded(_split_metrics(ready, models.fit("linear", ready.train, ["charge"])), 6, RMSE=3)


def ridge_fit(spark: SparkSession, folder: str) -> DataFrame:
    ready = _prepared(spark, folder, ["l_extendedprice", "l_discount"], [])
    return rounded(_split_metrics(ready, models.fit("ridge", ready.train, ["charge"], {"alpha": 100.0})), 6, RMSE=3)


def linear_importances(spark: SparkSession, folder: str) -> DataFrame:
    ready = _prepared(spark, folder, ["l_extendedprice", "l_discount"], [])
    fitted = models.fit("linear", ready.train, ["charge"])
    shares = explain.normalise(explain.collapse_levels(
        explain.model_importances(spark, fitted, ready.preprocessor.names)))
    return rounded(shares.orderBy(F.desc("Importance"), "Feature"))


def tree_importances(spark: SparkSession, folder: str) -> DataFrame:
    ready = _prepared(spark, folder)
    fitted = models.fit("random_forest", ready.train, ["charge"], {"n_estimators": 10, "max_depth": 6})
    raw = explain.model_importances(spark, fitted, ready.preprocessor.names)
    return rounded(explain.normalise(explain.collapse_levels(raw, bases=ready.preprocessor.bases)).orderBy(
        F.desc("Importance")), 6)


STUMP_FEATURES = ["l_discount", "l_tax"]
LEARNING_RATE = 0.1


def _stumps(spark: SparkSession, folder: str, family: str, **params) -> tuple[features.Prepared, models.Fitted]:
    """Trees of depth 1 on two features with fewer values than candidate splits, so that SQL can find the best split."""
    ready = _prepared(spark, folder, STUMP_FEATURES, [])
    return ready, models.fit(family, ready.train, ["charge"], {"max_depth": 1, **params})


def forest_stump(spark: SparkSession, folder: str) -> DataFrame:
    """A forest of one tree: every row, every feature, one split."""
    return rounded(_split_metrics(*_stumps(spark, folder, "random_forest", n_estimators=1, bootstrap=False)), 6, RMSE=3)


def boosted_stumps(spark: SparkSession, folder: str) -> DataFrame:
    """Two trees, the second fitted to what the first leaves."""
    return rounded(_split_metrics(*_stumps(spark, folder, "gradient_boosting", n_estimators=2, learning_rate=LEARNING_RATE)), 6, RMSE=3)


# Penalties of the regularised stumps.
PENALTIES = {"reg_alpha": 25.0, "reg_lambda": 500.0, "gamma": 2.0, "min_child_weight": 40}
PENALISED = {"n_estimators": 2, "learning_rate": 0.3, **PENALTIES}


def penalised_stumps(spark: SparkSession, folder: str) -> DataFrame:
    """Two boosted trees of depth 1 whose splits and leaves carry L1, L2 and gain penalties."""
    return rounded(_split_metrics(*_stumps(spark, folder, "xgboost", **PENALISED)), 6, RMSE=3)


def penalised_stump_importances(spark: SparkSession, folder: str) -> DataFrame:
    """Mean gain of the splits of each feature, as shares."""
    return _stump_importances(spark, folder, "xgboost", **{**PENALISED, "gamma": 0.0})


def permutation_r2_drop_stumps(spark: SparkSession, folder: str) -> DataFrame:
    """Fall of R² of two boosted stumps when a feature is shuffled; trees are walked inside the tasks."""
    ready, fitted = _stumps(spark, folder, "gradient_boosting", n_estimators=2, learning_rate=LEARNING_RATE)
    return rounded(explain.permutation_importance(fitted, ready.test, LINE_KEY, ready.preprocessor.names, repeats=5), 4)


def _stump_importances(spark: SparkSession, folder: str, family: str, **params) -> DataFrame:
    ready, fitted = _stumps(spark, folder, family, **params)
    raw = explain.model_importances(spark, fitted, ready.preprocessor.names)
    return rounded(explain.collapse_levels(raw, bases=ready.preprocessor.bases))


def forest_stump_importances(spark: SparkSession, folder: str) -> DataFrame:
    return _stump_importances(spark, folder, "random_forest", n_estimators=1, bootstrap=False)


def boosted_stump_importances(spark: SparkSession, folder: str) -> DataFrame:
    return _stump_importances(spark, folder, "gradient_boosting", n_estimators=2, learning_rate=LEARNING_RATE)


def permutation_r2_drop(spark: SparkSession, folder: str) -> DataFrame:
    ready = _prepared(spark, folder, ["l_extendedprice", "l_discount"], [])
    fitted = models.fit("linear", ready.train, ["charge"])
    return rounded(explain.permutation_importance(fitted, ready.test, LINE_KEY, ready.preprocessor.names,
                                                  repeats=5), 4)


def score_by_cycle(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted on line items shipped before 1999; metrics for every later year."""
    rows = charges(spark, folder).withColumn("ship_year", F.year("l_shipdate"))
    transform = features.fit_targets(rows, {"charge": "log1p"})
    vectors = _with_vector(transform.transform(rows), ["l_extendedprice"])
    fitted = models.fit("linear", vectors.filter("ship_year < 1999"), ["charge"])
    scored = evaluate.report(fitted, vectors.filter("ship_year >= 1999"), transform, ["ship_year"])
    return rounded(evaluate.metrics(scored, ["ship_year", "Model", "Target"]), 6, RMSE=3)


def score_saved_models(spark: SparkSession, folder: str) -> DataFrame:
    """Models saved with a manifest, loaded and applied to the test rows; those of other targets or another width, or that fail in a task, are skipped."""
    ready = _prepared(spark, folder, ["l_extendedprice", "l_discount"], [])
    path = scratch_path(spark, "models")
    fitted = [models.fit("linear", ready.train, ["charge"]),
              models.fit("ridge", ready.train, ["charge"], {"alpha": 100.0}),
              models.Fitted("Other Targets", "knn", ["net"], {}, {"rows": ready.test.select("l_orderkey")})]
    narrow = _with_vector(ready.train.withColumn("_one", F.lit(1.0)), ["_one"])
    fitted.append(models.fit("ridge", narrow, ["charge"], name="Other Width"))
    # A damaged tree: its root points to nodes that are not there, which only a task finds out.
    damaged = trees.FlatTrees(np.zeros(1, np.int32), np.zeros(1), np.full(1, 7), np.full(1, 9), np.zeros(1), np.zeros(1), np.zeros(1, np.int64), 2)
    fitted.append(models.Fitted("Broken Trees", "xgboost", ["charge"], {}, {"charge": damaged}, 2))
    models.save_models(spark, fitted, path)
    scored, status = evaluate.score_saved(spark, path, ready.test, ready.targets, LINE_KEY)
    result = status.drop("reason").join(evaluate.metrics(scored), "Model", "left")
    return rounded(result.drop("position"), 6, RMSE=3)


def train_report(spark: SparkSession, folder: str) -> DataFrame:
    """All seven families on both targets, on the training rows, one row per model."""
    columns = ["l_extendedprice", "l_discount"]
    table_ = materialise(charges(spark, folder).select(*LINE_KEY, *columns, *TARGETS))
    ready = features.prepare(table_, LINE_KEY, columns, [], dict.fromkeys(TARGETS, "log1p")).stored()
    rows = ready.train
    # The longest first.
    families = {"xgboost": {"n_estimators": 20, "max_depth": 4}, "svr": {"size": 32}, "knn": {}, "gradient_boosting": {"n_estimators": 20},
                "random_forest": {"n_estimators": 20, "max_depth": 6}, "linear": {}, "ridge": {"alpha": 1.0}}
    return rounded(evaluate.wide_metrics(evaluate.metrics(evaluate.fit_reports(
        families, rows, TARGETS, ready.targets, LINE_KEY)), TARGETS), 4)


def three_stage_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Baseline, default and tuned models in log space, tagged and stacked."""
    ready = features.prepare(charges(spark, folder), LINE_KEY, NUMERIC, CATEGORICAL, {"charge": "log"}, "mean", True).stored()
    train, test = ready.train, ready.test
    best, _ = search.random_search(train, "ridge", ["charge"], WIDE_GRIDS["ridge"], WIDE_FOLDS, LINE_KEY, n=WIDE_DRAWS)
    stages = {"Baseline": ("linear", {}), "Default": ("ridge", {}), "Tuned": ("ridge", best)}
    parts = []
    for stage, (family, params) in stages.items():
        name = f"{stage}: {models.DISPLAY_NAMES[family]}"
        parts.append(evaluate.report(models.fit(family, train, ["charge"], params, name=name), test, ready.targets,
                                     LINE_KEY, logged=True))
    stacked = combine.concat_rows(parts, "Stage", list(stages))
    return rounded(evaluate.metrics(stacked, ["Stage", "Model", "Target"]), 6)


def stream_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Line items streamed from their file and scored by a model of the years before 1999."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    columns = [F.year("l_shipdate").alias("ship_year"), "l_extendedprice", net.alias("net")]
    past = table(spark, folder, "lineitem").select(*columns).filter("ship_year < 1999")
    transform = features.fit_targets(past, {"net": "log1p"})
    prepared = features.fit_preprocessor(past, ["l_extendedprice"], [])
    fitted = models.fit("linear", prepared.transform(transform.transform(past), ["label_net"]), ["net"])
    schema = table(spark, folder, "lineitem").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/lineitem*.parquet").select(*columns).filter(
        "ship_year >= 1999")
    path = scratch_path(spark, "stream")
    streaming.append_to_table(streaming.score_stream(stream, prepared, fitted, transform, ["ship_year"]),
                              f"{path}/table", f"{path}/state").awaitTermination()
    scored = sources.load_table(spark, f"{path}/table")
    return rounded(evaluate.metrics(scored, ["ship_year", "Model", "Target"]), 6, RMSE=3)


# Neighbours --------------------------------------------------------------------

def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return features.assign_split(table(spark, folder, "embeddings"), ["vec_id"])


def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest training vectors of every test vector."""
    rows = _vectors(spark, folder)
    found = neighbours.nearest(rows.filter("split = 'test'"), rows.filter("split = 'train'"), 5, "vec_id", "vec_id",
                               "embedding")
    return rounded(found.drop("payload"))


def knn_topk_manhattan(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    found = neighbours.nearest(rows.filter("split = 'test'"), rows.filter("split = 'train'"), 3, "vec_id", "vec_id",
                               "embedding", p=1)
    return rounded(found.drop("payload"))


def knn_predict(spark: SparkSession, folder: str) -> DataFrame:
    """Distance-weighted label means for all vectors; training vectors find themselves at distance 0."""
    rows = _vectors(spark, folder).withColumn("label_label", F.col("label").cast("double")).withColumnRenamed(
        "embedding", "features")
    fitted = models.fit("knn", rows.filter("split = 'train'"), ["label"], {"n_neighbors": 7, "weights": "distance"},
                        ["vec_id"])
    return rounded(fitted.predict(rows, ["vec_id"]).select("vec_id", "split", "prediction_label"))


# Cross-validation and search -----------------------------------------------------

def _one_feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    transform = features.fit_targets(charges(spark, folder), {"charge": "log1p"})
    return materialise(_with_vector(transform.transform(charges(spark, folder)), ["l_extendedprice"]).select(
        *LINE_KEY, "features", "label_charge"))


def cv_summary_ols(spark: SparkSession, folder: str) -> DataFrame:
    summary = search.cv_sensitivity(_one_feature_rows(spark, folder), {"Linear Regression": ("linear", {})},
                                    ["charge"], CV_FOLDS, LINE_KEY)
    return rounded(summary)


def cv_summary_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The wider fold counts, up to 48, still from one reading."""
    return rounded(search.cv_sensitivity(_one_feature_rows(spark, folder), {"Linear Regression": ("linear", {})}, ["charge"], WIDE_CV_STUDY_FOLDS, LINE_KEY))


def cv_contiguous(spark: SparkSession, folder: str) -> DataFrame:
    """Folds that are runs of rows along a key: the price of an order by its customer's number."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("double").alias("customer"), F.log1p("o_totalprice").alias("label_price"))
    rows = _with_vector(orders, ["customer"]).select("o_orderkey", "features", "label_price")
    return rounded(search.cv_sensitivity(rows, {"Linear Regression": ("linear", {})}, ["price"], CV_FOLDS,
                                         ["o_orderkey"], order="o_orderkey"), 8)


def search_best(spark: SparkSession, folder: str) -> DataFrame:
    """Exhaustive search of the ridge penalty on two features; all trials, best first."""
    ready = _prepared(spark, folder, ["l_extendedprice", "l_discount"], [])
    _, trials = search.grid_search(ready.train, "ridge", ["charge"], WIDE_GRIDS["ridge"], 5, LINE_KEY)
    return rounded(trials.select("study", "trial", F.col("params")["alpha"].alias("alpha"), "value").orderBy(
        F.desc("value"), "trial"), 8)


def random_search_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Random draws from the whole space of forests."""
    ready = _prepared(spark, folder)
    _, trials = search.random_search(ready.train, "random_forest", ["charge"], RANDOM_SPACES["random_forest"], RANDOM_FOLDS, LINE_KEY, n=RANDOM_DRAWS)
    return rounded(search.best_trial(trials), 6)


def study_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """A study interrupted after two trials and taken up again."""
    ready = _prepared(spark, folder)
    rows = ready.train
    store = scratch_path(spark, "trials")
    space = {"alpha": ("log", 0.01, 100.0)}
    objective = search.cv_objective("ridge", ["charge"], LINE_KEY)
    for budget in (2, STUDY_TRIALS):
        _, trials = search.study(rows, "ridge", objective, space, store, trials=budget, seconds=600)
    return rounded(search.history(trials).select("study", "trial", "value", "best"), 8)


STUDY_SPACE = {"alpha": ("log", 0.01, 100.0)}


def study_two_features(spark: SparkSession, folder: str) -> DataFrame:
    """An interrupted study on two features, whose drawn penalties SQL can take up as literals."""
    rows = _prepared(spark, folder, ["l_extendedprice", "l_discount"], []).train
    store = scratch_path(spark, "trials")
    objective = search.cv_objective("ridge", ["charge"], LINE_KEY)
    for budget in (4, STUDY_TRIALS):
        _, trials = search.study(rows, "ridge", objective, STUDY_SPACE, store, trials=budget, seconds=600)
    return rounded(trials.select("study", "trial", F.col("params")["alpha"].cast("double").alias("alpha"), "value"), 8)


def _event_trials(spark: SparkSession, folder: str) -> DataFrame:
    """Events as trials: one study per user, settings from the event's properties."""
    settings = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("kind"), F.col("event_type")))
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("study"), F.col("event_id").alias("trial"), settings.alias("params"), "value")


def study_history(spark: SparkSession, folder: str) -> DataFrame:
    return search.history(_event_trials(spark, folder), run=500).select("study", "trial", "value", "best")


def study_best(spark: SparkSession, folder: str) -> DataFrame:
    return search.best_trial(_event_trials(spark, folder), keep=["params"]).select(
        "study", "trial", "value", F.col("params").getItem("k").alias("k"), F.col("params").getItem("kind").alias("kind"))


def study_parallel_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(search.parallel_coordinates(_event_trials(spark, folder)))


def _grid_trials(spark: SparkSession, folder: str) -> DataFrame:
    """A full grid of two factors: the mean value of events by kind and by the last digit of their number."""
    k = (F.get_json_object("props", "$.k").cast("int") % 10).cast("string")
    grid = table(spark, folder, "events").groupBy(F.col("event_type").alias("kind"), k.alias("digit")).agg(F.round(F.avg("value"), 6).alias("value"))
    return grid.select(F.create_map(F.lit("kind"), "kind", F.lit("digit"), "digit").alias("params"), "value")


def grid_variance_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Variance decomposition of one whole tree over a full grid: main effects and what the pair adds."""
    shares = search.variance_shares(_grid_trials(spark, folder), ["kind", "digit"], trees=1, bootstrap=False)
    return rounded(shares)


def grid_parameter_importance(spark: SparkSession, folder: str) -> DataFrame:
    """The main effects as shares of their sum."""
    trials = _grid_trials(spark, folder)
    main = search.variance_shares(trials, ["kind", "digit"], trees=1, bootstrap=False).where("other is null")
    return rounded(explain.normalise(main.withColumn("all", F.lit(1)), ["all"], "share").select("param", F.col("share").alias("importance")))


def study_parameter_importance(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(search.parameter_importance(_event_trials(spark, folder), ["k", "kind"]))


# Importances over large tables ---------------------------------------------------

def _brand_importances(spark: SparkSession, folder: str) -> DataFrame:
    rows = charges(spark, folder)
    feature = F.when(F.col("p_size").isNull(), F.concat(F.lit("num__"), F.col("p_type"))).otherwise(
        F.concat(F.lit("cat__size_"), (F.col("p_size") % 10).cast("int").cast("string"), F.lit(".0")))
    return rows.groupBy(F.col("l_returnflag").alias("Model"), feature.alias("Feature")).agg(
        F.sum("l_quantity").alias("Importance"))


def importance_rollup(spark: SparkSession, folder: str) -> DataFrame:
    collapsed = explain.collapse_levels(_brand_importances(spark, folder), ["Model"])
    return rounded(explain.normalise(collapsed, ["Model"]))


def topn_share(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 line items with the largest share of their return flag's price, per flag."""
    lines = table(spark, folder, "lineitem").select("l_returnflag", *LINE_KEY, "l_extendedprice")
    shares = explain.share_within(lines, ["l_returnflag"], "l_extendedprice", "share")
    named = shares.withColumn("Feature", F.concat_ws("|", *[F.lpad(F.col(c).cast("string"), 12, "0") for c in LINE_KEY]))
    return rounded(explain.top_n(named, ["l_returnflag"], "share", 20).select(
        "l_returnflag", "Feature", "l_extendedprice", "share", "rank"), 10)


# SQL -------------------------------------------------------------------------

def _two_feature_sql(alpha: float = 0.0) -> str:
    """Least squares on two standardised features, optionally with a ridge penalty, as CTEs ending in ``c``."""
    return f"""WITH t AS {CHARGES_SQL},
        s AS (SELECT avg(l_extendedprice) AS m1, stddev_pop(l_extendedprice) AS s1, avg(l_discount) AS m2,
                     stddev_pop(l_discount) AS s2, count(*) AS n FROM t WHERE split = 'train'),
        z AS (SELECT t.*, (l_extendedprice - m1) / s1 AS z1, (l_discount - m2) / s2 AS z2, ln(1 + charge) AS y
              FROM t, s),
        v AS (SELECT avg(y) AS my, avg(z1) AS mz1, avg(z2) AS mz2, var_pop(z1) + {alpha} / count(*) AS v1,
                     var_pop(z2) + {alpha} / count(*) AS v2, covar_pop(z1, z2) AS c12, covar_pop(z1, y) AS c1,
                     covar_pop(z2, y) AS c2 FROM z WHERE split = 'train'),
        c AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1,
                     (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM v)"""


def _two_feature_metrics(model: str, alpha: float = 0.0, split: str = "split, ") -> str:
    return _two_feature_sql(alpha) + f""",
        p AS (SELECT split, charge AS t, exp(my + b1 * (z1 - mz1) + b2 * (z2 - mz2)) - 1 AS g FROM z, c)
        SELECT {split}'{model}' AS "Model", 'charge' AS "Target",
               round(1 - sum((t - g) ** 2) / (count(*) * var_pop(t)), 6) AS "R2",
               round(sqrt(avg((t - g) ** 2)), 3) AS "RMSE", count(*) AS n FROM p"""


def _cv_sql(ks: list[int]) -> str:
    fold = hash_sql("l_orderkey, l_partkey, l_suppkey, l_linenumber", "fold42")
    parts = []
    for k in ks:
        parts.append(f"""
        SELECT "CV", round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_std, round(avg(rmse), 6) AS rmse_mean,
               round(stddev_pop(rmse), 6) AS rmse_std FROM (
          SELECT {k} AS "CV", t.fold, 1 - sum((y - a - b * x) ** 2) / (count(*) * var_pop(y)) AS r2,
                 sqrt(avg((y - a - b * x) ** 2)) AS rmse
          FROM (SELECT {fold} % {k} AS fold, x, y FROM d) t
          JOIN (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a
                FROM (SELECT {fold} % {k} AS fold, x, y FROM d) o JOIN (SELECT unnest(range({k})) AS fold) f
                  ON o.fold <> f.fold GROUP BY 1) m ON t.fold = m.fold
          GROUP BY 1, 2) GROUP BY 1""")
    return f"""WITH d AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS x, ln(1 + charge) AS y
                          FROM {CHARGES_SQL})
        SELECT 'Linear Regression' AS "Model", * FROM ({" UNION ALL ".join(parts)})"""


def _stump_sql(label: str, source: str, name: str) -> str:
    """The best split of ``label`` over the training rows of ``source``: CTEs ending in one row ``name`` (f, v, low, high)."""
    values = " UNION ALL ".join(f"SELECT '{c}' AS f, {c} AS v, count(*) AS n, sum({label}) AS s FROM {source} WHERE split = 'train' GROUP BY 2"
                                for c in STUMP_FEATURES)
    return f"""{name}u AS ({values}),
        {name}c AS (SELECT f, v, sum(n) OVER w AS cn, sum(s) OVER w AS cs, sum(n) OVER (PARTITION BY f) AS tn, sum(s) OVER (PARTITION BY f) AS ts
              FROM {name}u WINDOW w AS (PARTITION BY f ORDER BY v)),
        {name} AS (SELECT f, v, cs / cn AS low, (ts - cs) / (tn - cn) AS high,
                     cs * cs / cn + (ts - cs) * (ts - cs) / (tn - cn) - ts * ts / tn AS won FROM {name}c WHERE cn < tn
              ORDER BY cs * cs / cn + (ts - cs) * (ts - cs) / (tn - cn) DESC LIMIT 1)"""


def _stump_value(name: str, swapped: str = "") -> str:
    """What stump ``name`` gives a row; the column ``swapped`` is taken from ``other_`` + its name."""
    value = " ".join(f"WHEN {name}.f = '{c}' THEN {'other_' * (c == swapped)}{c}" for c in STUMP_FEATURES)
    return f"CASE WHEN CASE {value} END <= {name}.v THEN {name}.low ELSE {name}.high END"


def _stumps_sql(trees: int) -> str:
    """One stump, or a second one on twice the remaining error (the gradient of the squared error)."""
    first = f"""WITH t AS (SELECT *, ln(1 + charge) AS y FROM {CHARGES_SQL}), {_stump_sql("y", "t", "a")},
        p AS (SELECT t.*, {_stump_value("a")} AS p1 FROM t, a)"""
    if trees == 1:
        return first + ", o AS (SELECT *, p1 AS p FROM p)"
    return first + f""", {_stump_sql("2 * (y - p1)", "p", "b")},
        o AS (SELECT p.*, p1 + {LEARNING_RATE}::DOUBLE * {_stump_value("b")} AS p FROM p, b)"""


def _penalised_stump_sql(source: str, name: str, gamma: float) -> str:
    """The best penalised split by gradients p - y of ``source``: CTEs ending in one row ``name`` (f, v, low, high, won)."""
    alpha, ridge, least, rate = PENALTIES["reg_alpha"], PENALTIES["reg_lambda"], PENALTIES["min_child_weight"], PENALISED["learning_rate"]
    score = lambda g, h: f"(greatest(abs({g}) - {alpha}::DOUBLE, 0) ** 2 / ({h} + {ridge}::DOUBLE))"
    leaf = lambda g, h: f"(-sign({g}) * greatest(abs({g}) - {alpha}::DOUBLE, 0) / ({h} + {ridge}::DOUBLE) * {rate}::DOUBLE)"
    values = " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS f, {c} AS v, count(*) AS n, sum(p - y) AS g FROM {source} WHERE split = 'train' GROUP BY 3"
                                for i, c in enumerate(STUMP_FEATURES))
    return f"""{name}u AS ({values}),
        {name}c AS (SELECT i, f, v, sum(n) OVER w AS cn, sum(g) OVER w AS cg, sum(n) OVER (PARTITION BY f) AS tn, sum(g) OVER (PARTITION BY f) AS tg
              FROM {name}u WINDOW w AS (PARTITION BY f ORDER BY v)),
        {name}w AS (SELECT *, CASE WHEN cn >= {least} AND tn - cn >= {least} THEN
                     {score("cg", "cn")} + {score("(tg - cg)", "(tn - cn)")} - {score("tg", "tn")} END AS gain FROM {name}c WHERE cn < tn),
        {name} AS (SELECT f, v, CASE WHEN gain > 1e-12 AND gain >= {gamma} THEN {leaf("cg", "cn")} ELSE {leaf("tg", "tn")} END AS low,
                     CASE WHEN gain > 1e-12 AND gain >= {gamma} THEN {leaf("(tg - cg)", "(tn - cn)")} ELSE {leaf("tg", "tn")} END AS high,
                     CASE WHEN gain > 1e-12 AND gain >= {gamma} THEN gain ELSE 0 END AS won
              FROM {name}w ORDER BY gain DESC NULLS LAST, i, v LIMIT 1)"""


def _penalised_sql(gamma: float) -> str:
    """Two penalised stumps from the mean label, as CTEs ending in ``o`` with predictions ``p``."""
    return f"""WITH t AS (SELECT *, ln(1 + charge) AS y FROM {CHARGES_SQL}),
        z AS (SELECT *, (SELECT avg(y) FROM t WHERE split = 'train') AS p FROM t), {_penalised_stump_sql("z", "a", gamma)},
        q AS (SELECT z.* EXCLUDE (p), p + {_stump_value("a")} AS p FROM z, a), {_penalised_stump_sql("q", "b", gamma)},
        o AS (SELECT q.* EXCLUDE (p), p + {_stump_value("b")} AS p FROM q, b)"""


def _penalised_importance_sql() -> str:
    listed = ", ".join(f"('{c}')" for c in STUMP_FEATURES)
    return _penalised_sql(0.0) + f""", g AS (SELECT f, avg(won) AS won FROM (SELECT f, won FROM a UNION ALL SELECT f, won FROM b) WHERE won > 0 GROUP BY 1)
        SELECT 'XGBoost' AS "Model", 'charge' AS "Target", c AS "Feature",
               round(coalesce((SELECT won FROM g WHERE f = c) / (SELECT sum(won) FROM g), 0), 6) AS "Importance"
        FROM (VALUES {listed}) x(c)"""


def _stump_permutation_sql() -> str:
    """The fall of R² when one feature comes from the next row of its bucket, averaged over five repeats."""
    order = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
    guess = lambda swapped: f"{_stump_value('a', swapped)} + {LEARNING_RATE}::DOUBLE * {_stump_value('b', swapped)}"
    other = ", ".join(f"coalesce(lead({c}) OVER w, first_value({c}) OVER u) AS other_{c}" for c in STUMP_FEATURES)
    r2 = lambda swapped: f"1 - sum((y - ({guess(swapped)})) ** 2) / (count(*) * var_pop(y))"
    falls = ", ".join(f"{r2(c)} AS r_{c}" for c in STUMP_FEATURES)
    rows = " UNION ALL ".join(f"""
        SELECT 'Gradient Boosting' AS "Model", 'charge' AS "Target", 'num__{c}' AS "Feature", round(avg(r - r_{c}), 4) + 0.0 AS "Importance",
               round(stddev_pop(r - r_{c}), 4) + 0.0 AS "Deviation" FROM k""" for c in STUMP_FEATURES)
    return _stumps_sql(2) + f""",
        e AS (SELECT o.*, (SELECT CAST(ceil(count(*) / 10000.0) AS BIGINT) FROM o WHERE split = 'test') AS nb FROM o WHERE split = 'test'),
        d AS (SELECT e.*, rep, {hash_sql(order + ", rep", "perm42")} AS h FROM e, (SELECT unnest(range(1, 6)) AS rep)),
        s AS (SELECT *, {other} FROM d
              WINDOW w AS (PARTITION BY rep, h % nb ORDER BY h, {order}),
                     u AS (PARTITION BY rep, h % nb ORDER BY h, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        k AS (SELECT rep, {r2("")} AS r, {falls} FROM s, a, b GROUP BY 1) {rows}"""


def _stump_metrics_sql(model: str, trees: int) -> str:
    return _split_metrics_sql(_stumps_sql(trees), model)


def _split_metrics_sql(rows: str, model: str) -> str:
    return rows + f"""
        SELECT split, '{model}' AS "Model", 'charge' AS "Target",
               round(1 - sum((charge - exp(p) + 1) ** 2) / (count(*) * var_pop(charge)), 6) AS "R2",
               round(sqrt(avg((charge - exp(p) + 1) ** 2)), 3) AS "RMSE", count(*) AS n FROM o GROUP BY 1"""


def _stump_importance_sql(model: str, trees: int) -> str:
    used = " UNION ALL ".join(f"SELECT f, won FROM {n}" for n in "ab"[:trees])
    listed = ", ".join(f"('{c}')" for c in STUMP_FEATURES)
    return _stumps_sql(trees) + f""", g AS ({used})
        SELECT '{model}' AS "Model", 'charge' AS "Target", c AS "Feature",
               round(coalesce((SELECT sum(won) FROM g WHERE f = c), 0) / (SELECT sum(won) FROM g), 6) AS "Importance"
        FROM (VALUES {listed}) x(c)"""


def _grid_sql() -> str:
    """Variances of the row means, of the column means and of all cells of a full grid, as a CTE ``v`` (a, b, t)."""
    return """WITH c AS (SELECT event_type AS kind, (props->>'$.k')::INT % 10 AS digit, round(avg(value), 6) AS y FROM events GROUP BY 1, 2),
        v AS (SELECT (SELECT var_pop(m) FROM (SELECT avg(y) AS m FROM c GROUP BY kind)) AS a,
                     (SELECT var_pop(m) FROM (SELECT avg(y) AS m FROM c GROUP BY digit)) AS b, (SELECT var_pop(y) FROM c) AS t)"""


def _contiguous_sql(ks: list[int]) -> str:
    parts = [f"""
        SELECT "CV", round(avg(r2), 8) AS r2_mean, round(stddev_pop(r2), 8) AS r2_std, round(avg(rmse), 8) AS rmse_mean,
               round(stddev_pop(rmse), 8) AS rmse_std FROM (
          SELECT {k} AS "CV", t.fold, 1 - sum((y - a - b * x) ** 2) / (count(*) * var_pop(y)) AS r2, sqrt(avg((y - a - b * x) ** 2)) AS rmse
          FROM (SELECT ntile({k}) OVER (ORDER BY o_orderkey) AS fold, x, y FROM d) t
          JOIN (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a
                FROM (SELECT ntile({k}) OVER (ORDER BY o_orderkey) AS fold, x, y FROM d) o
                JOIN (SELECT unnest(range(1, {k} + 1)) AS fold) f ON o.fold <> f.fold GROUP BY 1) m ON t.fold = m.fold
          GROUP BY 1, 2) GROUP BY 1""" for k in ks]
    return f"""WITH d AS (SELECT o_orderkey, o_custkey::DOUBLE AS x, ln(1 + o_totalprice) AS y FROM orders)
        SELECT 'Linear Regression' AS "Model", * FROM ({" UNION ALL ".join(parts)})"""


def _study_sql() -> str:
    drawn = [search.draw(STUDY_SPACE, random.Random(f"{SEED}/ridge/{t}"))["alpha"] for t in range(STUDY_TRIALS)]
    return f"""SELECT 'ridge' AS study, trial, round(alpha::DOUBLE, 8) AS alpha, value FROM ({_search_sql(drawn, STUDY_FOLDS)})"""


def _search_sql(alphas: list[float], k: int) -> str:
    """Cross-validated ridge on two standardised features for every penalty."""
    fold = hash_sql("l_orderkey, l_partkey, l_suppkey, l_linenumber", "fold42")
    listed = ", ".join(f"({i}, '{a}', {a}::DOUBLE)" for i, a in enumerate(alphas))
    return f"""WITH t AS (SELECT * FROM {CHARGES_SQL} WHERE split = 'train'),
        s AS (SELECT avg(l_extendedprice) AS m1, stddev_pop(l_extendedprice) AS s1, avg(l_discount) AS m2,
                     stddev_pop(l_discount) AS s2 FROM t),
        z AS (SELECT {fold} % {k} AS fold, (l_extendedprice - m1) / s1 AS z1, (l_discount - m2) / s2 AS z2,
                     ln(1 + charge) AS y FROM t, s),
        v AS (SELECT f.fold, avg(y) AS my, avg(z1) AS mz1, avg(z2) AS mz2, var_pop(z1) AS v1, var_pop(z2) AS v2,
                     covar_pop(z1, z2) AS c12, covar_pop(z1, y) AS c1, covar_pop(z2, y) AS c2, count(*) AS n
              FROM z JOIN (SELECT unnest(range({k})) AS fold) f ON z.fold <> f.fold GROUP BY 1),
        p AS (SELECT v.*, trial, alpha, v1 + a / n AS w1, v2 + a / n AS w2
              FROM v, (VALUES {listed}) g(trial, alpha, a)),
        b AS (SELECT *, (c1 * w2 - c2 * c12) / (w1 * w2 - c12 * c12) AS b1,
                     (c2 * w1 - c1 * c12) / (w1 * w2 - c12 * c12) AS b2 FROM p),
        r AS (SELECT trial, alpha, z.fold,
                     1 - sum((y - my - b1 * (z1 - mz1) - b2 * (z2 - mz2)) ** 2) / (count(*) * var_pop(y)) AS r2
              FROM z JOIN b ON z.fold = b.fold GROUP BY 1, 2, 3)
        SELECT 'Ridge Regression' AS study, CAST(trial AS INT) AS trial, alpha, round(avg(r2), 8) AS value FROM r
        GROUP BY 1, 2, 3"""


def _knn_sql(k: int, distance: str) -> str:
    return f"""
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e,
                          {hash_sql("vec_id", "42")} / 4294967296.0::DOUBLE < 0.2 AS test FROM embeddings),
        d AS (SELECT q.vec_id AS qid, t.vec_id AS tid, {distance} AS distance
              FROM v q, v t WHERE q.test AND NOT t.test)
        SELECT qid, tid, round(distance, 6) AS distance,
               CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, tid) AS INT) AS rank
        FROM d QUALIFY rank <= {k}"""


_COMPARED = RESIDUALS + """,
        l AS (SELECT split, "Model", "Target", metric, value FROM m UNPIVOT (value FOR metric IN ("R2", "RMSE"))),
        s AS (SELECT split, "Model", "Target", metric, CASE metric WHEN 'RMSE' THEN
                value / max(value) OVER (PARTITION BY split, "Target", metric) ELSE value END AS value FROM l),
        a AS (SELECT * FROM s UNION ALL SELECT split, "Model", 'Mean', metric, avg(value) FROM s GROUP BY 1, 2, 4),
        x AS (SELECT "Model", "Target", metric, max(value) FILTER (split = 'train') AS "Train",
                     max(value) FILTER (split = 'test') AS "Test" FROM a GROUP BY 1, 2, 3)"""

QUERIES = {
    "metrics_by_model": (metrics_by_model, RESIDUALS + """
        SELECT split, "Model", "Target", round("R2", 6) + 0.0 AS "R2", round("RMSE", 3) AS "RMSE", n FROM m"""),
    "metrics_wide": (metrics_wide, RESIDUALS + """
        SELECT "Model", """ + ", ".join(f"""round(max("{m}") FILTER ("Target" = '{t}'), {d}) + 0.0 AS "{m} - {t}" """
                                        for m, d in (("R2", 4), ("RMSE", 3)) for t in TARGETS) + """
        FROM m WHERE split = 'test' GROUP BY 1"""),
    "split_summary": (split_summary, RESIDUALS + """
        SELECT "Model", "Target", """ + ", ".join(
        f"""round(max("{m}") FILTER (split = '{s}'), 4) + 0.0 AS "{s}_{m}" """
        for s in ("train", "test") for m in ("R2", "RMSE")) + """ FROM m GROUP BY 1, 2"""),
    "metric_comparison": (metric_comparison, _COMPARED + """
        SELECT "Model", "Target", metric, round("Train", 6) + 0.0 AS "Train", round("Test", 6) + 0.0 AS "Test" FROM x"""),
    "plot_limits": (plot_limits, _COMPARED + """
        SELECT metric, round(least(min("Train"), min("Test")), 6) + 0.0 AS low,
               round(greatest(max("Train"), max("Test")), 6) + 0.0 AS high FROM x GROUP BY 1"""),
    "residual_kinds": (residual_kinds, RESIDUALS + """
        SELECT split, "Model", "Target", round(avg(y - g), 4) + 0.0 AS original, round(avg(ln(y) - ln(g)), 4) + 0.0 AS log,
               round(avg((y - g) / y), 4) + 0.0 AS relative FROM r GROUP BY 1, 2, 3"""),
    "residual_slice": (residual_slice, RESIDUALS + """
        SELECT split, "Model", "Target", count(*) AS n, round(min(y - g), 3) AS smallest, round(max(y - g), 3) AS largest
        FROM r WHERE "Model" = 'price model' AND "Target" = 'charge' GROUP BY 1, 2, 3"""),
    "residual_density": (residual_density, RESIDUALS + """,
        e AS (SELECT "Target", min(y - g) AS lo, (max(y - g) - min(y - g)) / 40 AS w FROM r WHERE split = 'test' GROUP BY 1),
        h AS (SELECT "Target", "Model", CAST(least(floor((y - g - lo) / w), 39) AS INT) AS bin, count(*) AS n
              FROM r JOIN e USING ("Target") WHERE split = 'test' GROUP BY 1, 2, 3),
        b AS (SELECT DISTINCT "Target", "Model", unnest(range(40))::INT AS bin FROM h),
        k AS (SELECT b.*, coalesce(h.n, 0) AS n FROM b LEFT JOIN h USING ("Target", "Model", bin))
        SELECT "Target", "Model", bin, n,
               round(n / (sum(n) OVER (PARTITION BY "Target", "Model") * w) * 1e6, 4) AS density
        FROM k JOIN e USING ("Target")"""),
    "residual_density_auto": (residual_density_auto, RESIDUALS + """,
        q AS (SELECT "Target", min(y - g) AS lo, max(y - g) AS hi, count(*) AS c,
                     quantile_cont(y - g, 0.75) - quantile_cont(y - g, 0.25) AS iqr FROM r WHERE split = 'test' GROUP BY 1),
        u AS (SELECT *, least(2 * iqr / pow(c, 1.0 / 3), (hi - lo) / (log2(c) + 1)) AS rule FROM q),
        e AS (SELECT "Target", lo, CAST(ceil((hi - lo) / rule) AS BIGINT) AS bins, (hi - lo) / ceil((hi - lo) / rule) AS w FROM u),
        h AS (SELECT "Target", "Model", CAST(least(floor((y - g - lo) / w), bins - 1) AS INT) AS bin, count(*) AS n
              FROM r JOIN e USING ("Target") WHERE split = 'test' GROUP BY 1, 2, 3),
        b AS (SELECT "Target", "Model", unnest(range(bins))::INT AS bin FROM (SELECT DISTINCT "Target", "Model" FROM h) JOIN e USING ("Target")),
        k AS (SELECT b.*, coalesce(h.n, 0) AS n FROM b LEFT JOIN h USING ("Target", "Model", bin))
        SELECT "Target", "Model", bin, n,
               round(n / (sum(n) OVER (PARTITION BY "Target", "Model") * w) * 1e6, 4) AS density
        FROM k JOIN e USING ("Target")"""),
    "measure_pivot_sum": (measure_pivot_sum, RESIDUALS + """
        SELECT "Model", 'RMSE - ' || "Target" AS measure, round(sum("RMSE"), 3) AS total FROM m WHERE split = 'test'
        GROUP BY 1, 2"""),
    "name_cleanup": (name_cleanup, """
        SELECT p_partkey,
               CASE WHEN p_type = 'PROMO' THEN 'Baseline Linear Model' ELSE array_to_string(list_transform(
                 string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS model,
               array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS file_model,
               'size' AS level_base, p_type AS number_base, 'Tuned: ' || p_type AS tuned FROM part"""),
    "ols_fit_score": (ols_fit_score, _two_feature_metrics("Linear Regression") + " GROUP BY split"),
    "ridge_fit": (ridge_fit, _two_feature_metrics("Ridge Regression", 100.0) + " GROUP BY split"),
    "rf_fit": (_fit_query("random_forest", n_estimators=50, max_depth=6), None),
    "gbt_fit": (_fit_query("gradient_boosting", n_estimators=50), None),
    "gbt_regularised_fit": (_fit_query("xgboost", n_estimators=100, max_depth=4, gamma=0.5, min_child_weight=5,
                                       subsample=0.8, colsample_bytree=0.8, reg_alpha=1.0, reg_lambda=5.0), None),
    "svr_rff_fit": (_fit_query("svr", C=1.0, epsilon=0.1), None),
    "linear_importances": (linear_importances, _two_feature_sql() + """
        SELECT 'Linear Regression' AS "Model", 'charge' AS "Target", 'l_extendedprice' AS "Feature",
               round(abs(b1) / (abs(b1) + abs(b2)), 6) AS "Importance" FROM c
        UNION ALL SELECT 'Linear Regression', 'charge', 'l_discount', round(abs(b2) / (abs(b1) + abs(b2)), 6) FROM c"""),
    "tree_importances": (tree_importances, None),
    "forest_stump": (forest_stump, _stump_metrics_sql("Random Forest", 1)),
    "boosted_stumps": (boosted_stumps, _stump_metrics_sql("Gradient Boosting", 2)),
    "forest_stump_importances": (forest_stump_importances, _stump_importance_sql("Random Forest", 1)),
    "boosted_stump_importances": (boosted_stump_importances, _stump_importance_sql("Gradient Boosting", 2)),
    "penalised_stumps": (penalised_stumps, _split_metrics_sql(_penalised_sql(PENALTIES["gamma"]), "XGBoost")),
    "penalised_stump_importances": (penalised_stump_importances, _penalised_importance_sql()),
    "permutation_r2_drop_stumps": (permutation_r2_drop_stumps, _stump_permutation_sql()),
    "permutation_r2_drop": (permutation_r2_drop, _two_feature_sql() + f""",
        e AS (SELECT z.*, c.*, (SELECT CAST(ceil(count(*) / 10000.0) AS BIGINT) FROM z WHERE split = 'test') AS nb
              FROM z, c WHERE split = 'test'),
        d AS (SELECT e.*, rep, {hash_sql("l_orderkey, l_partkey, l_suppkey, l_linenumber, rep", "perm42")} AS h
              FROM e, (SELECT unnest(range(1, 6)) AS rep)),
        o AS (SELECT *, coalesce(lead(z1) OVER w, first_value(z1) OVER u) AS o1,
                     coalesce(lead(z2) OVER w, first_value(z2) OVER u) AS o2 FROM d
              WINDOW w AS (PARTITION BY rep, h % nb ORDER BY h, l_orderkey, l_partkey, l_suppkey, l_linenumber),
                     u AS (PARTITION BY rep, h % nb ORDER BY h, l_orderkey, l_partkey, l_suppkey, l_linenumber
                           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        q AS (SELECT rep, 1 - sum((y - my - b1 * (z1 - mz1) - b2 * (z2 - mz2)) ** 2) / (count(*) * var_pop(y)) AS r,
                     1 - sum((y - my - b1 * (o1 - mz1) - b2 * (z2 - mz2)) ** 2) / (count(*) * var_pop(y)) AS r1,
                     1 - sum((y - my - b1 * (z1 - mz1) - b2 * (o2 - mz2)) ** 2) / (count(*) * var_pop(y)) AS r2
              FROM o GROUP BY 1)
        SELECT 'Linear Regression' AS "Model", 'charge' AS "Target", 'num__l_extendedprice' AS "Feature",
               round(avg(r - r1), 4) + 0.0 AS "Importance", round(stddev_pop(r - r1), 4) + 0.0 AS "Deviation" FROM q
        UNION ALL SELECT 'Linear Regression', 'charge', 'num__l_discount', round(avg(r - r2), 4) + 0.0,
               round(stddev_pop(r - r2), 4) + 0.0 FROM q"""),
    "score_by_cycle": (score_by_cycle, f"""
        WITH t AS (SELECT CAST(year(l_shipdate) AS INT) AS ship_year, charge, ln(1 + charge) AS y, l_extendedprice AS x
                   FROM {CHARGES_SQL}),
        f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t WHERE ship_year < 1999),
        p AS (SELECT ship_year, charge AS t, exp(a + b * x) - 1 AS g FROM t, f WHERE ship_year >= 1999)
        SELECT ship_year, 'Linear Regression' AS "Model", 'charge' AS "Target",
               round(1 - sum((t - g) ** 2) / (count(*) * var_pop(t)), 6) AS "R2",
               round(sqrt(avg((t - g) ** 2)), 3) AS "RMSE", count(*) AS n FROM p GROUP BY 1"""),
    "stream_scoring": (stream_scoring, """
        WITH t AS (SELECT CAST(year(l_shipdate) AS INT) AS ship_year, l_extendedprice * (1 - l_discount) AS net,
                          ln(1 + l_extendedprice * (1 - l_discount)) AS y, l_extendedprice AS x FROM lineitem),
        f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t WHERE ship_year < 1999),
        p AS (SELECT ship_year, net AS t, exp(a + b * x) - 1 AS g FROM t, f WHERE ship_year >= 1999)
        SELECT ship_year, 'Linear Regression' AS "Model", 'net' AS "Target",
               round(1 - sum((t - g) ** 2) / (count(*) * var_pop(t)), 6) AS "R2",
               round(sqrt(avg((t - g) ** 2)), 3) AS "RMSE", count(*) AS n FROM p GROUP BY 1"""),
    "score_saved_models": (score_saved_models, " UNION ALL ".join(
        f"SELECT *, 'scored' AS status FROM ({_two_feature_metrics(m, a, '')} WHERE split = 'test')"
        for m, a in (("Linear Regression", 0.0), ("Ridge Regression", 100.0))) + """
        UNION ALL SELECT unnest(['Other Targets', 'Other Width', 'Broken Trees']), NULL, NULL, NULL, NULL, 'skipped'"""),
    "train_report": (train_report, None),
    "three_stage_comparison": (three_stage_comparison, None),
    "knn_topk": (knn_topk, _knn_sql(5, "list_distance(q.e, t.e)")),
    "knn_topk_manhattan": (knn_topk_manhattan, _knn_sql(
        3, "list_sum(list_transform(list_zip(q.e, t.e), lambda p: abs(p[1] - p[2])))")),
    "knn_predict": (knn_predict, f"""
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label::DOUBLE AS label,
                          {hash_sql("vec_id", "42")} / 4294967296.0::DOUBLE < 0.2 AS test FROM embeddings),
        d AS (SELECT q.vec_id, q.test, t.vec_id AS tid, t.label, list_distance(q.e, t.e) AS d FROM v q, v t WHERE NOT t.test),
        n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, tid::VARCHAR) AS rank FROM d QUALIFY rank <= 7)
        SELECT vec_id, CASE WHEN any_value(test) THEN 'test' ELSE 'train' END AS split,
               round(coalesce(avg(label) FILTER (d = 0), sum(label / nullif(d, 0)) / sum(1 / nullif(d, 0))), 6)
                 AS prediction_label FROM n GROUP BY 1"""),
    "cv_summary_ols": (cv_summary_ols, _cv_sql(CV_FOLDS)),
    "cv_summary_wide": (cv_summary_wide, _cv_sql(WIDE_CV_STUDY_FOLDS)),
    "cv_contiguous": (cv_contiguous, _contiguous_sql(CV_FOLDS)),
    "search_best": (search_best, _search_sql(WIDE_GRIDS["ridge"]["alpha"], 5)),
    "random_search_trees": (random_search_trees, None),
    "study_resumed": (study_resumed, None),
    "study_two_features": (study_two_features, _study_sql()),
    "study_history": (study_history, """
        SELECT user_id::VARCHAR AS study, event_id AS trial, value,
               max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM events"""),
    "study_best": (study_best, """
        SELECT user_id::VARCHAR AS study, event_id AS trial, value, props->>'$.k' AS k, event_type AS kind FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1"""),
    "study_parallel_coordinates": (study_parallel_coordinates, """
        WITH l AS (SELECT user_id::VARCHAR AS study, event_id AS trial, 'k' AS param, props->>'$.k' AS setting, value
                   FROM events UNION ALL SELECT user_id::VARCHAR, event_id, 'kind', event_type, value FROM events),
        x AS (SELECT *, TRY_CAST(setting AS DOUBLE) AS v FROM l)
        SELECT study, trial, param, setting, value, round((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 6)
               AS scaled FROM x WINDOW w AS (PARTITION BY study, param)"""),
    "study_parameter_importance": (study_parameter_importance, None),
    "grid_variance_shares": (grid_variance_shares, _grid_sql() + """
        SELECT 'kind' AS param, NULL::VARCHAR AS other, round(a / t, 6) AS share FROM v UNION ALL SELECT 'digit', NULL, round(b / t, 6) FROM v
        UNION ALL SELECT 'kind', 'digit', round(1 - (a + b) / t, 6) FROM v"""),
    "grid_parameter_importance": (grid_parameter_importance, _grid_sql() + """
        SELECT 'kind' AS param, round(a / (a + b), 6) AS importance FROM v UNION ALL SELECT 'digit', round(b / (a + b), 6) FROM v"""),
    "importance_rollup": (importance_rollup, f"""
        WITH t AS {CHARGES_SQL},
        f AS (SELECT l_returnflag AS "Model", CASE WHEN p_size IS NULL THEN p_type ELSE 'size' END AS "Feature",
                     sum(l_quantity) AS v FROM t GROUP BY 1, 2)
        SELECT "Model", "Feature", round(v / sum(v) OVER (PARTITION BY "Model"), 6) AS "Importance" FROM f"""),
    "topn_share": (topn_share, """
        WITH t AS (SELECT l_returnflag, concat_ws('|', lpad(l_orderkey::VARCHAR, 12, '0'), lpad(l_partkey::VARCHAR, 12, '0'),
                     lpad(l_suppkey::VARCHAR, 12, '0'), lpad(l_linenumber::VARCHAR, 12, '0')) AS "Feature",
                     l_extendedprice, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_returnflag) AS share
                   FROM lineitem)
        SELECT l_returnflag, "Feature", l_extendedprice, round(share, 10) AS share, CAST(row_number() OVER (
                 PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, "Feature") AS INT) AS rank
        FROM t QUALIFY rank <= 20"""),
}
