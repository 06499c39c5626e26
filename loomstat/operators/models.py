"""Regressor families with one independent regressor per target."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import SEED
from ..session import materialise
from ..sources.tables import load_metadata, save_metadata
from . import trees
from .kernel import FeatureMap, KernelModel, fit_kernel
from .neighbours import nearest, neighbour_mean
from .trees import FlatTrees, Growth

FAMILIES = ("linear", "ridge", "random_forest", "gradient_boosting", "xgboost", "knn", "svr")

# Display names of the families.
DISPLAY_NAMES = {
    "linear": "Linear Regression",
    "ridge": "Ridge Regression",
    "random_forest": "Random Forest",
    "gradient_boosting": "Gradient Boosting",
    "xgboost": "XGBoost",
    "knn": "KNN",
    "svr": "SVR",
}

# The deepest tree Spark grows; also what "no limit" means.
DEEPEST = 30

TREES = ("random_forest", "gradient_boosting", "xgboost")

# Rows of a partition that Spark's trees are grown on; a task holds its partition as objects.
TREE_ROWS = 500_000


def usable(family: str, params: Mapping[str, Any]) -> dict[str, Any]:
    """The parameters that a fit really uses.

    A tree without a limit is as deep as Spark grows it, and nodes of fewer than two rows are never
    split anyway.  A search over the result fits no model twice and records what it fitted.
    """
    used = dict(params)
    if family in TREES and "max_depth" in used:
        used["max_depth"] = DEEPEST if used["max_depth"] is None else int(used["max_depth"])
    if family in TREES and used.get("min_samples_split") is not None and used["min_samples_split"] <= 2:
        del used["min_samples_split"]
    return used


def distinct_points(family: str, points: Sequence[Mapping[str, Any]]) -> list[dict[str, Any]]:
    """The usable form of every point, each once, in order."""
    found = {json.dumps(u, sort_keys=True, default=str): u for u in (usable(family, p) for p in points)}
    return list(found.values())


def label_column(target: str) -> str:
    return f"label_{target}"


def prediction_column(target: str) -> str:
    return f"prediction_{target}"


def _subset(choice: Any) -> str:
    """Features tried per split: a name, a share, or all."""
    return "all" if choice is None else str(choice)


def _depth(family: str, params: Mapping[str, Any]) -> int:
    depth = usable(family, {"max_depth": params.get("max_depth")})["max_depth"]
    if depth > DEEPEST:
        raise ValueError(f"max_depth {depth}: trees deeper than {DEEPEST} cannot be grown")
    return depth


def _tree_settings(family: str, params: Mapping[str, Any]) -> dict[str, Any]:
    return {"maxDepth": _depth(family, params), "minInstancesPerNode": max(1, int(params.get("min_samples_leaf", 1)))}


def grown_here(family: str, params: Mapping[str, Any]) -> bool:
    """Whether the library's own histograms grow the trees: penalties and a least size of split nodes have no counterpart in Spark's.

    ``histograms`` asks for them, as searches among forests do.
    """
    return family == "xgboost" or family in TREES and ("min_samples_split" in usable(family, params) or bool(params.get("histograms")))


def _sizes(params: Mapping[str, Any], seed: int) -> dict[str, Any]:
    return {"least": max(1, int(params.get("min_samples_leaf", 1))), "split_least": params.get("min_samples_split", 2), "per_node": params.get("max_features"),
            "seed": seed}


def forest_growth(params: Mapping[str, Any], seed: int = SEED) -> Growth:
    """How the trees of a forest grow from histograms."""
    return Growth(_depth("random_forest", params), bootstrap=bool(params.get("bootstrap", True)), **_sizes(params, seed))


def grow(family: str, df: DataFrame, target: str, params: Mapping[str, Any], key: Sequence[str], seed: int = SEED) -> FlatTrees:
    """Trees of one target from histograms; the key draws samples of rows."""
    label, n = label_column(target), int(params.get("n_estimators", 100))
    if family == "xgboost":
        how = Growth(_depth(family, {"max_depth": 6, **params}), params.get("learning_rate", 0.3), params.get("reg_alpha", 0.0), params.get("reg_lambda", 1.0),
                     params.get("gamma", 0.0), params.get("min_child_weight", 1), 0.0, params.get("subsample", 1.0), params.get("colsample_bytree", 1.0), seed=seed)
        return trees.boost(df, label, n, how, key=key, averaged=True)
    if family == "gradient_boosting":
        how = Growth(_depth(family, {"max_depth": 3, **params}), params.get("learning_rate", 0.1), rows=params.get("subsample", 1.0), **_sizes(params, seed))
        return trees.boost(df, label, n, how, key=key)
    return trees.forest(df, label, n, forest_growth(params, seed), key=key)


def _ridge_parameter(df: DataFrame, label: str, alpha: float) -> float:
    """Spark's penalty that equals ``alpha`` times the squared coefficients beside the sum of squares."""
    row = df.agg(F.stddev_pop(label).alias("sd"), F.count(label).alias("n")).first()
    return alpha * (row["sd"] or 0.0) / row["n"]


def make_estimator(family: str, df: DataFrame, target: str, params: Mapping[str, Any], seed: int = SEED):
    """The Spark estimator of one target."""
    common = {"featuresCol": "features", "labelCol": label_column(target),
              "predictionCol": prediction_column(target)}
    if family == "linear":
        return LinearRegression(solver="auto", tol=1e-9, maxIter=500, **common)
    if family == "ridge":
        return LinearRegression(solver="auto", standardization=False, tol=1e-9, maxIter=500, elasticNetParam=0.0,
                                regParam=_ridge_parameter(df, label_column(target), params.get("alpha", 1.0)), **common)
    if family == "random_forest":
        return RandomForestRegressor(numTrees=int(params.get("n_estimators", 100)), seed=seed,
                                     bootstrap=bool(params.get("bootstrap", True)), featureSubsetStrategy=_subset(params.get("max_features")),
                                     **_tree_settings(family, params), **common)
    if family == "gradient_boosting":
        settings = _tree_settings(family, {"max_depth": 3, **params})
        return GBTRegressor(maxIter=int(params.get("n_estimators", 100)), stepSize=params.get("learning_rate", 0.1),
                            subsamplingRate=params.get("subsample", 1.0), seed=seed,
                            featureSubsetStrategy=_subset(params.get("max_features")), **settings, **common)
    raise ValueError(f"unknown family {family!r}")


def spread_for_trees(df: DataFrame, target: str, key: Sequence[str] = ()) -> DataFrame:
    """Features and label in partitions of about ``TREE_ROWS`` rows.

    Spark's trees read a partition whole at every level, and the parts of a scan grow with the table up to
    its largest split.  A table in enough partitions is not moved.
    """
    return spread_by_key(df.select("features", label_column(target), *key), key).drop(*key)


def spread_by_key(rows: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Rows in at least as many partitions as hold about ``TREE_ROWS`` rows each."""
    parts = math.ceil(rows.count() / TREE_ROWS)
    return rows.repartition(parts, *key) if parts > rows.rdd.getNumPartitions() else rows


def row_id(key: Sequence[str]):
    """One text per row key: names and values apart from each other, null apart from every text."""
    return F.to_json(F.struct(*key))


def vector_width(df: DataFrame, vector: str = "features") -> int | None:
    """Number of features, from the column's metadata or else from one row; None for an empty table."""
    known = df.schema[vector].metadata.get("ml_attr", {}).get("num_attrs")
    if known:
        return int(known)
    row = df.select(vector).first()
    return None if row is None or row[0] is None else len(row[0])


@dataclass
class Fitted:
    """One fitted model per target, with the parameters it was fitted with."""

    name: str
    family: str
    targets: list[str]
    params: dict[str, Any] = field(default_factory=dict)
    parts: dict[str, Any] = field(default_factory=dict)
    width: int | None = None

    def predict(self, df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
        """Add ``prediction_<target>`` in the space of the labels.

        ``key`` identifies rows; nearest neighbours need it to bring results back.
        """
        if self.family == "knn":
            return self._predict_neighbours(df, list(key))
        for target in self.targets:
            part = self.parts[target]
            if isinstance(part, (KernelModel, FlatTrees)):
                df = part.transform(df, "features", prediction_column(target))
            else:
                df = part.transform(df)
        return df

    def _predict_neighbours(self, df: DataFrame, key: list[str]) -> DataFrame:
        if not key:
            raise ValueError("nearest neighbours need the columns that identify a row")
        rows = df.withColumn("_id", row_id(key))
        found = nearest(rows, self.parts["rows"], int(self.params.get("n_neighbors", 5)), "_id", "_id", "features",
                        int(self.params.get("p", 2)), [label_column(t) for t in self.targets])
        means = found.groupBy(F.col("qid").alias("_id")).agg(*[
            neighbour_mean(found, i, self.params.get("weights", "uniform")).alias(prediction_column(t))
            for i, t in enumerate(self.targets)])
        return rows.join(means, "_id", "left").drop("_id")

    def save(self, spark: SparkSession, path: str) -> None:
        about: dict[str, Any] = {"name": self.name, "family": self.family, "targets": self.targets,
                                 "params": self.params, "width": self.width}
        if self.family == "knn":
            self.parts["rows"].write.mode("overwrite").parquet(f"{path}/rows")
        for target in [] if self.family == "knn" else self.targets:
            part = self.parts[target]
            if isinstance(part, KernelModel):
                about.setdefault("kernels", {})[target] = asdict(part)
                continue
            if isinstance(part, FlatTrees):
                about.setdefault("flat", []).append(target)
                part.save(spark, f"{path}/target={target}")
                continue
            part.write().overwrite().save(f"{path}/target={target}")
        save_metadata(spark, about, f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Fitted:
        about = load_metadata(spark, f"{path}/about")
        family, parts = about["family"], {}
        if family == "knn":
            parts["rows"] = spark.read.parquet(f"{path}/rows")
        readers = {"linear": LinearRegressionModel, "ridge": LinearRegressionModel,
                   "random_forest": RandomForestRegressionModel, "gradient_boosting": GBTRegressionModel}
        for target in [] if family == "knn" else about["targets"]:
            if family == "svr":
                kept = about["kernels"][target]
                parts[target] = KernelModel(**{**kept, "map": FeatureMap(**kept["map"])})
            elif target in about.get("flat", []):
                parts[target] = FlatTrees.load(spark, f"{path}/target={target}")
            else:
                parts[target] = readers[family].load(f"{path}/target={target}")
        return Fitted(about["name"], family, about["targets"], about["params"], parts, about.get("width"))


def fit(family: str, df: DataFrame, targets: Sequence[str], params: Mapping[str, Any] | None = None,
        key: Sequence[str] = (), name: str | None = None, seed: int = SEED, workers: int = 2) -> Fitted:
    """Fit one independent regressor per target on ``features`` and ``label_<target>``.

    Rows without a label are left out of their target's fit.  A target without any labelled row is a
    ``ValueError``, except for nearest neighbours, which then predict null.
    """
    params, targets = dict(params or {}), list(targets)
    fitted = Fitted(name or DISPLAY_NAMES[family], family, targets, params, width=vector_width(df))
    if family == "knn":
        if not key:
            raise ValueError("nearest neighbours need the columns that identify a row")
        rows = df.select(row_id(key).alias("_id"), "features",
                         *[label_column(t) for t in targets])
        fitted.parts["rows"] = materialise(rows)
        return fitted

    def one(target: str):
        present = df.filter(F.col(label_column(target)).isNotNull())
        if family == "svr":
            allowed = {k: v for k, v in params.items() if k in ("C", "epsilon", "gamma", "kernel", "size", "steps")}
            return fit_kernel(present, label_column(target), seed=seed, **allowed)
        if grown_here(family, params):
            return grow(family, present, target, params, key, seed)
        if family in TREES:
            present = spread_for_trees(present, target, key)
        return make_estimator(family, present, target, params, seed).fit(present)

    def checked(target: str):
        try:
            part = one(target)
        except Exception as problem:
            if df.filter(F.col(label_column(target)).isNotNull()).isEmpty():
                raise ValueError(f"{target}: no labelled rows to fit on") from problem
            raise
        if isinstance(part, FlatTrees) and not len(part.roots):
            raise ValueError(f"{target}: no labelled rows to fit on")
        return part

    with ThreadPoolExecutor(max(1, min(workers, len(targets)))) as pool:
        fitted.parts = dict(zip(targets, pool.map(checked, targets), strict=True))
    return fitted


def keep_rows(df: DataFrame) -> DataFrame:
    """Persist rows that several fits read; partitions lost with an executor are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def file_name(name: str) -> str:
    return name.replace(" ", "_").lower()


def save_models(spark: SparkSession, models: Sequence[Fitted], path: str) -> None:
    """Save all models and a manifest that keeps their order."""
    for model in models:
        model.save(spark, f"{path}/{file_name(model.name)}")
    manifest = [(i, m.name, m.family, json.dumps(m.targets), file_name(m.name)) for i, m in enumerate(models)]
    spark.createDataFrame(manifest, "position int, model string, family string, targets string, path string") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def manifest_paths(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(model, folder) in saved order; blank entries are skipped."""
    rows = spark.read.parquet(f"{path}/manifest").orderBy("position").collect()
    return [(r["model"], f"{path}/{r['path'].strip()}") for r in rows if r["path"] and r["path"].strip()]


def load_models(spark: SparkSession, path: str) -> list[Fitted]:
    return [Fitted.load(spark, folder) for _, folder in manifest_paths(spark, path)]
