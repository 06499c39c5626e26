"""Whole runs: clean, profile, prepare, train, evaluate, explain, and score another cycle."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..operators import clean, combine, distribution, evaluate, explain, features, models, profile, search
from ..sources import tables as sources
from ..spec import Spec, numeric_columns

DEFAULT_FAMILIES = ("linear", "random_forest", "gradient_boosting", "knn", "svr", "xgboost")


@dataclass(frozen=True)
class Folders:
    """Where a run keeps its tables."""

    root: str

    def __call__(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])


def build_clean(spark: SparkSession, spec: Spec, data: str, cycle: str | None = None, fmt: str = "xport",
                pattern: str = sources.TOPIC_FILE, bounds: Mapping[str, clean.Bounds] | None = None,
                strategy: str = "auto") -> tuple[DataFrame, dict[str, clean.Bounds]]:
    """The wide clean table of one cycle, and the trim bounds of every topic.

    ``bounds`` re-uses the bounds of another cycle; by default they are fitted on this one.
    """
    found = sources.existing_topics(spark, sources.topic_paths(spec, data, cycle, pattern))
    if not found:
        raise FileNotFoundError(f"no topic file below {data}")
    cleaned, fitted = [], {}
    for file, path in found.items():
        raw = sources.read_file(spark, path, fmt, [spec.key, *[f.source for f in spec.of_file(file)]])
        table, fitted[file] = clean.clean_topic(raw, spec.of_file(file), spec.key, spec.sentinels,
                                                (bounds or {}).get(file))
        cleaned.append(table)
    wide = combine.combine_on_key(cleaned, spec.key, strategy)
    return clean.drop_missing_targets(wide, [t for t in spec.targets if t in wide.columns]), fitted


def profile_tables(df: DataFrame, spec: Spec) -> dict[str, DataFrame]:
    """The tables behind the exploratory figures."""
    numeric = numeric_columns(df, [*spec.numeric, *spec.targets])
    categorical = [c for c in spec.categorical if c in df.columns]
    out = {
        "describe": profile.describe(df, numeric),
        "missing": clean.missing_ratio(df),
        "correlation": profile.correlation(df, numeric),
        "histograms": distribution.histograms(df, numeric, 30),
        "densities": distribution.kdes(df, numeric),
        "univariate": profile.univariate_fit(df, [c for c in numeric if c not in spec.targets],
                                             [c for c in numeric if c in spec.targets]),
    }
    features = [c for c in numeric if c not in spec.targets]
    targets = [c for c in numeric if c in spec.targets]
    if features and targets:
        out["bands"] = profile.regression_bands(df, features, targets, [spec.key])
    if categorical:
        out["category_counts"] = profile.category_counts(df, categorical)
        few = profile.low_cardinality(df, categorical)
        if few and targets:
            out["boxes"] = distribution.box_tables(df, few, targets)
    return out


def trial_views(trials: DataFrame, params: Sequence[str]) -> dict[str, DataFrame]:
    """The tables behind the figures of a study: best so far, parallel coordinates, importance of its parameters."""
    views = {"history": search.history(trials), "coordinates": search.parallel_coordinates(trials)}
    if trials.filter("value is not null and not isnan(value)").limit(2).count() == 2:
        views["importance"] = search.parameter_importance(trials.filter("not isnan(value)"), params)
    return views


def tune(rows: DataFrame, family: str, targets: Sequence[str], key: Sequence[str], how: str, folder: str,
         trials: int = fixed.STUDY_TRIALS, seconds: float = fixed.STUDY_SECONDS) -> dict[str, Any]:
    """The best parameters of one family: ``study``, ``grid``, ``random`` or ``none``."""
    if how == "none" or family == "linear":
        return {}
    if how == "study":
        space = fixed.STUDY_SPACES.get(family, {"alpha": ("log", 0.01, 100.0)})
        best, tried = search.study(rows, family, search.cv_objective(family, targets, key), space,
                                   f"{folder}/{family}", trials, seconds)
        for name, view in trial_views(tried, list(space)).items():
            sources.save_table(view, f"{folder}_views/{name}/{family}")
        return best
    if how == "grid":
        grid = fixed.GRIDS.get(family) or fixed.WIDE_GRIDS[family]
        best, table = search.grid_search(rows, family, targets, grid, fixed.GRID_FOLDS, key)
    elif how == "random":
        space = fixed.RANDOM_SPACES.get(family) or fixed.WIDE_GRIDS[family]
        best, table = search.random_search(rows, family, targets, space, fixed.RANDOM_FOLDS, key)
    else:
        raise ValueError(f"unknown search {how!r}")
    sources.save_table(table, f"{folder}/{family}")
    return best


def _store_results(residuals: DataFrame, targets: Sequence[str], folders: Folders, label: str) -> DataFrame:
    """Residuals by model and target, metrics in long and wide form; the stored metrics."""
    spark = residuals.sparkSession
    sources.save_table(residuals, folders(f"{label}_residuals"), ["Model", "Target"])
    stored = sources.load_table(spark, folders(f"{label}_residuals"))
    sources.save_table(evaluate.metrics(stored), folders(f"{label}_metrics"))
    metrics = sources.load_table(spark, folders(f"{label}_metrics"))
    sources.write_csv(evaluate.wide_metrics(metrics, targets).coalesce(1), folders(f"{label}_metrics_csv"))
    return metrics


def run_training(spark: SparkSession, spec: Spec, data: str, out: str, fmt: str = "xport",
                 pattern: str = sources.TOPIC_FILE, families: Sequence[str] = DEFAULT_FAMILIES, how: str = "study",
                 params: Mapping[str, Mapping[str, Any]] | None = None, trials: int = fixed.STUDY_TRIALS,
                 seconds: float = fixed.STUDY_SECONDS, cv_folds: Sequence[int] = ()) -> dict[str, DataFrame]:
    """One whole training run; tables and models are kept below ``out``.

    Rows are materialised three times (clean table, feature vectors, results); the rest
    stays lazy.  ``params`` sets parameters of a family and replaces its search.
    """
    folders, key, targets = Folders(out), [spec.key], spec.targets
    wide, bounds = build_clean(spark, spec, data, None, fmt, pattern)
    sources.save_table(wide, folders("clean"))
    sources.save_metadata(spark, {f: b.limits for f, b in bounds.items()}, folders("bounds"))
    df = sources.load_table(spark, folders("clean"))
    for name, table in profile_tables(df, spec).items():
        sources.save_table(table, folders("profile", name))

    ready = features.prepare_spec(df, spec)
    ready.preprocessor.save(spark, folders("preprocessor"))
    sources.matrix_bundle(ready.rows, folders("features"), ready.preprocessor.names)
    rows, names = sources.load_bundle(spark, folders("features"))
    train, test = rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split")

    fitted = []
    for family in families:
        chosen = (params or {}).get(family)
        if chosen is None:
            chosen = tune(train, family, targets, key, how, folders("trials"), trials, seconds)
        fitted.append(models.fit(family, train, targets, chosen, key))
    models.save_models(spark, fitted, folders("models"))

    results = {
        "train_metrics": _store_results(evaluate.report_all(fitted, train, ready.targets, key), targets, folders, "train"),
        "test_metrics": _store_results(evaluate.report_all(fitted, test, ready.targets, key), targets, folders, "test"),
    }
    results["comparison"] = evaluate.compare(results["train_metrics"], results["test_metrics"])
    results["plot_limits"] = evaluate.plot_limits(results["comparison"])
    for side in ("train", "test"):
        stored = sources.load_table(spark, folders(f"{side}_residuals"))
        results[f"{side}_residual_density"] = distribution.grouped_density(stored, "Residual", "Target", ["Model"])
    if cv_folds:
        results["cv"] = search.cv_sensitivity(train, {m.name: (m.family, m.params) for m in fitted}, targets,
                                              cv_folds, key)
    parts = []
    for m in fitted:
        raw = explain.model_importances(spark, m, names)
        if raw is None:
            raw = explain.permutation_importance(m, train, key, names).drop("Deviation")
        parts.append(raw)
    raw = reduce(DataFrame.unionByName, parts)
    results["importances"] = explain.normalise(explain.collapse_levels(raw, bases=ready.preprocessor.bases))
    for name in ("comparison", "plot_limits", "train_residual_density", "test_residual_density", "importances", "cv"):
        if name in results:
            sources.save_table(results[name], folders(name))
            results[name] = sources.load_table(spark, folders(name))
    return results


def run_scoring(spark: SparkSession, spec: Spec, data: str, out: str, cycle: str = "H", fmt: str = "xport",
                pattern: str = sources.TOPIC_FILE, bounds: str = "refit") -> dict[str, DataFrame]:
    """Apply the saved transform and models of a training run to another cycle.

    ``bounds="train"`` trims by the bounds of the training cycle instead of the new one's.
    """
    folders = Folders(out)
    kept = None
    if bounds == "train":
        stored = sources.load_metadata(spark, folders("bounds"))
        kept = {f: clean.Bounds(tuple(tuple(limit) for limit in limits)) for f, limits in stored.items()}
    wide, _ = build_clean(spark, spec, data, cycle, fmt, pattern, kept)
    sources.save_table(wide, folders(f"clean_{cycle}"))
    df = sources.load_table(spark, folders(f"clean_{cycle}"))
    for name, table in profile_tables(df, spec).items():
        sources.save_table(table, folders(f"profile_{cycle}", name))
    preprocessor = features.Preprocessor.load(spark, folders("preprocessor"))
    transform = features.fit_targets(df, {t: "log1p" if t in spec.log_targets else None for t in spec.targets})
    rows = preprocessor.transform(transform.transform(df), [spec.key, *[f"label_{t}" for t in spec.targets]])
    sources.save_table(rows, folders(f"features_{cycle}"))
    rows = sources.load_table(spark, folders(f"features_{cycle}"))
    residuals, status = evaluate.score_saved(spark, folders("models"), rows, transform, [spec.key])
    results = {"status": status}
    if residuals is not None:
        results["metrics"] = _store_results(residuals, spec.targets, folders, f"prediction_{cycle}")
    return results


def describe_run(results: Mapping[str, DataFrame]) -> str:
    """The metric tables of a run as text; they hold one row per model and target."""
    shown = [n for n in ("train_metrics", "test_metrics", "metrics", "status") if n in results]
    return "\n".join(f"{n}\n{json.dumps([r.asDict() for r in results[n].collect()], indent=1)}" for n in shown)
