"""Residuals, metrics and the comparison of models."""

from __future__ import annotations

import re
import uuid
import warnings
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed import SEARCH_WORKERS
from ..functions.columns import residual
from ..session import drop_scratch, scratch_path
from .combine import concat_rows, spread
from .features import TargetTransform
from .models import Fitted, fit, label_column, manifest_paths, prediction_column, vector_width

# Columns of the result tables.
METRICS = ["R2", "RMSE"]


def residuals(predicted: DataFrame, model: str, transform: TargetTransform, keep: Sequence[str] = (),
              logged: bool = False) -> DataFrame:
    """(keep…, Model, Target, True, Predicted, Residual), one row per row and target.

    Truth and prediction are columns of one row, so nothing is paired by position.
    ``logged`` stops at the log scale of the targets.
    """
    entries = F.explode(F.array(*[
        F.struct(F.lit(t).alias("Target"),
                 transform.invert(t, F.col(label_column(t)), logged).alias("True"),
                 transform.invert(t, F.col(prediction_column(t)), logged).alias("Predicted"))
        for t in transform.names])).alias("_e")
    return predicted.select(*keep, F.lit(model).alias("Model"), entries).select(*keep, "Model", "_e.*").withColumn(
        "Residual", F.col("True") - F.col("Predicted")).filter(F.col("True").isNotNull())


def residual_kinds(table: DataFrame) -> DataFrame:
    """Additive, log and relative residuals side by side."""
    true, predicted = F.col("True"), F.col("Predicted")
    return table.select("*", residual(true, predicted).alias("Residual_Original"),
                        residual(true, predicted, "log").alias("Residual_Log"),
                        residual(true, predicted, "relative").alias("Residual_Relative"))


def _complete(true: str, predicted: str):
    return ~(F.col(true).isNull() | F.isnan(true) | F.col(predicted).isNull() | F.isnan(predicted))


def unpredicted(table: DataFrame, by: Sequence[str] = ("Model", "Target"), true: str = "True",
                predicted: str = "Predicted") -> DataFrame:
    """(by…, rows): rows that :func:`metrics` leaves out because truth or prediction is missing."""
    return table.filter(~_complete(true, predicted)).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def metrics(table: DataFrame, by: Sequence[str] = ("Model", "Target"), true: str = "True",
            predicted: str = "Predicted") -> DataFrame:
    """(by…, R2, RMSE, n) of the rows with truth and prediction, from one aggregation.

    Rows that lack one of them, null or NaN, count nowhere (:func:`unpredicted` counts them).  A constant truth gives R2 1 when it is met exactly and 0 otherwise; one row gives none.
    """
    both = _complete(true, predicted)
    miss = F.when(both, F.col(true) - F.col(predicted))
    sums = table.groupBy(*by).agg(F.sum(miss * miss).alias("_e"), F.var_pop(F.when(both, F.col(true))).alias("_v"),
                                  F.count(miss).alias("n"))
    r2 = (F.when(F.col("n") < 2, F.lit(None).cast("double"))
          .when(F.col("_v") > 0, 1 - F.col("_e") / F.nullif(F.col("_v") * F.col("n"), F.lit(0.0)))
          .otherwise(F.when(F.col("_e") == 0, 1.0).otherwise(0.0)))
    return sums.select(*by, r2.alias("R2"), F.sqrt(F.col("_e") / F.col("n")).alias("RMSE"), "n")


def long_metrics(table: DataFrame, by: Sequence[str] = ("Model", "Target")) -> DataFrame:
    """(by…, metric, value)."""
    return table.unpivot(list(by), METRICS, "metric", "value")


def wide_metrics(table: DataFrame, targets: Sequence[str], by: str = "Model") -> DataFrame:
    """One row per model with columns ``R2 - <target>`` and ``RMSE - <target>``."""
    long = long_metrics(table, [by, "Target"]).withColumn("_name", F.concat_ws(" - ", "metric", "Target"))
    return spread(long, [by], "_name", "value", [f"{m} - {t}" for m in METRICS for t in targets])


def normalise_by_max(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """RMSE divided by the largest of its group; other metrics stay."""
    top = F.max("value").over(W.partitionBy(*by))
    return long.withColumn("value", F.when(F.col("metric") == "RMSE", F.try_divide(F.col("value"), top))
                           .otherwise(F.col("value")))


def compare(train: DataFrame, test: DataFrame) -> DataFrame:
    """(Model, Target, metric, Train, Test) per target and for the mean over targets.

    The inputs are metric tables; RMSE is scaled by the largest of each target.
    """
    def prepared(table: DataFrame, side: str) -> DataFrame:
        scaled = normalise_by_max(long_metrics(table), ["Target", "metric"])
        mean = scaled.groupBy("Model", "metric").agg(F.avg("value").alias("value")).withColumn("Target", F.lit("Mean"))
        return scaled.unionByName(mean).withColumnRenamed("value", side)

    return prepared(train, "Train").join(prepared(test, "Test"), ["Model", "Target", "metric"])


def plot_limits(compared: DataFrame, by: Sequence[str] = ("metric",), a: str = "Train", b: str = "Test") -> DataFrame:
    """(by…, low, high): joint extent of two columns."""
    return compared.groupBy(*by).agg(F.least(F.min(a), F.min(b)).alias("low"),
                                     F.greatest(F.max(a), F.max(b)).alias("high"))


def split_summary(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test metrics of every (Model, Target) in one row."""
    both = concat_rows([long_metrics(train), long_metrics(test)], "split", ["train", "test"])
    named = both.withColumn("_name", F.concat_ws("_", "split", "metric"))
    return spread(named, ["Model", "Target"], "_name", "value", [f"{s}_{m}" for s in ("train", "test") for m in METRICS])


def measure_sheet(wide: DataFrame, by: str, measures: Sequence[str]) -> DataFrame:
    """(by, measure, total): sums of the chosen measures."""
    return wide.unpivot([by], list(measures), "measure", "value").groupBy(by, "measure").agg(
        F.sum("value").alias("total"))


def report(model: Fitted, rows: DataFrame, transform: TargetTransform, key: Sequence[str],
           logged: bool = False) -> DataFrame:
    """The residual table of one model on labelled rows."""
    return residuals(model.predict(rows, key), model.name, transform, key, logged)


def report_all(models: Sequence[Fitted], rows: DataFrame, transform: TargetTransform, key: Sequence[str],
               logged: bool = False) -> DataFrame:
    return reduce(DataFrame.unionByName, [report(m, rows, transform, key, logged) for m in models])


def fit_reports(families: Mapping[str, Mapping[str, Any]], rows: DataFrame, targets: Sequence[str], transform: TargetTransform, key: Sequence[str],
                workers: int = SEARCH_WORKERS) -> DataFrame:
    """Residuals on ``rows`` of one model per family, fitted on ``rows`` with the family's parameters.

    Several families are fitted at once: each is a long row of jobs that wait for each other, most of them too short for all cores.
    """
    def one(family: str) -> DataFrame:
        return report(fit(family, rows, targets, families[family], key), rows, transform, key)

    with ThreadPoolExecutor(max(1, workers)) as pool:
        return reduce(DataFrame.unionByName, list(pool.map(one, families)))


def _reason(problem: Exception) -> str:
    """The message of a failure; of a task's long report the line that names the error."""
    text = str(problem).strip()
    named = re.findall(r"^[\w.]*(?:Error|Exception)\b.*$", text, re.MULTILINE)
    return (named[0] if len(text) > 500 and named else text)[:500]


def score_saved(spark: SparkSession, path: str, rows: DataFrame, transform: TargetTransform,
                key: Sequence[str], workers: int = SEARCH_WORKERS) -> tuple[DataFrame | None, DataFrame]:
    """Residuals of all saved models on labelled rows, and a status row per model.

    Every model is loaded and scored in a job of its own, whose result is stored.  One that cannot
    be loaded, that has other targets, was fitted on another number of features, or fails inside a
    task is skipped alone and its reason recorded; what is left of its job is cancelled by its tag.
    """
    width = vector_width(rows)

    def one(entry: tuple[int, tuple[str, str]]) -> tuple[DataFrame | None, tuple]:
        position, (name, folder) = entry
        tag, kept = f"score-{uuid.uuid4().hex}", scratch_path(spark, "scored")
        spark.addTag(tag)
        try:
            model = Fitted.load(spark, folder)
            if model.targets != transform.names:
                raise ValueError(f"targets {model.targets} instead of {transform.names}")
            if width is not None and model.width != width:
                raise ValueError(f"fitted on {model.width} features, the rows have {width}")
            table = report(model, rows, transform, key)
            table.write.parquet(kept)
            return spark.read.schema(table.schema).parquet(kept), (position, name, "scored", None)
        except Exception as problem:  # noqa: BLE001 - any failing model is skipped, the reason is kept
            spark.interruptTag(tag)
            drop_scratch(spark, kept)
            return None, (position, name, "skipped", _reason(problem))
        finally:
            spark.removeTag(tag)

    with ThreadPoolExecutor(max(1, workers)) as pool:
        found = list(pool.map(one, enumerate(manifest_paths(spark, path))))
    for _, (_, name, state, reason) in found:
        if state == "skipped":
            warnings.warn(f"skipped {name}: {reason}", stacklevel=2)
    tables = [t for t, _ in found if t is not None]
    table = reduce(DataFrame.unionByName, tables) if tables else None
    return table, spark.createDataFrame([s for _, s in found], "position int, Model string, status string, reason string")
