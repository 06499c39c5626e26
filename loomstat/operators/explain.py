"""Importances: from models, rolled up to source columns, and by permutation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed import SEED
from ..functions.columns import base_feature_name, key_hash
from ..session import counted_broadcast
from .evaluate import metrics
from .kernel import KernelModel
from .models import Fitted, label_column, prediction_column
from .trees import BROADCAST_BYTES, FlatTrees, from_spark

# Rows that trade values with each other in one window of the permutation.
BUCKET_ROWS = 10_000


def model_importances(spark: SparkSession, model: Fitted, names: Sequence[str]) -> DataFrame | None:
    """(Model, Target, Feature, Importance) of tree importances or absolute coefficients.

    None for families without either; use :func:`permutation_importance` there.  The rows
    are one per feature of a fitted model.
    """
    rows = []
    for target in model.targets:
        part = model.parts.get(target)
        values = getattr(part, "featureImportances", None)
        if values is None and model.family in ("linear", "ridge"):
            values = part.coefficients
        if values is None:
            return None
        rows += [(model.name, target, n, abs(float(v))) for n, v in zip(names, values.toArray(), strict=True)]
    return spark.createDataFrame(rows, "Model string, Target string, Feature string, Importance double")


def collapse_levels(table: DataFrame, by: Sequence[str] = ("Model", "Target"), bases: Mapping[str, str] | None = None,
                    feature: str = "Feature", value: str = "Importance") -> DataFrame:
    """Sum one-hot importances back to their source column.

    With ``bases`` (feature → column) word levels collapse as well; without it only
    numeric level suffixes are recognised.
    """
    if bases:
        dim = table.sparkSession.createDataFrame(list(bases.items()), f"`{feature}` string, _base string")
        named = table.join(F.broadcast(dim), feature, "left").withColumn(
            feature, F.coalesce("_base", base_feature_name(F.col(feature))))
    else:
        named = table.withColumn(feature, base_feature_name(F.col(feature)))
    return named.groupBy(*by, feature).agg(F.sum(value).alias(value))


def normalise(table: DataFrame, by: Sequence[str] = ("Model", "Target"), value: str = "Importance",
              skip_empty: bool = True) -> DataFrame:
    """Values as shares of their group; groups summing to zero are left out."""
    total = F.sum(value).over(W.partitionBy(*by))
    shares = table.withColumn("_total", total)
    if skip_empty:
        shares = shares.filter(F.col("_total") != 0)
    return shares.withColumn(value, F.try_divide(F.col(value), F.col("_total"))).drop("_total")


def share_within(table: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Add each row's share of its group's total, 0 where the total is not positive.

    Totals are pre-aggregated and joined back, so a group holding most rows is never
    gathered in one task.
    """
    totals = table.groupBy(*by).agg(F.sum(value).alias("_total"))
    joined = table.join(counted_broadcast(totals), list(by))
    return joined.withColumn(name, F.when(F.col("_total") > 0, F.col(value) / F.col("_total")).otherwise(0.0)).drop(
        "_total")


def top_n(table: DataFrame, by: Sequence[str], value: str, n: int = 20, tie: str = "Feature") -> DataFrame:
    """The n largest rows per group; ties go to the smaller ``tie`` value.

    Spark limits each group before the shuffle, so a large group stays cheap.
    """
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(value), tie))
    return table.withColumn("rank", rank).filter(F.col("rank") <= n)


def permutation_importance(model: Fitted, rows: DataFrame, key: Sequence[str], names: Sequence[str],
                           repeats: int = 5, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(Model, Target, Feature, Importance, Deviation): fall of R² when one feature is shuffled.

    In every repeat the rows fall into hash buckets of bounded size; inside a bucket, in
    hash order, each row takes the feature value of the next one.  That is a permutation
    that needs no global order.  All repeats and features are scored in one job.  Linear models,
    kernel regression and trees swap the features inside the tasks, which pass on sums; neighbours, and
    trees of more than ``BROADCAST_BYTES``, take one row per feature and repeat.
    """
    n = rows.count()
    buckets = max(1, math.ceil(n / bucket_rows))
    labels = [label_column(t) for t in model.targets]
    base = rows.select(*key, *labels, vector_to_array("features").alias("_x"))
    drawn = base.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn(
        "_h", key_hash([*key, "_rep"], f"perm{seed}")).withColumn("_b", F.col("_h") % F.lit(buckets))
    order = W.partitionBy("_rep", "_b").orderBy("_h", *key)
    whole = W.partitionBy("_rep", "_b").orderBy("_h", *key).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    paired = drawn.withColumn("_other", F.coalesce(F.lead("_x").over(order), F.first("_x").over(whole)))
    feature = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("_j") + 1)
    plain = model.predict(rows.select(*key, *labels, "features"), key)
    inside = {t: numpy_prediction(model.parts.get(t), len(names)) for t in model.targets}
    if all(f is not None for f in inside.values()):
        shuffled = _swapped_errors(paired, model.targets, inside, len(names))
    else:
        swapped = paired.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1)))).withColumn(
            "_x", F.transform("_x", lambda v, i: F.when(i == F.col("_j"), F.get(F.col("_other"), F.col("_j"))).otherwise(v)))
        asked = swapped.withColumn("features", array_to_vector("_x")).select(*key, "_rep", "_j", *labels, "features")
        predicted = model.predict(asked, [*key, "_rep", "_j"])
        entries = F.explode(F.array(*[
            F.struct(F.lit(t).alias("_t"), F.col(label_column(t)).cast("double").alias("_true"), F.col(prediction_column(t)).alias("_guess"))
            for t in model.targets])).alias("_e")
        shuffled = metrics(predicted.select("_rep", "_j", entries).select("_rep", "_j", "_e.*").filter("_true is not null"),
                           ["_t", "_rep", "_j"], "_true", "_guess").select("_t", "_rep", "_j", "R2")
    entries = F.explode(F.array(*[
        F.struct(F.lit(t).alias("_t"), F.col(label_column(t)).cast("double").alias("_true"), F.col(prediction_column(t)).alias("_guess"))
        for t in model.targets])).alias("_e")
    before = metrics(plain.select(entries).select("_e.*").filter("_true is not null"), ["_t"], "_true", "_guess")
    drop = shuffled.select("_t", "_j", F.col("R2").alias("_after")).join(before.select("_t", F.col("R2").alias("_before")), "_t")
    fall = F.col("_before") - F.col("_after")
    return drop.groupBy("_t", "_j").agg(F.avg(fall).alias("Importance"), F.stddev_pop(fall).alias("Deviation")).select(
        F.lit(model.name).alias("Model"), F.col("_t").alias("Target"), feature.alias("Feature"), "Importance", "Deviation")


def numpy_prediction(part, width: int):
    """A function (rows, partner rows) → predictions with each feature swapped, one column per feature; None for neighbours."""
    if isinstance(part, (RandomForestRegressionModel, GBTRegressionModel)):
        part = from_spark(part, width)
    if isinstance(part, FlatTrees) and part.size <= BROADCAST_BYTES:
        shared = SparkSession.getActiveSession().sparkContext.broadcast(part)
        return lambda x, other: shared.value.swapped(x, other)
    if isinstance(part, LinearRegressionModel):
        slopes, intercept = part.coefficients.toArray(), float(part.intercept)
        return lambda x, other: (x @ slopes + intercept)[:, None] + (other - x) * slopes[None, :]
    if isinstance(part, KernelModel):
        mapped, slopes, intercept = part.map.function(), np.array(part.coefficients), part.intercept

        def swapped(x, other):
            out = np.empty(x.shape)
            for j in range(x.shape[1]):
                own = x[:, j].copy()
                x[:, j] = other[:, j]
                out[:, j] = mapped(x) @ slopes + intercept
                x[:, j] = own
            return out

        return swapped
    return None


def _swapped_errors(paired: DataFrame, targets: Sequence[str], inside: Mapping[str, Any], width: int) -> DataFrame:
    """(_t, _rep, _j, R2) without a row per feature: tasks swap inside their batches and pass on sums."""
    targets = list(targets)
    lean = paired.select("_rep", "_x", "_other", *[F.col(label_column(t)).cast("double").alias(f"_y{i}") for i, t in enumerate(targets)])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.iloc[start:start + 2048]
                x, other = np.stack(part["_x"].to_numpy()).astype(float), np.stack(part["_other"].to_numpy()).astype(float)
                reps = part["_rep"].to_numpy()
                for i, t in enumerate(targets):
                    y = part[f"_y{i}"].to_numpy(dtype=float)
                    there = ~np.isnan(y)
                    error = (y[there, None] - inside[t](x[there], other[there])) ** 2
                    for rep in np.unique(reps[there]):
                        own = reps[there] == rep
                        got = np.concatenate([[own.sum(), y[there][own].sum(), (y[there][own] ** 2).sum()], error[own].sum(axis=0)])
                        total[i, int(rep)] = total.get((i, int(rep)), 0) + got
        rows = [(i, rep, j, v[0], v[1], v[2], v[3 + j]) for (i, rep), v in total.items() for j in range(width)]
        yield pd.DataFrame(rows, columns=["i", "_rep", "_j", "n", "s", "ss", "e"])

    added = lean.mapInPandas(sums, "i int, _rep int, _j int, n double, s double, ss double, e double").groupBy("i", "_rep", "_j").agg(
        *[F.sum(c).alias(c) for c in ("n", "s", "ss", "e")])
    spread = F.expr("ss - s * s / n")
    r2 = F.when(F.col("n") < 2, F.lit(None).cast("double")).when(spread > 1e-24 * F.col("ss"), 1 - F.col("e") / spread).otherwise(
        F.when(F.col("e") == 0, 1.0).otherwise(0.0))
    name = F.element_at(F.array(*[F.lit(t) for t in targets]), F.col("i") + 1)
    return added.select(name.alias("_t"), "_rep", "_j", r2.alias("R2"))
