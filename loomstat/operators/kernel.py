"""Support vector regression on mapped features.

The kernel is replaced by a random feature map (random Fourier features for ``rbf``,
products of random projections for ``poly``, the identity for ``linear``).  The
epsilon-insensitive loss is minimised by reweighted least squares until the objective stands
still: each step reads the rows once, and gets from the same pass the objective of the last
solution and the weighted sums of products that give the next one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import SEED

# Fixed value: degree of the polynomial kernel.
POLY_DEGREE = 3

# The steps end when the objective falls by less than this share.
TOLERANCE = 1e-4

# Rows that are mapped at once; a block of 128 mapped features stays in a core's cache.
BLOCK = 512


# Rows whose cosines are taken at once, and the sine of c turns as c times a series in c², exact to double precision up to a quarter.
TILE = 64
SINE = [(-1) ** k * (2.0 * math.pi) ** (2 * k + 1) / math.factorial(2 * k + 1) for k in range(11)]


def _cosine(turns: np.ndarray, held: np.ndarray, terms: list[float]) -> None:
    """In place, the cosine of an angle in turns, times the factor that ``terms`` hold beside :data:`SINE`; ``held``: two arrays of its shape."""
    square, total = held
    np.rint(turns, out=square)
    turns -= square
    np.abs(turns, out=turns)
    np.subtract(0.25, turns, out=turns)
    np.multiply(turns, turns, out=square)
    np.multiply(square, terms[-1], out=total)
    for c in terms[-2:0:-1]:
        total += c
        total *= square
    total += terms[0]
    turns *= total


@dataclass(frozen=True)
class FeatureMap:
    """A random map from ``width`` input features to ``size`` output features, fixed by its seed."""

    kernel: str
    width: int
    gamma: float
    size: int
    seed: int

    def draw(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        if self.kernel == "rbf":
            return (rng.normal(0.0, math.sqrt(2.0 * self.gamma), (self.width, self.size)),
                    rng.uniform(0.0, 2.0 * math.pi, self.size))
        return rng.choice([-1.0, 1.0], (POLY_DEGREE, self.width, self.size)), np.zeros(self.size)

    @property
    def outputs(self) -> int:
        return self.width if self.kernel == "linear" else self.size

    def function(self):
        """The map as a function of a matrix of rows."""
        if self.kernel == "linear":
            return lambda x: x
        weights, offset = self.draw()
        gamma, size = self.gamma, self.size
        if self.kernel == "rbf":
            turns, start, terms = weights / (2.0 * math.pi), offset / (2.0 * math.pi), [math.sqrt(2.0 / size) * c for c in SINE]

            def mapped(x: np.ndarray) -> np.ndarray:
                z = x @ turns
                held = np.empty((2, min(TILE, len(z)), size))
                for a in range(0, len(z), TILE):
                    part = z[a : a + TILE]
                    part += start
                    _cosine(part, held[:, : len(part)], terms)
                return z

            return mapped
        return lambda x: math.sqrt(gamma ** POLY_DEGREE / size) * np.prod([x @ w for w in weights], axis=0)


@dataclass(frozen=True)
class KernelModel:
    """A fitted model with the objectives of its steps."""

    map: FeatureMap
    coefficients: tuple[float, ...]
    intercept: float
    losses: tuple[float, ...] = ()

    def transform(self, df: DataFrame, vector: str, prediction: str) -> DataFrame:
        mapped, slopes, intercept = self.map.function(), np.array(self.coefficients), self.intercept

        @F.pandas_udf("double")
        def predicted(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            return pd.Series(mapped(np.stack(x.to_numpy())) @ slopes + intercept)

        return df.withColumn(prediction, predicted(vector_to_array(vector)))


def default_gamma(df: DataFrame, vector: str, width: int) -> float:
    """1 / (number of features · variance of all feature values)."""
    x = vector_to_array(vector)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    row = df.select(total.alias("t"), squares.alias("s")).agg(F.avg("t").alias("t"), F.avg("s").alias("s")).first()
    variance = row["s"] / width - (row["t"] / width) ** 2
    return 1.0 / (width * variance) if variance > 0 else 1.0


def _pass(rows: DataFrame, fmap: FeatureMap, epsilon: float, solution: tuple[np.ndarray, float] | None) -> tuple[float, np.ndarray]:
    """Sum of the losses of a solution, and the weighted products of (1, features, target) for the next.

    Without a solution every row weighs 1 and its target is the label: a plain ridge fit.
    Otherwise each side of the loss, max(0, u), is bounded by (u + a)² / 4a with a = |u| at the last
    solution.  The bounds touch the loss there, so a step never raises the objective.
    """
    size = fmap.outputs + 2

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped, total, loss = fmap.function(), np.zeros((size, size)), 0.0
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, fmap.width)
            labels = batch["y"].to_numpy(zero_copy_only=False)
            for start in range(0, batch.num_rows, BLOCK):
                z, y = mapped(x[start:start + BLOCK]), labels[start:start + BLOCK]
                weight, target = np.ones(len(y)), y
                if solution is not None:
                    miss = y - z @ solution[0] - solution[1]
                    over = np.maximum(np.abs(miss) - epsilon, 0.0)
                    loss += over.sum()
                    above, below = (np.maximum(np.abs(side), 1e-6) for side in (miss - epsilon, miss + epsilon))
                    weight = 0.25 / above + 0.25 / below
                    target = y + (0.25 * (above - epsilon) / above + 0.25 * (epsilon - below) / below) / weight
                # A matrix times its own transpose takes half the products.
                whole, root = np.empty((len(y), size)), np.sqrt(weight)
                whole[:, 0], whole[:, -1] = root, target * root
                np.multiply(z, root[:, None], out=whole[:, 1:-1])
                total += whole.T @ whole
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size, dtype=np.int32)), pa.array([[loss], *total.tolist()], pa.list_(pa.float64()))], ["row", "v"])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [group["row"].iloc[0]], "v": [np.sum(np.vstack(group["v"].to_numpy()), axis=0)]})

    found = rows.mapInArrow(products, "row int, v array<double>").groupBy("row").applyInPandas(added, "row int, v array<double>")
    total, loss = np.zeros((size, size)), 0.0
    for r in found.collect():
        if r.row < 0:
            loss = r.v[0]
        else:
            total[r.row] = r.v
    return loss, total


def _solve(total: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Minimises the weighted squared error plus ``penalty`` times the squared slopes."""
    weight, sx, sy = total[0, 0], total[0, 1:-1], total[0, -1]
    mx, my = sx / weight, sy / weight
    xx = total[1:-1, 1:-1] - weight * np.outer(mx, mx) + penalty * np.eye(len(sx))
    slopes = np.linalg.lstsq(xx, total[1:-1, -1] - weight * mx * my, rcond=None)[0]
    return slopes, float(my - slopes @ mx)


def fit_kernel(df: DataFrame, label: str, vector: str = "features", C: float = 1.0, epsilon: float = 0.1,
               gamma: float | None = None, kernel: str = "rbf", size: int = 128, steps: int = 100,
               seed: int = SEED, tolerance: float = TOLERANCE) -> KernelModel:
    """Minimise ½|w|² + C·Σ max(0, |y - f| - ε); the step with the lowest objective is kept.

    The steps end when the objective falls by less than ``tolerance`` of itself, at the latest after
    ``steps``.  A table without rows, and labels or features that are not finite, are a ``ValueError``.
    """
    one = df.select(vector).first()
    if one is None or one[0] is None:
        raise ValueError("no rows to fit on")
    width = len(one[0])
    if kernel != "linear" and gamma is None:
        gamma = default_gamma(df, vector, width)
    fmap = FeatureMap(kernel, width, gamma or 0.0, size, seed)
    rows = df.select(vector_to_array(vector).alias("x"), F.col(label).cast("double").alias("y"))
    best, losses, solution = None, [], None
    for step in range(steps + 1):
        loss, total = _pass(rows, fmap, epsilon, solution)
        if loss is None or not np.isfinite(total).all():
            raise ValueError("labels or features are not finite")
        if solution is not None:
            losses.append(0.5 * float(solution[0] @ solution[0]) + C * loss)
            last = best[0] if best is not None else math.inf
            if losses[-1] < last:
                best = (losses[-1], solution)
            if losses[-1] > last * (1 - tolerance) or not total[0, 0]:
                break
        if step < steps:
            solution = _solve(total, 0.5 / C)
    (slopes, intercept) = best[1]
    return KernelModel(fmap, tuple(map(float, slopes)), intercept, tuple(losses))
