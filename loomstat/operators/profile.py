"""Profiles of a table: summaries, correlations, single-feature regressions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import SEED
from ..functions.columns import key_hash, level_rank
from ..session import cut_lineage
from .quantiles import DIRECT_ROWS, quantile_values, size_measures


def stack_rows(wide: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn a one-row table of results into one row per entry of ``rows``."""
    entries = F.array(*[F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows])
    return wide.select(F.explode(entries).alias("_row")).select("_row.*")


def describe(df: DataFrame, cols: Sequence[str], digits: int | None = None,
             direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max; one row per column."""
    cols = list(cols)
    measures = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    found = df.agg(*size_measures(cols), *[
        f(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(f"_{name}{i}")
        for i, c in enumerate(cols) for name, f in measures.items()]).first()
    quarts = quantile_values(df, cols, [0.25, 0.5, 0.75], direct_rows,
                             [(found[f"_n{i}"], found[f"_d{i}"]) for i in range(len(cols))])
    ordered = df.sparkSession.createDataFrame(
        [(c, *[found[f"_{n}{i}"] for n in ("n", "mean", "std", "min")], *quarts[c], found[f"_max{i}"])
         for i, c in enumerate(cols)],
        "column string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")
    if digits is None:
        return ordered
    # Rounding to 9 digits first removes the last-bit noise that would decide an exact half.
    return ordered.select("column", "count", *[F.bround(F.round(c, 9), digits).alias(c) for c in ordered.columns[2:]])


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, n, means, variances and covariance) over the rows where both are present, b not after a.

    Null and NaN count as missing.  An infinite value leaves the pairs of its column without a
    number.

    One pass for any number of columns: every task multiplies its rows' value and presence
    matrices and passes on one row per pair, so p columns cost p² small sums and not p²
    aggregate expressions.  Values are shifted by the column mean, which keeps the sums
    free of cancellation.
    """
    cols = list(cols)
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols]
    means = df.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(clean)]).first()
    shift = [m if (m := means[f"_m{i}"]) is not None and math.isfinite(m) else 0.0 for i in range(len(cols))]
    shifted = df.select(*[(c - F.lit(m)).alias(f"_x{i}") for i, (c, m) in enumerate(zip(clean, shift, strict=True))])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(cols)
        n, sx, sxx, sxy = (np.zeros((p, p)) for _ in range(4))
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan)
            there = (~np.isnan(x)).astype(float)
            x = np.where(there > 0, x, 0.0)
            n += there.T @ there
            sx += x.T @ there
            sxx += (x * x).T @ there
            sxy += x.T @ x
        i, j = np.tril_indices(p)
        yield pd.DataFrame({"i": i, "j": j, "n": n[i, j].astype("int64"), "sa": sx[i, j], "sb": sx[j, i],
                            "saa": sxx[i, j], "sbb": sxx[j, i], "sab": sxy[i, j]})

    parts = shifted.mapInPandas(sums, "i int, j int, n long, sa double, sb double, saa double, sbb double, sab double")
    total = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    name, move = F.array(*[F.lit(c) for c in cols]), F.array(*[F.lit(float(m)) for m in shift])

    def at(array, index: str):
        return F.element_at(array, F.col(index) + 1)

    def spread(squares: str, plain: str, index: str):
        # Below the rounding of the values themselves, a spread is that of a constant.
        variance = F.expr(f"{squares} / n - ({plain} / n) * ({plain} / n)")
        return F.when(variance > 1e-28 * (at(move, index) * at(move, index)), variance).otherwise(F.lit(0.0))

    return total.filter("n > 0").select(
        at(name, "i").alias("a"), at(name, "j").alias("b"), "n",
        (at(move, "i") + F.expr("sa / n")).alias("mean_a"), (at(move, "j") + F.expr("sb / n")).alias("mean_b"),
        spread("saa", "sa", "i").alias("var_a"), spread("sbb", "sb", "j").alias("var_b"),
        F.expr("sab / n - (sa / n) * (sb / n)").alias("cov"))


def correlation(df: DataFrame, cols: Sequence[str], triangle: bool = True) -> DataFrame:
    """(a, b, r, n) for pairs of columns; ``triangle`` keeps each pair once, without the diagonal.

    All pairs come from one reading of the table (:func:`pair_moments`), whatever their number.
    """
    cols = list(cols)
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i if triangle else i + 1)]
    spread = F.nullif(F.sqrt(F.col("var_a")) * F.sqrt(F.col("var_b")), F.lit(0.0))
    listed = df.sparkSession.createDataFrame(pairs, "a string, b string")
    found = pair_moments(df, cols).select("a", "b", (F.col("cov") / spread).alias("r"), "n")
    result = listed.join(found, ["a", "b"], "left").fillna(0, ["n"])
    if triangle:
        return result
    mirrored = result.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r", "n")
    return result.unionByName(mirrored)


def univariate_fit(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """(feature, target, slope, intercept, r2, n) of least squares on complete pairs.

    Pairs without any complete row are left out; a constant feature has no slope.
    """
    features, targets = list(features), list(targets)
    # Targets come after the features, so they are the first column of every mixed pair.
    moments = pair_moments(df, [*features, *targets]).filter(F.col("a").isin(targets) & F.col("b").isin(features))
    slope = F.col("cov") / F.nullif(F.col("var_b"), F.lit(0.0))
    share = F.when(F.col("var_b") > 0, F.when(F.col("var_a") > 0, slope * F.col("cov") / F.col("var_a")).otherwise(1.0))
    return moments.select(F.col("b").alias("feature"), F.col("a").alias("target"), slope.alias("slope"),
                          (F.col("mean_a") - slope * F.col("mean_b")).alias("intercept"), share.alias("r2"), "n")


def value_counts(df: DataFrame, col: str, dropna: bool = True, levels: Sequence | None = None) -> DataFrame:
    """(value, n); ``levels`` adds the level position and sorts by it, values outside come last."""
    rows = df.filter(F.col(col).isNotNull()) if dropna else df
    counts = rows.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if levels is None:
        return counts.orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", level_rank(F.col("value"), levels)).orderBy(F.asc_nulls_last("rank"))


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) of the non-null values of many columns, from one aggregation."""
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    return df.select(entries.alias("_e")).select("_e.*").filter("value is not null").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))


def level_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, levels): distinct non-null values of every column."""
    wide = df.agg(*[F.count_distinct(c).alias(f"_d{i}") for i, c in enumerate(cols)])
    return stack_rows(wide, [{"column": F.lit(c), "levels": F.col(f"_d{i}")} for i, c in enumerate(cols)])


def low_cardinality(df: DataFrame, cols: Sequence[str], limit: int = 20) -> list[str]:
    """The columns with at most ``limit`` distinct values."""
    return [r["column"] for r in level_counts(df, cols).filter(F.col("levels") <= limit).collect()]


def column_extent(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, min, max) from one pass."""
    wide = df.agg(*[f(F.col(c).cast("double")).alias(f"_{n}{i}") for i, c in enumerate(cols)
                    for n, f in (("min", F.min), ("max", F.max))])
    return stack_rows(wide, [{"column": F.lit(c), "min": F.col(f"_min{i}"), "max": F.col(f"_max{i}")}
                             for i, c in enumerate(cols)])


def shape_report(df: DataFrame) -> DataFrame:
    """One row with the number of rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def _poisson_steps() -> np.ndarray:
    """Where the distribution function of a Poisson(1) count rises."""
    term, upto, steps = 0.36787944117144233, 0.36787944117144233, []
    for k in range(1, 13):
        steps.append(upto)
        term /= k
        upto += term
    return np.array(steps)


def regression_bands(df: DataFrame, features: Sequence[str], targets: Sequence[str], key: Sequence[str], reps: int = 1000,
                     grid: int = 100, level: float = 0.95, seed: int = SEED) -> DataFrame:
    """(feature, target, x, fit, low, high): least-squares lines with bootstrap bands on even grids.

    Every row gets a Poisson(1) weight per replicate that depends only on its key: two
    hashes of the key, the second times the replicate added to the first.  One reading of the
    rows serves all replicates of all pairs: each task multiplies the weights of its rows with
    their products and passes on one row per pair and replicate.  A pair without two different
    feature values has no line and is left out.
    """
    features, targets = list(features), list(targets)
    cols = list(dict.fromkeys([*features, *targets]))
    pairs = [(cols.index(f), cols.index(t)) for t in targets for f in features]
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols]
    means = df.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(clean)]).first()
    shift = np.array([m if (m := means[f"_m{i}"]) is not None and math.isfinite(m) else 0.0 for i in range(len(cols))])
    rows = df.select(*[c.alias(f"_x{i}") for i, c in enumerate(clean)], key_hash(key, f"start{seed}").alias("_h"),
                     key_hash(key, f"step{seed}").alias("_s"))
    steps, numbers = _poisson_steps(), np.arange(1, reps + 1, dtype=np.int64)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Replicate 0 weighs every row once: the line itself.
        total = np.zeros((len(pairs), reps + 1, 5))
        ends = np.tile([np.inf, -np.inf], (len(pairs), 1))
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.iloc[start:start + 2048]
                x = part[[f"_x{i}" for i in range(len(cols))]].to_numpy(dtype=float, na_value=np.nan)
                drawn = (part["_h"].to_numpy(dtype=np.int64)[:, None] + numbers[None, :] * part["_s"].to_numpy(dtype=np.int64)[:, None])
                uniform = np.mod(drawn, 2**32) / float(2**32)
                weight = np.hstack([np.ones((len(part), 1)), np.searchsorted(steps, uniform, side="right")]).astype(float)
                for p, (i, j) in enumerate(pairs):
                    there = ~(np.isnan(x[:, i]) | np.isnan(x[:, j]))
                    if there.any():
                        a, b = x[there, i] - shift[i], x[there, j] - shift[j]
                        total[p] += weight[there].T @ np.stack([np.ones(len(a)), a, b, a * a, a * b], axis=1)
                        ends[p] = min(ends[p, 0], x[there, i].min()), max(ends[p, 1], x[there, i].max())
        shape = (len(pairs), reps + 1)
        yield pd.DataFrame({
            "pair": np.repeat(np.arange(shape[0]), shape[1]), "rep": np.tile(np.arange(shape[1]), shape[0]),
            **{n: total[:, :, k].ravel() for k, n in enumerate(("sw", "sx", "sy", "sxx", "sxy"))},
            "lo": np.repeat(ends[:, 0], shape[1]), "hi": np.repeat(ends[:, 1], shape[1])})

    schema = "pair int, rep int, sw double, sx double, sy double, sxx double, sxy double, lo double, hi double"
    added = rows.mapInPandas(sums, schema).groupBy("pair", "rep").agg(
        *[F.sum(c).alias(c) for c in ("sw", "sx", "sy", "sxx", "sxy")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    slope = F.try_divide(F.expr("sw * sxy - sx * sy"), F.expr("sw * sxx - sx * sx"))
    lines = added.withColumn("b", slope).withColumn("a", F.expr("try_divide(sy - b * sx, sw)")).dropna(subset=["a", "b"])
    lines = cut_lineage(lines.filter("lo < hi").select("pair", "rep", "a", "b", "lo", "hi"))
    step = (F.col("hi") - F.col("lo")) / F.lit(max(grid - 1, 1))
    points = lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("x", F.col("lo") + F.col("i") * step)

    def moved(which: int):
        return F.element_at(F.array(*[F.lit(float(shift[pair[which]])) for pair in pairs]), F.col("pair") + 1)

    points = points.withColumn("at", moved(1) + F.col("a") + F.col("b") * (F.col("x") - moved(0)))
    tail = (1 - level) / 2
    band = points.groupBy("pair", "i", "x").agg(
        F.max(F.when(F.col("rep") == 0, F.col("at"))).alias("fit"),
        F.percentile(F.when(F.col("rep") > 0, F.col("at")), F.array(F.lit(tail), F.lit(1 - tail))).alias("ends"))

    def named(which: int):
        return F.element_at(F.array(*[F.lit(cols[pair[which]]) for pair in pairs]), F.col("pair") + 1)

    return band.select(named(0).alias("feature"), named(1).alias("target"), "x", "fit", F.element_at("ends", 1).alias("low"),
                       F.element_at("ends", 2).alias("high"))


def regression_band(df: DataFrame, x: str, y: str, key: Sequence[str], reps: int = 1000, grid: int = 100,
                    level: float = 0.95, seed: int = SEED) -> DataFrame:
    """(x, fit, low, high) of one pair; see :func:`regression_bands`."""
    return regression_bands(df, [x], [y], key, reps, grid, level, seed).select("x", "fit", "low", "high")
