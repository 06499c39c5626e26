"""Histograms, kernel density curves and box statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import counted_broadcast, materialise
from .quantiles import DIRECT_ROWS, quantile_values, quantiles

# Empty bins are listed in runs of this length, so that no row holds all of them.
BIN_RUN = 4_096

# Moments that a cell of a kernel density keeps.
TERMS = 21


def _edges(values: DataFrame, bins: int | str, direct_rows: int) -> tuple[float, float, int]:
    """Lower end, bin width and number of bins."""
    ends = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")).first()
    lo, hi, n = ends["lo"], ends["hi"], ends["n"]
    if lo is None:
        return 0.0, 1.0, 0
    if isinstance(bins, int):
        count = bins
    else:
        q1, q3 = quantile_values(values, ["x"], [0.25, 0.75], direct_rows)["x"]
        by_spread = 2.0 * (q3 - q1) / n ** (1 / 3)
        by_count = (hi - lo) / (math.log2(n) + 1)
        if bins == "fd":
            width = by_spread
        elif bins == "auto":
            width = min(by_spread, by_count) if by_spread > 0 else by_count
        else:
            raise ValueError(f"unknown bin rule {bins!r}")
        count = max(1, math.ceil((hi - lo) / width)) if width > 0 else 1
    if lo == hi:
        # One value only: a unit range around it.
        return lo - 0.5, 1.0 / count, count
    return lo, (hi - lo) / count, count


def _bin_runs(count: int):
    """First bins of all runs."""
    return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"), F.lit(BIN_RUN).cast("long"))


def histogram(df: DataFrame, col: str, bins: int | str = 30, by: Sequence[str] = (), density: bool = False,
              direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """(by…, bin, lower, upper, n[, density]): equal-width counts, the last bin closed on the right.

    ``bins`` is a number, ``"fd"`` or ``"auto"``.  The edges are shared by all groups;
    the density is normalised within each group.  Empty bins are listed.
    """
    by = list(by)
    values = df.select(*by, F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double")).alias("x")).filter(
        "x is not null")
    lo, width, count = _edges(values, bins, direct_rows)
    position = F.floor((F.col("x") - F.lit(lo)) / F.lit(width))
    kind = "int" if count < 1 << 31 else "long"
    bin_of = F.greatest(F.least(position, F.lit(count - 1)), F.lit(0)).cast(kind)
    counted = values.groupBy(*by, bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # The bins of each group as (bin, 0) rows beside the counted ones: no join is needed for empty bins.
    groups = counted.select(*by).distinct() if by else df.sparkSession.range(1).select()
    empty = groups.select(*by, F.explode(_bin_runs(count)).alias("_run")).select(
        *by, F.explode(F.sequence("_run", F.least(F.col("_run") + (BIN_RUN - 1), F.lit(count - 1)))).alias("bin"),
        F.lit(0).cast("long").alias("n")) if count else counted.limit(0)
    full = counted.unionByName(empty.withColumn("bin", F.col("bin").cast(kind))).groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    lower = F.lit(lo) + F.col("bin") * F.lit(width)
    result = full.select(*by, "bin", lower.alias("lower"), (lower + F.lit(width)).alias("upper"), "n")
    if not density:
        return result
    if by:
        total = F.sum("n").over(W.partitionBy(*by))
        return result.withColumn("density", F.col("n") / (total * F.lit(width)))
    total = values.count()
    return result.withColumn("density", F.col("n") / F.lit(float(total) * width))


def grouped_density(df: DataFrame, col: str, facet: str, by: Sequence[str], bins: int | str = "auto",
                    direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Density histograms whose edges are shared inside one facet and normalised per group.

    The edges of all facets come from one aggregation (and one of quantiles), and all bins are
    counted together.  For automatic bins the values are stored first.  Rows with a null facet are left out.
    """
    by = list(by)
    values = df.select(facet, *by, F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double")).alias("x"))
    values = values.dropna(subset=[facet, "x"])
    if not isinstance(bins, int):
        values = materialise(values)  # the quantiles read it several times, and a text file is dear to parse
    ends = values.groupBy(facet).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("_n"))
    if isinstance(bins, int):
        count = F.lit(bins).cast("long")
    elif bins in ("fd", "auto"):
        quarts = quantiles(values, ["x"], [0.25, 0.75], [facet], direct_rows).groupBy(facet).agg(
            (F.max("value") - F.min("value")).alias("_spread"))
        ends = ends.join(quarts, facet)
        by_spread = 2.0 * F.col("_spread") / F.pow(F.col("_n"), F.lit(1 / 3))
        by_count = (F.col("hi") - F.col("lo")) / (F.log2(F.col("_n").cast("double")) + 1)
        width = by_spread if bins == "fd" else F.when(by_spread > 0, F.least(by_spread, by_count)).otherwise(by_count)
        count = F.when(width > 0, F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / width))).otherwise(1).cast("long")
    else:
        raise ValueError(f"unknown bin rule {bins!r}")
    flat = F.col("lo") == F.col("hi")  # one value only: a unit range around it
    edges = ends.withColumn("_count", count).select(
        facet, "_count", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("_lo"),
        (F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / F.col("_count")).alias("_width"))
    shape = ["_count", "_lo", "_width"]
    placed = values.join(counted_broadcast(edges), facet)
    bin_of = F.greatest(F.least(F.floor((F.col("x") - F.col("_lo")) / F.col("_width")), F.col("_count") - 1), F.lit(0))
    counted = placed.groupBy(facet, *by, *shape, bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    last = F.col("_count") - 1
    empty = counted.select(facet, *by, *shape).distinct().select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(BIN_RUN).cast("long"))).alias("_run")).select(
        facet, *by, *shape, F.explode(F.sequence("_run", F.least(F.col("_run") + (BIN_RUN - 1), last))).alias("bin"),
        F.lit(0).cast("long").alias("n"))
    full = counted.unionByName(empty).groupBy(facet, *by, *shape, "bin").agg(F.sum("n").alias("n"))
    lower = F.col("_lo") + F.col("bin") * F.col("_width")
    total = F.sum("n").over(W.partitionBy(facet, *by))
    return full.select(*by, F.col("bin").cast("int").alias("bin"), lower.alias("lower"), (lower + F.col("_width")).alias("upper"), "n",
                       (F.col("n") / (total * F.col("_width"))).alias("density"), facet)


def _column_entries(df: DataFrame, literals: dict[str, dict[str, float]]) -> DataFrame:
    """(column, v, and the literals of the column): one row per present value of each column."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("v"),
                 *[F.lit(float(x)).alias(n) for n, x in values.items()])
        for c, values in literals.items()])).alias("_e")).select("_e.*").filter("v is not null")


def _extents(df: DataFrame, cols: Sequence[str]) -> dict[str, dict[str, float]]:
    """Count, sample std, min and max of every column, from one pass; columns without values are left out."""
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
    row = df.agg(*[f(clean[c]).alias(f"_{n}{i}") for i, c in enumerate(cols) for n, f in (
        ("n", F.count), ("sd", F.stddev_samp), ("lo", F.min), ("hi", F.max))]).first()
    return {c: {n: row[f"_{n}{i}"] for n in ("n", "sd", "lo", "hi")} for i, c in enumerate(cols) if row[f"_n{i}"]}


def histograms(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """(column, bin, lower, upper, n) of many columns with a fixed number of bins, in two passes."""
    literals = {}
    for c, e in _extents(df, cols).items():
        flat = e["lo"] == e["hi"]
        literals[c] = {"lo": e["lo"] - 0.5 if flat else e["lo"],
                       "width": 1.0 / bins if flat else (e["hi"] - e["lo"]) / bins}
    if not literals:
        return df.sparkSession.createDataFrame([], "column string, bin int, lower double, upper double, n long")
    entries = _column_entries(df, literals)
    position = F.floor((F.col("v") - F.col("lo")) / F.col("width"))
    bin_of = F.greatest(F.least(position, F.lit(bins - 1)), F.lit(0)).cast("int")
    counted = entries.groupBy("column", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.createDataFrame(
        [(c, i, e["lo"] + i * e["width"], e["lo"] + (i + 1) * e["width"]) for c, e in literals.items()
         for i in range(bins)], "column string, bin int, lower double, upper double")
    return edges.join(counted, ["column", "bin"], "left").fillna(0, ["n"])


def kdes(df: DataFrame, cols: Sequence[str], grid: int = 200, cut: float = 0.0) -> DataFrame:
    """(column, x, density): Gaussian kernel densities on even grids, bandwidth n^(-1/5)·std.

    A fast Gauss transform: values fall into cells one bandwidth wide, and a cell keeps the first
    ``TERMS`` moments of its values about its centre, added up in one aggregation.  With s and t the
    distances of a value and a grid point from the centre in units of √2 bandwidths, the kernel is
    Σ sⁿ/n! · hₙ(t), hₙ the Hermite functions.  As |s| ≤ 1/√8 and |hₙ(t)| ≤ 1.09 · √(2ⁿ n!), the terms left
    out are less than 1.09 · 2 · 2⁻ᴺ / √N! for N terms (:func:`kde_error`): below the rounding of a double
    beside a kernel of 1.  What leaves the scan are cells, and then at most ``grid`` rows per column and task.
    Columns without spread have no curve.
    """
    literals, scales = {}, {}
    for c, e in _extents(df, cols).items():
        if e["sd"] and not math.isnan(e["sd"]):
            h = e["sd"] * e["n"] ** -0.2
            lo, hi = e["lo"] - cut * h, e["hi"] + cut * h
            literals[c] = {"lo": lo, "step": (hi - lo) / (grid - 1), "h": h}
            scales[c] = 1.0 / (e["n"] * h * math.sqrt(2 * math.pi))
    if not literals:
        return df.sparkSession.createDataFrame([], "column string, x double, density double")
    sums = _kernel_sums(kde_cells(df, literals), literals, grid).groupBy("column", "i").agg(F.sum("s").alias("s"))
    points = df.sparkSession.createDataFrame(
        [(c, i, e["lo"] + i * e["step"], scales[c]) for c, e in literals.items() for i in range(grid)],
        "column string, i int, x double, scale double")
    return points.join(sums, ["column", "i"], "left").select(
        "column", "x", (F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.0)) * F.col("scale")).alias("density"))


def kde_error(terms: int = TERMS) -> float:
    """The most that leaving out later terms changes the kernel of one value, whose peak is 1."""
    return 1.09 * 2 * 0.5 ** terms / math.sqrt(math.factorial(terms))


def kde_cells(df: DataFrame, literals: dict[str, dict[str, float]]) -> DataFrame:
    """(column, cell, m0, m1, …): moments sⁿ/n! of the values of every cell."""
    place = _column_entries(df, literals).withColumn("_at", (F.col("v") - F.col("lo")) / F.col("h")).withColumn("cell", F.floor("_at"))
    s = place.select("column", "cell", ((F.col("_at") - F.col("cell") - 0.5) / math.sqrt(2)).alias("_s"))
    powers = [F.lit(1.0)]
    for n in range(1, TERMS):
        powers.append(powers[-1] * F.col("_s") / F.lit(float(n)))
    return s.groupBy("column", "cell").agg(*[F.sum(p).alias(f"m{n}") for n, p in enumerate(powers)])


def _kernel_sums(cells: DataFrame, literals: dict[str, dict[str, float]], grid: int) -> DataFrame:
    """(column, i, s): the kernels of each task's cells added up at the grid points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch["column"].to_numpy(zero_copy_only=False)
            place = batch["cell"].to_numpy()
            moments = np.stack([batch[f"m{n}"].to_numpy() for n in range(TERMS)])
            for name in np.unique(names):
                e, own = literals[name], np.flatnonzero(names == name)
                x = (e["lo"] + np.arange(grid) * e["step"] - e["lo"]) / e["h"]
                for a in range(0, len(own), 1024):
                    part = own[a : a + 1024]
                    t = (x[None, :] - place[part, None] - 0.5) / math.sqrt(2)
                    last, now = np.zeros_like(t), np.exp(-t * t)
                    added = moments[0, part] @ now
                    for n in range(1, TERMS):
                        last, now = now, 2 * t * now - 2 * (n - 1) * last
                        added += moments[n, part] @ now
                    total[name] = total.get(name, 0.0) + added
        for name, added in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * grid, pa.string()), pa.array(np.arange(grid, dtype=np.int32)), pa.array(added)], ["column", "i", "s"])

    return cells.mapInArrow(run, "column string, i int, s double")


def kde(df: DataFrame, col: str, grid: int = 200, cut: float = 0.0) -> DataFrame:
    """(x, density) of one column; see :func:`kdes`."""
    return kdes(df, [col], grid, cut).select("x", "density")


def box_stats(df: DataFrame, cat: str, y: str, whisker: str | tuple[float, float] = "tukey",
              direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Box statistics of ``y`` per category; categories without values are left out.

    ``"tukey"``: (cat, n, q1, median, q3, whisker_low, whisker_high, outliers) with whiskers
    at the furthest values inside 1.5 interquartile ranges, never inside the box.  A pair of percentiles gives
    whiskers at those percentiles instead, without an outlier count.
    """
    values = df.select(F.col(cat).alias("category"), F.nanvl(F.col(y).cast("double"), F.lit(None).cast("double"))
                       .alias("y")).dropna()
    return _boxes(values, ["category"], whisker, direct_rows)


def box_tables(df: DataFrame, cats: Sequence[str], ys: Sequence[str], whisker: str | tuple[float, float] = "tukey",
               direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """(column, target, …) : :func:`box_stats` of every target by every category column, computed together."""
    entries = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(y).alias("target"), F.col(c).cast("string").alias("category"),
                 F.nanvl(F.col(y).cast("double"), F.lit(None).cast("double")).alias("y")) for c in cats for y in ys]))
    return _boxes(df.select(entries.alias("_e")).select("_e.*").dropna(), ["column", "target", "category"], whisker, direct_rows)


def _boxes(values: DataFrame, by: Sequence[str], whisker: str | tuple[float, float], direct_rows: int) -> DataFrame:
    by = list(by)
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    if whisker != "tukey":
        probs = {**probs, "whisker_low": whisker[0] / 100, "whisker_high": whisker[1] / 100}
    # The quantile table has a column named "column" of its own.
    own = [f"_by_{c}" for c in by]
    long = quantiles(values.withColumnsRenamed(dict(zip(by, own, strict=True))), ["y"], list(probs.values()), own, direct_rows)
    box = long.drop("column").withColumnsRenamed(dict(zip(own, by, strict=True))).groupBy(*by).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in probs.items()])
    if whisker != "tukey":
        n = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        return box.join(n, by).select(*by, "n", "q1", "median", "q3", "whisker_low", "whisker_high")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("y").between(F.col("q1") - reach, F.col("q3") + reach)
    return values.join(counted_broadcast(box), by).groupBy(*by, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.least(F.min(F.when(inside, F.col("y"))), F.col("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(inside, F.col("y"))), F.col("q3")).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    ).select(*by, "n", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")
