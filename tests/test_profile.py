from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import distribution, profile


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


def test_correlation_of_constant_is_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (1.0, 3.0, 2.0), (1.0, None, 9.0)], "c double, a double, b double")
    got = {(r.a, r.b): (r.r, r.n) for r in profile.correlation(df, ["c", "a", "b"]).collect()}
    assert got["a", "c"] == (None, 2)
    assert got["b", "a"] == (pytest.approx(1.0), 2)
    assert profile.correlation(df, ["a", "b"], triangle=False).count() == 4


def test_incomplete_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(None if rng.random() < .3 else float(v) for v in (i % 7, 1e6 + i, 5.0, 3 * i + rng.normal())) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r.a, r.b): (r.r, r.n) for r in profile.correlation(df, ["a", "b", "c", "d"]).collect()}
    fits = {(r.feature, r.target): r for r in profile.univariate_fit(df, ["a", "b", "c"], ["d"]).collect()}
    for i, x in enumerate("abcd"):
        for j, y in enumerate("abcd"[:i]):
            both = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
            want = None if "c" in (x, y) else pytest.approx(np.corrcoef(both.T)[0, 1])
            assert got[x, y] == (want, len(both))
            if x == "d" and y != "c":
                slope, intercept = np.polyfit(both[:, 1], both[:, 0], 1)
                fit = fits[y, x]
                assert (fit.slope, fit.r2) == (pytest.approx(slope, rel=1e-6), pytest.approx(np.corrcoef(both.T)[0, 1] ** 2))
                assert fit.intercept == pytest.approx(intercept, rel=1e-6)
    assert fits["c", "d"].slope is None and fits["c", "d"].n > 0


@pytest.mark.parametrize("width", [2, 3, 4, 5])
def test_a_pair_does_not_depend_on_the_other_columns(spark, width):
    """NaN and null are missing values, for 1, 3, 6 and 10 pairs."""
    nan = float("nan")
    rows = [(1.0, 2.0), (2.0, 1.0), (nan, 7.0), (4.0, 6.0), (3.0, None)]
    df = spark.createDataFrame([(*r, *(float(i * j) for j in range(2, width))) for i, r in enumerate(rows)],
                               ", ".join(f"c{i} double" for i in range(width)))
    names = df.columns
    want = np.corrcoef([1, 2, 4], [2, 1, 6])[0, 1]
    got = {(r.a, r.b): (r.r, r.n) for r in profile.correlation(df, names, triangle=False).collect()}
    assert len(got) == width * width
    assert got["c1", "c0"] == got["c0", "c1"] == (pytest.approx(want), 3)
    assert got["c0", "c0"] == (pytest.approx(1.0), 4)
    fits = {(r.feature, r.target): r for r in profile.univariate_fit(df, names[:1] + names[2:], ["c1"]).collect()}
    assert fits["c0", "c1"].n == 3 and fits["c0", "c1"].r2 == pytest.approx(want**2)


def test_many_columns_are_split_over_aggregations(spark):
    names = [f"c{i}" for i in range(9)]
    rng = np.random.default_rng(0)
    data = rng.normal(size=(40, 9))
    df = spark.createDataFrame([tuple(map(float, row)) for row in data], ", ".join(f"{n} double" for n in names))
    want = np.corrcoef(data.T)
    for r in profile.correlation(df, names).collect():
        assert r.r == pytest.approx(want[names.index(r.a), names.index(r.b)])


@pytest.mark.parametrize("values,bins", [([1, 2, 2, 9, None], 4), ([3, 3, 3], 5), ([7], 3), (list(range(50)), "fd"),
                                         (list(range(50)), "auto"), ([1, 1, 1, 1, 50], "fd")])
def test_histogram_agrees_with_numpy(spark, values, bins):
    clean = [v for v in values if v is not None]
    counts, edges = np.histogram(clean, bins=bins)
    rows = sorted(distribution.histogram(frame(spark, values), "x", bins, density=True).collect(), key=lambda r: r.bin)
    assert [r.n for r in rows] == list(counts)
    assert [r.lower for r in rows] == pytest.approx(list(edges[:-1]))
    assert sum(r.density * (r.upper - r.lower) for r in rows) == pytest.approx(1.0)
    if isinstance(bins, int):
        many = sorted(distribution.histograms(frame(spark, values), ["x"], bins).collect(), key=lambda r: r.bin)
        assert [(r.n, r.lower) for r in many] == [(r.n, pytest.approx(r.lower)) for r in rows]


def test_far_outlier_gets_all_its_bins(spark):
    """A width rule on data with a far outlier asks for many bins; all are listed, none refused."""
    values = [float(i) for i in range(1000)] + [1e7]
    got = distribution.histogram(frame(spark, values), "x", "fd")
    row = got.selectExpr("count(*) bins", "sum(n) n", "max(bin) last", "count_if(n > 0) used").first()
    assert row.bins == row.last + 1 > 90_000 and row.n == 1001 and row.used <= 12


@pytest.mark.parametrize("bins", ["auto", "fd", 7])
def test_facets_together_as_one_by_one(spark, bins):
    rng = np.random.default_rng(1)
    rows = [(f"t{i % 3}", f"m{i % 2}", float(rng.normal() * (1 + i % 3))) for i in range(300)] + [("one", "m0", 2.0), ("one", "m1", 2.0)]
    df = spark.createDataFrame(rows, "t string, m string, x double")
    got = distribution.grouped_density(df, "x", "t", ["m"], bins)
    for facet in ("t0", "t1", "t2", "one"):
        want = distribution.histogram(df.filter(f"t = '{facet}'"), "x", bins, ["m"], True).orderBy("m", "bin").collect()
        own = got.filter(f"t = '{facet}'").orderBy("m", "bin").collect()
        assert [(r.m, r.bin, r.n) for r in own] == [(r.m, r.bin, r.n) for r in want]
        assert [r.density for r in own] == pytest.approx([r.density for r in want])
        assert [r.lower for r in own] == pytest.approx([r.lower for r in want])


def test_histogram_of_nothing(spark):
    assert distribution.histogram(frame(spark, [None]), "x").count() == 0


def test_grouped_histogram_normalises_each_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 9.0)], "g string, x double")
    rows = distribution.histogram(df, "x", 4, ["g"], density=True).collect()
    for g in "ab":
        assert sum(r.density * (r.upper - r.lower) for r in rows if r.g == g) == pytest.approx(1.0)
    assert len(rows) == 8


def test_kde_agrees_with_direct_sum(spark):
    values = np.random.default_rng(5).normal(size=60)
    h = values.std(ddof=1) * 60 ** -0.2
    rows = distribution.kde(frame(spark, values), "x", 30).orderBy("x").collect()
    xs = np.linspace(values.min(), values.max(), 30)
    want = np.exp(-0.5 * ((xs[:, None] - values) / h) ** 2).sum(axis=1) / (60 * h * np.sqrt(2 * np.pi))
    assert [r.x for r in rows] == pytest.approx(list(xs))
    assert [r.density for r in rows] == pytest.approx(list(want))
    assert distribution.kde(frame(spark, [1, 1]), "x").count() == 0


def test_kde_far_points_are_exact(spark):
    values = [0.0, 1e-3, 2e-3, 1e6]
    rows = distribution.kde(frame(spark, values * 50), "x", 20).collect()
    assert len(rows) == 20 and all(r.density >= 0 for r in rows)


def test_box_statistics(spark):
    rows = [("a", v) for v in [1, 2, 3, 4, 100, -100]] + [("b", 5), ("c", None), (None, 1), ("d", 0), ("d", 0), ("d", 0), ("d", 100)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, y double")
    got = {r.category: r for r in distribution.box_stats(df, "g", "y").collect()}
    assert set(got) == {"a", "b", "d"}
    assert (got["a"].whisker_low, got["a"].whisker_high, got["a"].outliers) == (1.0, 4.0, 2)
    assert (got["b"].q1, got["b"].median, got["b"].whisker_high, got["b"].outliers) == (5.0, 5.0, 5.0, 0)
    assert (got["d"].q3, got["d"].whisker_high) == (25.0, 25.0)
    ends = {r.category: r for r in distribution.box_stats(df, "g", "y", (5, 95)).collect()}
    assert ends["a"].whisker_low == pytest.approx(np.quantile([1, 2, 3, 4, 100, -100], .05))


def test_regression_band_covers_the_line(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 300)
    y = 2 * x + rng.normal(size=300)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k int, x double, y double")
    rows = profile.regression_band(df, "x", "y", ["k"], reps=200, grid=10).collect()
    assert all(r.low <= r.fit <= r.high for r in rows)
    # The usual standard error of the line at its centre is 1/sqrt(300).
    centre = min(rows, key=lambda r: abs(r.x - x.mean()))
    assert (centre.high - centre.low) / 3.92 == pytest.approx(1 / np.sqrt(300), rel=0.35)


def test_low_cardinality_limit(spark):
    df = spark.createDataFrame([(i % 20, i % 21) for i in range(420)], "a int, b int")
    assert profile.low_cardinality(df, ["a", "b"]) == ["a"]


def test_univariate_skips_empty_pairs(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (2.0, None, 4.0)], "a double, b double, t double")
    rows = profile.univariate_fit(df, ["a", "b"], ["t"]).collect()
    assert [(r.feature, r.slope, r.r2, r.n) for r in rows] == [("a", pytest.approx(2.0), pytest.approx(1.0), 2)]


def test_bands_of_all_pairs_together(spark):
    rng = np.random.default_rng(11)
    rows = [(i, float(rng.normal(1e3, 5)), None if i % 7 == 0 else float(i), float(3 * i + rng.normal()), 1.0) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, a double, b double, t double, flat double")
    both = profile.regression_bands(df, ["a", "b", "flat"], ["t"], ["k"], reps=200, grid=5).collect()
    assert {r.feature for r in both} == {"a", "b"}  # a constant has no line
    for f in "ab":
        own = sorted((r for r in both if r.feature == f), key=lambda r: r.x)
        one = profile.regression_band(df, f, "t", ["k"], 200, 5).orderBy("x").collect()
        assert [(r.x, r.fit, r.low, r.high) for r in own] == [pytest.approx(tuple(r)) for r in one]
        there = np.array([(r[1 if f == "a" else 2], r[3]) for r in rows if r[1 if f == "a" else 2] is not None])
        slope, intercept = np.polyfit(there[:, 0], there[:, 1], 1)
        assert [r.fit for r in own] == pytest.approx([intercept + slope * r.x for r in own], rel=1e-6)
        assert all(r.low <= r.fit <= r.high for r in own)


def test_boxes_and_counts_of_all_categories_together(spark):
    rows = [("xyz"[i % 3], i % 2, float(i * i % 37), float(i)) for i in range(80)] + [(None, 1, 5.0, None)]
    df = spark.createDataFrame(rows, "column string, flag int, y double, z double")
    got = distribution.box_tables(df, ["column", "flag"], ["y", "z"]).collect()
    for c in ("column", "flag"):
        for t in ("y", "z"):
            want = distribution.box_stats(df.withColumn("_c", F.col(c).cast("string")), "_c", t).orderBy("category").collect()
            own = sorted((r for r in got if (r.column, r.target) == (c, t)), key=lambda r: r.category)
            assert [tuple(r)[2:] for r in own] == [tuple(r) for r in want]
    counts = {(r.column, r.value): r.n for r in profile.category_counts(df, ["column", "flag"]).collect()}
    assert counts == {("column", "x"): 27, ("column", "y"): 27, ("column", "z"): 26, ("flag", "0"): 40, ("flag", "1"): 41}


@pytest.mark.parametrize("values", [
    [0.0, 1.0, 2.0, 4.0, 8.0, 16.0], list(np.random.default_rng(3).normal(size=3000)), list(np.random.default_rng(4).pareto(1.2, 2000)),
    [0.0] * 500 + [1e6], list(np.random.default_rng(5).integers(0, 3, 900))])
def test_kde_by_moments_within_its_error(spark, values):
    x = np.array(values, dtype=float)
    h = x.std(ddof=1) * len(x) ** -0.2
    got = distribution.kde(frame(spark, [float(v) for v in x]).repartition(3), "x", 60, cut=1.0).orderBy("x").collect()
    at = np.array([r.x for r in got])
    exact = np.exp(-0.5 * ((at[:, None] - x[None, :]) / h) ** 2).sum(axis=1)
    bound = len(x) * distribution.kde_error() + 1e-13 * exact.max()
    assert distribution.kde_error() < 1e-15
    assert np.abs(np.array([r.density for r in got]) * len(x) * h * np.sqrt(2 * np.pi) - exact).max() <= bound


def test_kde_leaves_the_scan_as_cells(spark):
    x = np.random.default_rng(3).normal(size=20_000)
    literals = {"x": {"lo": x.min(), "step": 1.0, "h": x.std() * len(x) ** -0.2}}
    cells = distribution.kde_cells(frame(spark, [float(v) for v in x]), literals)
    assert cells.count() <= np.ptp(x) / literals["x"]["h"] + 1 and len(cells.columns) == 2 + distribution.TERMS
    assert cells.agg(F.sum("m0")).first()[0] == len(x)


def test_automatic_bins_read_the_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return v

    df = spark.range(500).select((F.col("id") % 2).cast("string").alias("t"), F.lit("m").alias("m"), F.udf(counted, "double").asNondeterministic()(F.col("id").cast("double")).alias("x"))
    got = distribution.grouped_density(df, "x", "t", ["m"], "auto", direct_rows=10).collect()
    assert sum(r.n for r in got) == 500 and seen.value == 500
