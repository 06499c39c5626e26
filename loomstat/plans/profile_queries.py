"""Queries that profile the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, distribution, profile
from ..session import materialise
from .tables import rounded, table

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice"]


def sized_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their part; sizes 7 and 9 count as unknown, so that pairs are incomplete."""
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_returnflag", *LINE_NUMBERS[:4])
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size",
                                                "p_retailprice")
    return lines.join(clean.recode_sentinels(parts, {"p_size": [7, 9]}), "l_partkey")


_SIZED = """(SELECT l_partkey, l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax, p_type,
              CASE WHEN p_size NOT IN (7, 9) THEN CAST(p_size AS DOUBLE) END AS p_size, p_retailprice
              FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def describe_numeric(spark: SparkSession, folder: str) -> DataFrame:
    # Stored: the summaries read the joined rows several times.
    return rounded(profile.describe(materialise(sized_lines(spark, folder).select(*LINE_NUMBERS)), LINE_NUMBERS), 4)


def describe_two_digits(spark: SparkSession, folder: str) -> DataFrame:
    return profile.describe(table(spark, folder, "orders"), ["o_totalprice"], digits=2)


def corr_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.correlation(materialise(sized_lines(spark, folder).select(*LINE_NUMBERS)), LINE_NUMBERS))


def corr_with_nan(spark: SparkSession, folder: str) -> DataFrame:
    """NaN counts as missing, for one pair as for many."""
    events = table(spark, folder, "events").select(
        F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value")).alias("value"),
        F.col("user_id").cast("double").alias("user"), F.when(F.col("event_type") != "view", F.col("event_id").cast("double")).alias("event"))
    one = profile.correlation(events, ["value", "user"]).withColumn("columns", F.lit(2))
    return rounded(one.unionByName(profile.correlation(events, ["value", "user", "event"]).withColumn("columns", F.lit(3))))


def corr_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.correlation(sized_lines(spark, folder), ["l_quantity", "p_size", "p_retailprice"],
                                       triangle=False))


def univariate_r2(spark: SparkSession, folder: str) -> DataFrame:
    df = sized_lines(spark, folder).withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    fits = profile.univariate_fit(df, ["l_extendedprice", "l_discount", "p_size"], ["net", "l_tax"])
    return rounded(fits.orderBy("target", F.desc("r2"), "feature"), 6, intercept=4)


def hist_30(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(distribution.histogram(table(spark, folder, "lineitem"), "l_extendedprice", 30), 4)


def hist_50_target(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(distribution.histogram(table(spark, folder, "orders"), "o_totalprice", 50), 4)


def hist_fd(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(distribution.histogram(table(spark, folder, "events"), "value", "fd"), 4)


def hist_fd_outlier(spark: SparkSession, folder: str) -> DataFrame:
    """A far value asks for very many bins; all are listed, here counted, the used ones shown."""
    events = table(spark, folder, "events").select("value")
    far = events.agg((F.max("value") * 1000).alias("value"))
    bins = distribution.histogram(events.unionByName(far), "value", "fd")
    # Fixed-size result: how many bins there are in all beside each bin that holds rows.
    total = bins.agg(F.count(F.lit(1)).alias("bins")).first()["bins"]
    return bins.filter("n > 0").select("bin", "n", F.lit(total).cast("long").alias("bins"))


def hist_density_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(distribution.histogram(table(spark, folder, "events"), "value", "auto", ["event_type"], True))


def kde_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(distribution.kde(table(spark, folder, "orders"), "o_totalprice").withColumn(
        "density", F.col("density") * 1e6), 4)


def category_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.value_counts(table(spark, folder, "part"), "p_type")


def value_counts_with_null(spark: SparkSession, folder: str) -> DataFrame:
    part = clean.recode_sentinels(table(spark, folder, "part"), {"p_size": [7, 9]})
    return profile.value_counts(part, "p_size", dropna=False)


def low_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return profile.level_counts(part, ["p_brand", "p_type", "p_size", "p_name"]).withColumn(
        "kept", F.col("levels") <= 20)


def box_tukey(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(distribution.box_stats(table(spark, folder, "events"), "event_type", "value"), 4)


def box_p5_p95(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(distribution.box_stats(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice", (5, 95)), 4)


def column_extent(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_extent(sized_lines(spark, folder), LINE_NUMBERS)


def bootstrap_band(spark: SparkSession, folder: str) -> DataFrame:
    """Band of order price against the day of the order."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("day"), "o_totalprice")
    return rounded(profile.regression_band(orders, "day", "o_totalprice", ["o_orderkey"]), 3)


def _describe_sql(source: str, cols: list[str], digits: int, rounding: str = "round") -> str:
    return " UNION ALL ".join(f"""
        SELECT '{c}' AS "column", count({c}) AS "count", {rounding}(avg({c}), {digits}) AS mean,
               {rounding}(stddev_samp({c}), {digits}) AS std, {rounding}(min({c}), {digits})::DOUBLE AS "min",
               {rounding}(quantile_cont({c}, 0.25), {digits}) AS q25, {rounding}(quantile_cont({c}, 0.5), {digits}) AS q50,
               {rounding}(quantile_cont({c}, 0.75), {digits}) AS q75, {rounding}(max({c}), {digits})::DOUBLE AS "max"
        FROM {source}""" for c in cols)


def _corr_sql(pairs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"""
        SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r,
               count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM t""" for a, b in pairs)


def _hist_sql(source: str, col: str, width_sql: str) -> str:
    return f"""
        WITH s AS (SELECT min({col}) AS lo, max({col}) AS hi, count({col}) AS n, quantile_cont({col}, 0.25) AS q1,
                          quantile_cont({col}, 0.75) AS q3 FROM {source}),
        c AS (SELECT *, {width_sql} AS bins FROM s), w AS (SELECT *, (hi - lo) / bins AS w FROM c),
        h AS (SELECT CAST(least(floor(({col} - lo) / w), bins - 1) AS INT) AS bin, count(*) AS n
              FROM {source}, w GROUP BY 1),
        g AS (SELECT unnest(range(CAST(bins AS BIGINT))) AS bin FROM w)
        SELECT CAST(g.bin AS INT) AS bin, round(lo + g.bin * w, 4) AS "lower", round(lo + g.bin * w + w, 4) AS "upper",
               coalesce(h.n, 0) AS n FROM g LEFT JOIN h ON g.bin = h.bin, w"""


QUERIES = {
    "describe_numeric": (describe_numeric, f"WITH t AS {_SIZED} " + _describe_sql("t", LINE_NUMBERS, 4)),
    "describe_two_digits": (describe_two_digits, _describe_sql("orders", ["o_totalprice"], 2, "round_even")),
    "corr_pairs": (corr_pairs, f"WITH t AS {_SIZED} " + _corr_sql(
        [(a, b) for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[:i]])),
    "corr_matrix": (corr_matrix, f"WITH t AS {_SIZED} " + _corr_sql(
        [(a, b) for a in ["l_quantity", "p_size", "p_retailprice"] for b in ["l_quantity", "p_size", "p_retailprice"]])),
    "univariate_r2": (univariate_r2, f"WITH t AS (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM {_SIZED}) "
                      + " UNION ALL ".join(f"""
        SELECT '{f}' AS feature, '{y}' AS target, round(regr_slope({y}, {f}), 6) + 0.0 AS slope,
               round(regr_intercept({y}, {f}), 4) AS intercept, round(regr_r2({y}, {f}), 6) + 0.0 AS r2,
               CAST(regr_count({y}, {f}) AS BIGINT) AS n FROM t"""
                                           for y in ["net", "l_tax"] for f in ["l_extendedprice", "l_discount", "p_size"])),
    "hist_30": (hist_30, _hist_sql("lineitem", "l_extendedprice", "30")),
    "hist_50_target": (hist_50_target, _hist_sql("orders", "o_totalprice", "50")),
    "hist_fd": (hist_fd, _hist_sql("events", "value", "ceil((hi - lo) / (2 * (q3 - q1) / n ** (1.0 / 3)))")),
    "corr_with_nan": (corr_with_nan, """
        WITH e AS (SELECT CASE WHEN event_type <> 'error' THEN value END AS v, user_id::DOUBLE AS u,
                          CASE WHEN event_type <> 'view' THEN event_id::DOUBLE END AS i FROM events),
        p AS (SELECT 'user' AS a, 'value' AS b, u AS x, v AS y FROM e UNION ALL SELECT 'event', 'value', i, v FROM e
              UNION ALL SELECT 'event', 'user', i, u FROM e),
        r AS (SELECT a, b, round(corr(x, y), 6) AS r, count(x + y) AS n FROM p GROUP BY 1, 2)
        SELECT a, b, r, n, 2 AS columns FROM r WHERE a = 'user' UNION ALL SELECT a, b, r, n, 3 FROM r"""),
    "hist_fd_outlier": (hist_fd_outlier, """
        WITH v AS (SELECT value AS x FROM events WHERE value IS NOT NULL UNION ALL SELECT max(value) * 1000 FROM events),
        q AS (SELECT min(x) AS lo, max(x) AS hi, 2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / pow(count(*), 1.0 / 3) AS w FROM v),
        b AS (SELECT *, ceil((hi - lo) / w)::BIGINT AS bins FROM q)
        SELECT CAST(least(floor((x - lo) / ((hi - lo) / bins)), bins - 1) AS INT) AS bin, count(*) AS n, any_value(bins) AS bins
        FROM v, b GROUP BY 1"""),
    "hist_density_by_group": (hist_density_by_group, """
        WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, quantile_cont(value, 0.25) AS q1,
                          quantile_cont(value, 0.75) AS q3 FROM events),
        c AS (SELECT *, ceil((hi - lo) / least(2 * (q3 - q1) / n ** (1.0 / 3), (hi - lo) / (log2(n) + 1))) AS bins
              FROM s), w AS (SELECT *, (hi - lo) / bins AS w FROM c),
        h AS (SELECT event_type, CAST(least(floor((value - lo) / w), bins - 1) AS INT) AS bin, count(*) AS n
              FROM events, w GROUP BY 1, 2),
        g AS (SELECT event_type, unnest(range(CAST(bins AS BIGINT))) AS bin
              FROM w, (SELECT DISTINCT event_type FROM events)),
        f AS (SELECT g.event_type, g.bin, coalesce(h.n, 0) AS n FROM g LEFT JOIN h
              ON g.bin = h.bin AND g.event_type = h.event_type)
        SELECT event_type, CAST(bin AS INT) AS bin, round(lo + bin * w, 6) AS "lower",
               round(lo + bin * w + w, 6) AS "upper", f.n AS n,
               round(f.n / (sum(f.n) OVER (PARTITION BY event_type) * w), 6) AS density FROM f, w"""),
    "kde_curve": (kde_curve, """
        WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n,
                          stddev_samp(o_totalprice) * count(*) ** -0.2 AS h FROM orders),
        g AS (SELECT lo + i * ((hi - lo) / 199) AS x FROM s, (SELECT unnest(range(200)) AS i))
        SELECT round(x, 4) AS x,
               round(sum(exp(-0.5 * ((x - o_totalprice) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) * 1e6, 4)
                 AS density
        FROM g, orders, s GROUP BY x"""),
    "category_counts": (category_counts, """SELECT p_type AS "value", count(*) AS n FROM part GROUP BY 1"""),
    "value_counts_with_null": (value_counts_with_null, """
        SELECT CASE WHEN p_size NOT IN (7, 9) THEN CAST(p_size AS DOUBLE) END AS "value", count(*) AS n
        FROM part GROUP BY 1"""),
    "low_cardinality": (low_cardinality, " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS levels, count(DISTINCT {c}) <= 20 AS kept FROM part"""
        for c in ["p_brand", "p_type", "p_size", "p_name"])),
    "box_tukey": (box_tukey, """
        WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                          quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
        t AS (SELECT event_type AS category, value, q1, median, q3,
                     value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
              FROM events JOIN q USING (event_type))
        SELECT category, count(*) AS n, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median,
               round(any_value(q3), 4) AS q3, round(least(min(value) FILTER (inside), any_value(q1)), 4) AS whisker_low,
               round(greatest(max(value) FILTER (inside), any_value(q3)), 4) AS whisker_high,
               count(*) FILTER (NOT inside) AS outliers
        FROM t GROUP BY 1"""),
    "box_p5_p95": (box_p5_p95, """
        SELECT o_orderpriority AS category, count(*) AS n, round(quantile_cont(o_totalprice, 0.25), 4) AS q1,
               round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3,
               round(quantile_cont(o_totalprice, 0.05), 4) AS whisker_low,
               round(quantile_cont(o_totalprice, 0.95), 4) AS whisker_high
        FROM orders GROUP BY 1"""),
    "column_extent": (column_extent, f"WITH t AS {_SIZED} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max" FROM t"""
        for c in LINE_NUMBERS)),
    "bootstrap_band": (bootstrap_band, """
        WITH p AS (SELECT o_orderkey, CAST(o_orderdate::DATE - DATE '1970-01-01' AS DOUBLE) AS x, o_totalprice AS y
                   FROM orders),
        c AS (SELECT avg(x) AS cx, avg(y) AS cy, min(x) AS lo, max(x) AS hi, regr_slope(y, x) AS fb,
                     regr_intercept(y, x) AS fa FROM p),
        u AS (SELECT rep, x - cx AS dx, y - cy AS dy,
                     ((('0x' || substr(md5(o_orderkey || '|start42'), 1, 8))::BIGINT
                      + rep * ('0x' || substr(md5(o_orderkey || '|step42'), 1, 8))::BIGINT) % 4294967296)
                     / 4294967296.0::DOUBLE AS u
              FROM p, c, (SELECT unnest(range(1, 1001)) AS rep)),
        z AS (SELECT rep, dx, dy, list_sum([CAST(u >= b AS INT) FOR b IN
                [0.36787944117144233::DOUBLE, 0.7357588823428847::DOUBLE, 0.9196986029286058::DOUBLE,
                 0.9810118431238462::DOUBLE, 0.9963401531726563::DOUBLE, 0.9994058151824183::DOUBLE,
                 0.9999167588507119::DOUBLE, 0.9999897508033253::DOUBLE, 0.999998874797402::DOUBLE,
                 0.9999998885745216::DOUBLE, 0.9999999899522336::DOUBLE, 0.9999999991683892::DOUBLE]]) AS w FROM u),
        s AS (SELECT rep, sum(w) AS sw, sum(w * dx) AS sx, sum(w * dy) AS sy, sum(w * dx * dx) AS sxx,
                     sum(w * dx * dy) AS sxy FROM z GROUP BY rep),
        l AS (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS b FROM s),
        g AS (SELECT lo + i * ((hi - lo) / 99) AS x, (sy - b * sx) / sw + cy + b * (lo + i * ((hi - lo) / 99) - cx) AS yhat,
                     fa + fb * (lo + i * ((hi - lo) / 99)) AS fit
              FROM l, c, (SELECT unnest(range(100)) AS i))
        SELECT round(x, 3) AS x, round(any_value(fit), 3) AS fit, round(quantile_cont(yhat, 0.025), 3) AS low,
               round(quantile_cont(yhat, 0.975), 3) AS high FROM g GROUP BY g.x"""),
}
