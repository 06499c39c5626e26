"""Queries for split, folds, fitted preprocessing and the flagship run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, combine, evaluate, features, models
from ..session import materialise, scratch_path, spread_rows
from ..spec import Spec, load_spec, parse_spec
from .tables import rounded, table

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]

CUSTOMER_ENTRIES = [
    {"name": "balance", "source": "c_acctbal", "file": "customer", "type": "numeric", "role": "feature",
     "drop_extrema": True, "unit": "USD"},
    {"name": "orders", "source": "n_orders", "file": "spending", "type": "numeric", "role": "feature"},
    {"name": "spend", "source": "spend", "file": "spending", "type": "numeric", "role": "target",
     "drop_extrema": True, "log_transform": True, "unit": "USD"},
]
CUSTOMER_SPEC = parse_spec(CUSTOMER_ENTRIES, key="c_custkey")


def charges(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with part attributes, net price and charge; sizes 7 and 9 count as unknown."""
    lines = spread_rows(table(spark, folder, "lineitem").select(
        *LINE_KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate"))
    parts = clean.recode_sentinels(table(spark, folder, "part").select("p_partkey", "p_type", "p_size"),
                                   {"p_size": [7, 9]})
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey").withColumn(
        "net", net).withColumn("charge", F.col("net") * (1 + F.col("l_tax")))


def hash_sql(columns: str, seed: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {columns}, '{seed}')), 1, 8))::BIGINT"


LINE_HASH = hash_sql("l_orderkey, l_partkey, l_suppkey, l_linenumber", "42")

CHARGES_SQL = f"""(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
        l_returnflag, l_shipdate, p_type, CASE WHEN p_size NOT IN (7, 9) THEN CAST(p_size AS DOUBLE) END AS p_size,
        l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
        CASE WHEN {LINE_HASH} / 4294967296.0::DOUBLE < 0.2 THEN 'test' ELSE 'train' END AS split
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def clean_join_metrics(spark: SparkSession, folder: str, spec: Spec = CUSTOMER_SPEC) -> DataFrame:
    """Topics cleaned and trimmed, combined on the key, split, prepared, fitted and scored."""
    spending = materialise(table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spend")))
    topics = {"customer": table(spark, folder, "customer"), "spending": spending}
    cleaned = [clean.clean_topic(topics[f], spec.of_file(f), spec.key, {})[0]
               for f in spec.files]
    # Both topics are grouped or keyed by customer, so the keys are known to be unique.
    wide = materialise(clean.drop_missing_targets(combine.combine_on_key(cleaned, spec.key, "unique"),
                                                  spec.targets))
    ready = features.prepare_spec(wide, spec)
    fitted = models.fit("linear", ready.train, ready.targets.names)
    scored = evaluate.residuals(fitted.predict(ready.rows), fitted.name, ready.targets, ["split"])
    return rounded(evaluate.metrics(scored, ["split", "Model", "Target"]), 6, RMSE=2)


def clean_join_from_file(spark: SparkSession, folder: str) -> DataFrame:
    """The same run by a specification that is written as a YAML file to the shared folder and read from it."""
    import yaml

    path = scratch_path(spark, "specification")
    text = yaml.safe_dump({"features": CUSTOMER_ENTRIES})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return clean_join_metrics(spark, folder, load_spec(path, "c_custkey", spark=spark))


def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey")
    return features.assign_split(orders, ["o_orderkey"])


def hash_folds(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(*LINE_KEY, "l_quantity")
    return rounded(features.assign_fold(lines, LINE_KEY, 10).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean_quantity")), 6)


def contiguous_folds(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey")
    return features.assign_contiguous_fold(orders, "o_orderkey", 7)


def _line_preprocessor(df: DataFrame, impute: str = "median") -> features.Preprocessor:
    return features.fit_preprocessor(df, ["p_size", "l_quantity", "l_extendedprice"], ["l_returnflag", "p_type"], impute)


def _numeric_stats(spark: SparkSession, folder: str, impute: str) -> DataFrame:
    rows = charges(spark, folder).select(*LINE_KEY, "p_size", "l_quantity", "l_extendedprice", "l_returnflag", "p_type")
    train = materialise(features.assign_split(rows, LINE_KEY).filter("split = 'train'").drop(*LINE_KEY))
    fitted = _line_preprocessor(train, impute)
    return rounded(spark.createDataFrame(list(fitted.numeric), "name string, fill double, mean double, std double"), 4)


def impute_scale_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _numeric_stats(spark, folder, "median")


def mean_impute_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _numeric_stats(spark, folder, "mean")


def most_frequent_fill(spark: SparkSession, folder: str) -> DataFrame:
    train = features.assign_split(table(spark, folder, "part"), ["p_partkey"]).filter("split = 'train'")
    fitted = features.fit_preprocessor(train, [], ["p_brand", "p_type", "p_name"])
    fills = spark.createDataFrame([(n, fill) for n, fill, _ in fitted.categorical], "name string, fill string")
    # Names hold the level; columns with many levels keep them as a table.
    names = fitted.name_table(spark).groupBy(F.col("base").alias("name")).agg(F.count(F.lit(1)).alias("levels"), F.min_by("name", "position").alias("_first"))
    first = F.expr("substr(_first, length(name) + 7)")
    return fills.join(F.broadcast(names), "name").select("name", "fill", "levels", first.alias("first_level"))


def many_level_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and priorities of orders: the most frequent level, the number of levels, their first and last feature."""
    orders = table(spark, folder, "orders")
    fitted = features.fit_preprocessor(orders, [], ["o_custkey", "o_orderpriority"], listed=100)
    fills = spark.createDataFrame([(n, str(fill)) for n, fill, _ in fitted.categorical], "base string, fill string")
    names = fitted.name_table(spark).groupBy("base").agg(F.count(F.lit(1)).alias("levels"), F.min("position").alias("first"),
                                                         F.min_by("name", "position").alias("first_name"), F.max_by("name", "position").alias("last_name"))
    return fills.join(names, "base")


def onehot_columns(spark: SparkSession, folder: str) -> DataFrame:
    parts = clean.recode_sentinels(table(spark, folder, "part"), {"p_size": [7, 9]})
    train = features.assign_split(parts, ["p_partkey"]).filter("split = 'train'")
    fitted = features.fit_preprocessor(train, ["p_size"], ["p_type"])
    return rounded(fitted.transform_columns(parts, ["p_partkey"]))


def onehot_many_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Every order is a level of its own: as many features, each met once."""
    orders = table(spark, folder, "orders").select("o_orderkey")
    fitted = features.fit_preprocessor(orders, [], ["o_orderkey"])
    rows = fitted.transform(orders, ["o_orderkey"])
    met = features.met_features(rows).agg(F.sum("n").alias("met"), F.max("n").alias("most"))
    return rows.agg(F.count(F.lit(1)).alias("n")).join(met).select(
        "n", F.lit(fitted.width).cast("long").alias("levels"), F.coalesce("met", F.lit(0)).alias("met"), F.coalesce("most", F.lit(0)).alias("most"))


def transform_new_cycle(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted on line items shipped before 1999, applied to the later ones."""
    rows = materialise(charges(spark, folder).select("l_shipdate", "p_size", "l_quantity", "l_extendedprice",
                                                     "l_returnflag", "p_type"))
    fitted = _line_preprocessor(rows.filter(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp")))
    later = rows.filter(F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp")).withColumn(
        "ship_year", F.year("l_shipdate"))
    out = fitted.transform_columns(later, ["ship_year"])
    return rounded(out.groupBy("ship_year").agg(F.count(F.lit(1)).alias("n"), *[
        F.avg(c).alias(c) for c in fitted.names]), 6)


def preprocessor_reload(spark: SparkSession, folder: str) -> DataFrame:
    """The saved and reloaded preprocessor gives vectors; their sums per brand."""
    parts = table(spark, folder, "part")
    fitted = features.fit_preprocessor(parts, ["p_size", "p_retailprice"], ["p_type"])
    path = scratch_path(spark, "preprocessor")
    fitted.save(spark, path)
    loaded = features.Preprocessor.load(spark, path)
    from pyspark.ml.functions import vector_to_array

    vectors = loaded.transform(parts, ["p_brand"]).select("p_brand", vector_to_array("features").alias("x"))
    sums = vectors.select("p_brand", F.posexplode("x").alias("position", "x")).groupBy("p_brand", "position").agg(
        F.sum("x").alias("total"))
    name = F.element_at(F.array(*[F.lit(n) for n in loaded.names]), F.col("position") + 1)
    return rounded(sums.select("p_brand", name.alias("name"), "total"), 4)


def target_log_scale_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderstatus", "o_totalprice")
    fitted = features.fit_targets(orders, {"o_totalprice": "log"}, scale=True)
    back = fitted.transform(orders).withColumn("back", fitted.invert("o_totalprice", F.col("label_o_totalprice")))
    return rounded(back.groupBy("o_orderstatus").agg(
        F.avg("label_o_totalprice").alias("mean_label"), F.stddev_pop("label_o_totalprice").alias("std_label"),
        F.avg("back").alias("mean_back"), F.max(F.abs(F.col("back") - F.col("o_totalprice"))).alias("largest_gap")), 4)


def matrix_bundle_reload(spark: SparkSession, folder: str) -> DataFrame:
    """Feature vectors stored by split with their names, read back."""
    from pyspark.ml.functions import vector_to_array

    from ..sources.tables import load_bundle, matrix_bundle

    ready = features.prepare(table(spark, folder, "part"), ["p_partkey"], ["p_size"], ["p_type"],
                             {"p_retailprice": "log1p"})
    path = scratch_path(spark, "bundle")
    matrix_bundle(ready.rows, path, ready.preprocessor.names)
    rows, names = load_bundle(spark, path)
    x = vector_to_array("features")
    return rounded(rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg("label_p_retailprice").alias("mean_label"),
        F.avg(F.get(x, F.lit(names.index("cat__p_type_PROMO")))).alias("promo_share")).withColumn(
        "n_features", F.lit(len(names))))


_SPEND_SQL = f"""
        WITH b AS (SELECT quantile_cont(c_acctbal, 0.05) AS lo, quantile_cont(c_acctbal, 0.95) AS hi FROM customer),
        c AS (SELECT c_custkey, c_acctbal AS balance FROM customer, b WHERE c_acctbal BETWEEN lo AND hi),
        o AS (SELECT o_custkey AS c_custkey, count(*)::DOUBLE AS orders, round(sum(o_totalprice), 2) AS spend
              FROM orders GROUP BY 1),
        ob AS (SELECT quantile_cont(spend, 0.05) AS lo, quantile_cont(spend, 0.95) AS hi FROM o),
        ot AS (SELECT o.* FROM o, ob WHERE spend BETWEEN lo AND hi),
        w AS (SELECT c_custkey, balance, orders, spend,
                     CASE WHEN {hash_sql("c_custkey", "42")} / 4294967296.0::DOUBLE < 0.2 THEN 'test' ELSE 'train' END AS split
              FROM c FULL JOIN ot USING (c_custkey) WHERE spend IS NOT NULL),
        m AS (SELECT quantile_cont(balance, 0.5) AS med, quantile_cont(orders, 0.5) AS omed FROM w WHERE split = 'train'),
        x AS (SELECT split, spend, ln(1 + spend) AS y, coalesce(balance, med) AS a, coalesce(orders, omed) AS d FROM w, m),
        f AS (SELECT avg(a) AS ma, avg(d) AS md, avg(y) AS my, var_pop(a) AS va, var_pop(d) AS vd, covar_pop(a, d) AS cad,
                     covar_pop(a, y) AS cay, covar_pop(d, y) AS cdy FROM x WHERE split = 'train'),
        k AS (SELECT *, (cay * vd - cdy * cad) / (va * vd - cad * cad) AS ba,
                     (cdy * va - cay * cad) / (va * vd - cad * cad) AS bd FROM f),
        p AS (SELECT split, spend AS t, exp(my + ba * (a - ma) + bd * (d - md)) - 1 AS g FROM x, k)
        SELECT split, 'Linear Regression' AS "Model", 'spend' AS "Target",
               round(1 - sum((t - g) ** 2) / (count(*) * var_pop(t)), 6) AS "R2",
               round(sqrt(avg((t - g) ** 2)), 2) AS "RMSE", count(*) AS n
        FROM p GROUP BY split"""


def _stats_sql(fill: str) -> str:
    return f"WITH t AS (SELECT * FROM {CHARGES_SQL} WHERE split = 'train') " + " UNION ALL ".join(f"""
        SELECT '{c}' AS name, round(any_value(f), 4) AS fill, round(avg(coalesce({c}, f)), 4) AS mean,
               round(stddev_pop(coalesce({c}, f)), 4) AS std FROM t, (SELECT {fill.format(c=c)} AS f FROM t)"""
        for c in ["p_size", "l_quantity", "l_extendedprice"])


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

QUERIES = {
    "clean_join_metrics": (clean_join_metrics, _SPEND_SQL),
    "clean_join_from_file": (clean_join_from_file, _SPEND_SQL),
    "hash_split": (hash_split, f"""
        SELECT o_orderkey, CASE WHEN {hash_sql("o_orderkey", "42")} / 4294967296.0::DOUBLE < 0.2 THEN 'test'
               ELSE 'train' END AS split FROM orders"""),
    "hash_folds": (hash_folds, f"""
        SELECT CAST({hash_sql("l_orderkey, l_partkey, l_suppkey, l_linenumber", "fold42")} % 10 AS INT) AS fold,
               count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY 1"""),
    "contiguous_folds": (contiguous_folds, """
        SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INT) AS fold FROM orders"""),
    "impute_scale_stats": (impute_scale_stats, _stats_sql("quantile_cont({c}, 0.5)")),
    "mean_impute_stats": (mean_impute_stats, _stats_sql("avg({c})")),
    "most_frequent_fill": (most_frequent_fill, f"""
        WITH t AS (SELECT * FROM part WHERE {hash_sql("p_partkey", "42")} / 4294967296.0::DOUBLE >= 0.2)
        """ + " UNION ALL ".join(f"""
        SELECT '{c}' AS name, (SELECT {c} FROM t GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS fill,
               count(DISTINCT {c}) AS levels, min({c}) AS first_level FROM t""" for c in ["p_brand", "p_type", "p_name"])),
    "many_level_fill": (many_level_fill, "".join(f"""{"UNION ALL" if i else ""}
        SELECT '{c}' AS base, (SELECT {c}::VARCHAR FROM orders GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS fill, count(DISTINCT {c}) AS levels,
               {i} * (SELECT count(DISTINCT o_custkey) FROM orders) AS first, 'cat__{c}_' || min({c}) AS first_name, 'cat__{c}_' || max({c}) AS last_name
        FROM orders """ for i, c in enumerate(["o_custkey", "o_orderpriority"]))),
    "onehot_many_levels": (onehot_many_levels, """
        SELECT sum(n)::BIGINT AS n, count(*) AS levels, sum(n)::BIGINT AS met, max(n) AS most
        FROM (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1)"""),
    "onehot_columns": (onehot_columns, f"""
        WITH p AS (SELECT p_partkey, p_type, CASE WHEN p_size NOT IN (7, 9) THEN CAST(p_size AS DOUBLE) END AS s,
                          {hash_sql("p_partkey", "42")} / 4294967296.0::DOUBLE >= 0.2 AS train FROM part),
        m AS (SELECT quantile_cont(s, 0.5) AS med FROM p WHERE train),
        f AS (SELECT med, avg(coalesce(s, med)) AS mean, stddev_pop(coalesce(s, med)) AS std FROM p, m WHERE train
              GROUP BY med)
        SELECT p_partkey, round((coalesce(s, med) - mean) / std, 6) + 0.0 AS num__p_size, """ + ", ".join(
        f"""CAST(p_type = '{t}' AS INT)::DOUBLE AS "cat__p_type_{t}" """ for t in _TYPES) + " FROM p, f"),
    "transform_new_cycle": (transform_new_cycle, f"""
        WITH t AS {CHARGES_SQL}, e AS (SELECT * FROM t WHERE l_shipdate < TIMESTAMP '1999-01-01'),
        m AS (SELECT quantile_cont(p_size, 0.5) AS med FROM e),
        f AS (SELECT any_value(med) AS med, avg(coalesce(p_size, med)) AS m1, stddev_pop(coalesce(p_size, med)) AS s1,
                     avg(l_quantity) AS m2, stddev_pop(l_quantity) AS s2, avg(l_extendedprice) AS m3,
                     stddev_pop(l_extendedprice) AS s3 FROM e, m)
        SELECT CAST(year(l_shipdate) AS INT) AS ship_year, count(*) AS n,
               round(avg((coalesce(p_size, med) - m1) / s1), 6) + 0.0 AS num__p_size,
               round(avg((l_quantity - m2) / s2), 6) + 0.0 AS num__l_quantity,
               round(avg((l_extendedprice - m3) / s3), 6) + 0.0 AS num__l_extendedprice, """ + ", ".join(
        f"""round(avg(CAST(l_returnflag = '{r}' AS INT)), 6) AS "cat__l_returnflag_{r}" """ for r in "ANR") + ", "
        + ", ".join(f"""round(avg(CAST(p_type = '{t}' AS INT)), 6) AS "cat__p_type_{t}" """ for t in _TYPES) + """
        FROM t, f WHERE l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY 1"""),
    "preprocessor_reload": (preprocessor_reload, """
        WITH f AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2,
                          stddev_pop(p_retailprice) AS s2 FROM part)
        SELECT p_brand, 'num__p_size' AS name, round(sum((p_size - m1) / s1), 4) + 0.0 AS total FROM part, f GROUP BY 1
        UNION ALL SELECT p_brand, 'num__p_retailprice', round(sum((p_retailprice - m2) / s2), 4) + 0.0 FROM part, f
                  GROUP BY 1 """ + " ".join(f"""
        UNION ALL SELECT p_brand, 'cat__p_type_{t}', sum(CAST(p_type = '{t}' AS INT))::DOUBLE FROM part GROUP BY 1"""
                                            for t in _TYPES)),
    "target_log_scale_roundtrip": (target_log_scale_roundtrip, """
        WITH f AS (SELECT avg(ln(o_totalprice)) AS m, stddev_pop(ln(o_totalprice)) AS s FROM orders),
        z AS (SELECT o_orderstatus, o_totalprice, (ln(o_totalprice) - m) / s AS z, m, s FROM orders, f)
        SELECT o_orderstatus, round(avg(z), 4) + 0.0 AS mean_label, round(stddev_pop(z), 4) AS std_label,
               round(avg(exp(z * s + m)), 4) AS mean_back,
               round(max(abs(exp(z * s + m) - o_totalprice)), 4) AS largest_gap FROM z GROUP BY 1"""),
    "matrix_bundle_reload": (matrix_bundle_reload, f"""
        SELECT CASE WHEN {hash_sql("p_partkey", "42")} / 4294967296.0::DOUBLE < 0.2 THEN 'test' ELSE 'train' END AS split,
               count(*) AS n, round(avg(ln(1 + p_retailprice)), 6) AS mean_label,
               round(avg(CAST(p_type = 'PROMO' AS INT)), 6) AS promo_share, 7 AS n_features FROM part GROUP BY 1"""),
}
