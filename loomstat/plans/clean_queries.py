"""Queries that clean and combine the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, combine, profile
from ..session import scratch_path
from ..sources import tables as sources
from ..sources.topics import TopicStore
from ..spec import classify, is_numeric, parse_spec, unlabelled
from .tables import rounded, table

PART_SPEC = parse_spec([
    {"name": "size", "source": "p_size", "file": "part", "type": "numeric", "role": "feature", "unit": "cm"},
    {"name": "kind", "source": "p_type", "file": "part", "type": "categorical", "role": "feature"},
    {"name": "brand", "source": "p_brand", "file": "part", "type": "categorical", "role": "feature"},
    {"name": "grade", "source": "p_grade", "file": "part", "type": "numeric", "role": "feature"},
    {"name": "price", "source": "p_retailprice", "file": "part", "type": "numeric", "role": "target",
     "drop_extrema": True, "log_transform": True, "unit": "USD", "display_name": "Retail price"},
], key="p_partkey", sentinels={"size": [7, 9]})

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
STATUS_WORDS = {"F": "finished", "O": "open"}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


def scan_project_rename(spark: SparkSession, folder: str) -> DataFrame:
    topic = sources.read_topic(spark, f"{folder}/part.parquet", PART_SPEC, "part", fmt="parquet")
    return topic.withColumn("size", F.col("size").cast("double"))


# Columns of the part table under names that the transport format can hold.
TRANSPORT_NAMES = {"p_partkey": "PARTKEY", "p_name": "NAME", "p_brand": "BRAND", "p_type": "TYPE", "p_size": "SIZE",
                   "p_retailprice": "PRICE"}

# Topics of two cycles; the scoring cycle has no file of the third one.
CYCLE_SPEC = parse_spec([
    {"name": "balance", "source": "BAL", "file": "CUST_I", "type": "numeric", "role": "feature"},
    {"name": "orders", "source": "N", "file": "ORD_I", "type": "numeric", "role": "feature"},
    {"name": "spend", "source": "SPEND", "file": "ORD_I", "type": "numeric", "role": "target"},
    {"name": "nation", "source": "NATION", "file": "PLACE_I", "type": "categorical", "role": "feature"},
], key="CUSTKEY")
CYCLE_START = "1998-01-01"


def xport_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All parts written as transport files, one per task, and read again as one folder."""
    parts = table(spark, folder, "part").select(*[F.col(c).alias(n) for c, n in TRANSPORT_NAMES.items()])
    path = scratch_path(spark, "part-xport")
    sources.write_xport(parts.repartition(4, "PARTKEY"), path)
    return sources.read_file(spark, path)


def cycle_files(spark: SparkSession, folder: str) -> DataFrame:
    """Topic files of two cycles, the later one without one topic, read by one specification and combined."""
    base = scratch_path(spark, "cycles")
    customers = table(spark, folder, "customer").withColumnsRenamed({"c_custkey": "CUSTKEY", "c_acctbal": "BAL", "c_nationkey": "NATION"})
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "CUSTKEY")
    sides = {None: F.col("o_orderdate") < CYCLE_START, "H": F.col("o_orderdate") >= CYCLE_START}
    parts = []
    for cycle, own in sides.items():
        paths = sources.topic_paths(CYCLE_SPEC, base, cycle)
        sources.write_xport(customers.select("CUSTKEY", "BAL"), paths["CUST_I"])
        sources.write_xport(orders.filter(own).groupBy("CUSTKEY").agg(
            F.count(F.lit(1)).alias("N"), F.round(F.sum("o_totalprice"), 2).alias("SPEND")), paths["ORD_I"])
        if cycle is None:
            sources.write_xport(customers.select("CUSTKEY", "NATION"), paths["PLACE_I"])
        found = sources.existing_topics(spark, paths)
        topics = [sources.read_topic(spark, p, CYCLE_SPEC, f) for f, p in found.items()]
        parts.append(combine.combine_on_key(topics, CYCLE_SPEC.key, "unique").withColumn("cycle", F.lit(cycle or "I")))
    return rounded(parts[0].unionByName(parts[1], allowMissingColumns=True), 2)


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    stored = sources.store_csv(orders, "orders-csv")
    return sources.read_csv(spark, stored, orders.schema).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.max("o_orderkey").alias("last_key"))


def sentinel_to_null(spark: SparkSession, folder: str) -> DataFrame:
    part = clean.recode_sentinels(table(spark, folder, "part").select("p_brand", "p_size"), {"p_size": [7, 9]})
    return part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count("p_size").alias("n_present"),
                                       F.count_if(F.col("p_size").isNull()).alias("n_absent"))


SENTINEL_RULES = {"p_size": [7, 9], "p_brand": ["Brand#3", "Brand#4"], "p_type": ["PROMO"]}


def sentinel_row_drop(spark: SparkSession, folder: str) -> DataFrame:
    kept, removed = clean.drop_sentinel_rows(table(spark, folder, "part"), SENTINEL_RULES)
    rest = profile.shape_report(kept).select(F.lit(len(SENTINEL_RULES)).alias("step"), F.lit("kept").alias("rule"),
                                             F.col("n_rows").alias("removed"))
    return removed.unionByName(rest)


def percentile_trim(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return clean.fit_trim(orders, ["o_totalprice"]).apply(orders)


def percentile_trim_chain(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag")
    bounds = clean.fit_trim(lines, ["l_quantity", "l_extendedprice"])
    return rounded(clean.trim_report(lines, bounds), 4)


def minmax_trim(spark: SparkSession, folder: str) -> DataFrame:
    sized = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    return clean.drop_extreme_rows(sized, ["p_size", "p_retailprice"])


def value_map(spark: SparkSession, folder: str) -> DataFrame:
    orders = clean.map_values(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"),
                              {"o_orderstatus": STATUS_WORDS})
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key"))


def _labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return combine.combine_on_key([documents, table(spark, folder, "labels")], "doc_id")


def missing_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(clean.missing_ratio(_labelled_documents(spark, folder)))


def sparse_columns_dropped(spark: SparkSession, folder: str) -> DataFrame:
    kept, _ = clean.drop_sparse_columns(_labelled_documents(spark, folder))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"),
                                    F.lit(",".join(sorted(kept.columns))).alias("columns_kept"))


def ordered_counts(spark: SparkSession, folder: str) -> DataFrame:
    orders = clean.order_levels(table(spark, folder, "orders").select("o_orderpriority"), "o_orderpriority",
                                PRIORITIES)
    return profile.value_counts(orders, "o_orderpriority", dropna=False, levels=PRIORITIES)


def rule_violations(spark: SparkSession, folder: str) -> DataFrame:
    joined = _labelled_documents(spark, folder)
    return clean.quality_report(joined, {
        "chars are positive": F.col("n_chars") > 0,
        "chars at least 200": F.col("n_chars") >= 200,
        "quality present": F.col("quality").isNotNull(),
        "not toxic": F.col("toxic") == 0,
    })


def positive_weight_filter(spark: SparkSession, folder: str) -> DataFrame:
    return clean.filter_positive(table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"),
                                 "c_acctbal")


def _topics(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "documents": table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars"),
        "labels": table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic"),
        "pages": table(spark, folder, "pages").select(F.col("page_id").alias("id"), F.length("url").alias("url_chars")),
        "customer": table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"),
    }


def outer_join_fold(spark: SparkSession, folder: str) -> DataFrame:
    return combine.combine_on_key(list(_topics(spark, folder).values()), "id")


def outer_join_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """The same tables stored in buckets of the key, combined without moving a row."""
    parts = _topics(spark, folder)
    store = TopicStore(spark, scratch_path(spark, "topics"), "id", buckets=8)
    for name, rows in parts.items():
        store.write(name, rows)
    return store.combine(list(parts))


def outer_join_fold_dups(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_linenumber", "l_quantity")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_totalprice")
    return combine.combine_on_key([lines, orders], "orderkey")


def target_dropna(spark: SparkSession, folder: str) -> DataFrame:
    return clean.drop_missing_targets(_labelled_documents(spark, folder), ["quality", "toxic"])


def column_classification(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    found = classify(part, ["p_brand", "p_type", "p_name"], ["p_retailprice"], "p_partkey")
    kinds = {**dict.fromkeys(found.numeric, "numeric"), **dict.fromkeys(found.categorical, "categorical"),
             **dict.fromkeys(found.targets, "target"), "p_partkey": "key"}
    numeric = {f.name for f in part.schema.fields if is_numeric(f.dataType)}
    wide = part.agg(*[f(c).alias(f"{c}_{n}") for c in part.columns
                      for n, f in (("present", F.count), ("levels", F.count_distinct))])
    return profile.stack_rows(wide, [
        {"column": F.lit(c), "kind": F.lit(kinds[c]), "is_numeric": F.lit(c in numeric),
         "present": F.col(f"{c}_present"), "levels": F.col(f"{c}_levels"),
         "low_cardinality": F.col(f"{c}_levels") <= 20}
        for c in part.columns
    ])


def unmapped_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of the part table without a label, with how many values each leaves unlabelled."""
    part = table(spark, folder, "part")
    bare = unlabelled(part.columns, {f.source: f.label for f in PART_SPEC.features})
    wide = part.agg(*[F.count(c).alias(c) for c in bare])
    return profile.stack_rows(wide, [{"column": F.lit(c), "present": F.col(c)} for c in bare])


def label_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Column means joined with the specification's labels and units."""
    topic = sources.read_topic(spark, f"{folder}/part.parquet", PART_SPEC, "part", fmt="parquet")
    means = topic.agg(F.avg("size").alias("size"), F.avg("price").alias("price")).unpivot(
        [], ["size", "price"], "name", "mean")
    dim = PART_SPEC.as_frame(spark).select("name", "display_name", "unit", "role")
    return rounded(means.join(dim, "name", "left"), 4)


def row_concat_tagged(spark: SparkSession, folder: str) -> DataFrame:
    """Customer and supplier balances stacked with a tag."""
    both = combine.concat_rows([
        table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal")),
        table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal")),
    ], tag="party", tags=["customer", "supplier"])
    return rounded(both.groupBy("party", "nation").agg(F.count(F.lit(1)).alias("n"), F.avg("bal").alias("mean_bal")), 4)


def melt_measures(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    long = combine.melt(lines, ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"], "measure", "value")
    return rounded(long.groupBy("l_returnflag", "measure").agg(F.avg("value").alias("mean"),
                                                               F.count("value").alias("n")))


def spread_measures(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return combine.spread(events, ["user_id"], "event_type", "n", EVENT_TYPES)


def distinct_union(spark: SparkSession, folder: str) -> DataFrame:
    return combine.distinct_values([
        table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation")),
        table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation")),
    ], "nation")


def key_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without a label."""
    return combine.difference(table(spark, folder, "documents").select("doc_id"),
                              table(spark, folder, "labels").select("doc_id"))


_LABELLED = "(SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, source, n_chars, quality, toxic" \
            " FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id)"

QUERIES = {
    "scan_project_rename": (scan_project_rename, """
        SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_type AS kind, p_brand AS brand, p_retailprice AS price
        FROM part"""),
    "xport_round_trip": (xport_round_trip, """
        SELECT p_partkey::DOUBLE AS "PARTKEY", p_name AS "NAME", p_brand AS "BRAND", p_type AS "TYPE", p_size::DOUBLE AS "SIZE",
               p_retailprice AS "PRICE" FROM part"""),
    "cycle_files": (cycle_files, f"""
        WITH o AS (SELECT o_custkey, CASE WHEN o_orderdate < '{CYCLE_START}' THEN 'I' ELSE 'H' END AS cycle, count(*)::DOUBLE AS orders,
                          round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY ALL),
        c AS (SELECT c_custkey, c_acctbal, c_nationkey, cycle FROM customer, (VALUES ('I'), ('H')) v(cycle))
        SELECT coalesce(c_custkey, o_custkey)::DOUBLE AS "CUSTKEY", coalesce(c.cycle, o.cycle) AS cycle, round(c_acctbal, 2) AS balance,
               orders, spend, CASE WHEN c.cycle = 'I' THEN c_nationkey::DOUBLE END AS nation
        FROM c FULL JOIN o ON o.cycle = c.cycle AND o_custkey = c_custkey"""),
    "csv_round_trip": (csv_round_trip, """
        SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last_key
        FROM orders GROUP BY 1"""),
    "sentinel_to_null": (sentinel_to_null, """
        SELECT p_brand, count(*) AS n, count(CASE WHEN p_size NOT IN (7, 9) THEN 1 END) AS n_present,
               count(CASE WHEN p_size IN (7, 9) THEN 1 END) AS n_absent
        FROM part GROUP BY 1"""),
    "sentinel_row_drop": (sentinel_row_drop, """
        WITH t AS (SELECT CASE WHEN p_size IN (7, 9) THEN 0 WHEN p_brand IN ('Brand#3', 'Brand#4') THEN 1
                               WHEN p_type = 'PROMO' THEN 2 ELSE 3 END AS step FROM part),
        r AS (SELECT * FROM (VALUES (0, 'p_size'), (1, 'p_brand'), (2, 'p_type'), (3, 'kept')) v(step, rule))
        SELECT r.step, r.rule, count(t.step) AS removed FROM r LEFT JOIN t ON r.step = t.step GROUP BY ALL"""),
    "percentile_trim": (percentile_trim, """
        SELECT o_orderkey, o_totalprice FROM orders,
          (SELECT quantile_cont(o_totalprice, 0.05) AS lo, quantile_cont(o_totalprice, 0.95) AS hi FROM orders)
        WHERE o_totalprice BETWEEN lo AND hi"""),
    "percentile_trim_chain": (percentile_trim_chain, """
        WITH a AS (SELECT quantile_cont(l_quantity, 0.05) AS lo, quantile_cont(l_quantity, 0.95) AS hi FROM lineitem),
        s AS (SELECT lineitem.* FROM lineitem, a WHERE l_quantity BETWEEN lo AND hi),
        b AS (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM s)
        SELECT 0 AS step, 'l_quantity' AS "column", round(lo, 4) AS "lower", round(hi, 4) AS "upper",
               (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM s) AS removed FROM a
        UNION ALL
        SELECT 1, 'l_extendedprice', round(lo, 4), round(hi, 4),
               (SELECT count(*) FROM s WHERE NOT l_extendedprice BETWEEN b.lo AND b.hi) FROM b"""),
    "minmax_trim": (minmax_trim, """
        SELECT p_partkey, p_size, p_retailprice FROM part,
          (SELECT min(p_size) a, max(p_size) b, min(p_retailprice) c, max(p_retailprice) d FROM part)
        WHERE p_size NOT IN (a, b) AND p_retailprice NOT IN (c, d)"""),
    "value_map": (value_map, """
        SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS o_orderstatus,
               count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY 1"""),
    "missing_profile": (missing_profile, f"""
        WITH t AS {_LABELLED},
        m AS (SELECT avg((doc_id IS NULL)::INT) AS doc_id, avg((lang IS NULL)::INT) AS lang,
              avg((source IS NULL)::INT) AS source, avg((n_chars IS NULL)::INT) AS n_chars,
              avg((quality IS NULL)::INT) AS quality, avg((toxic IS NULL)::INT) AS toxic FROM t)
        SELECT "column", round(ratio, 6) AS ratio FROM m UNPIVOT (ratio FOR "column" IN (COLUMNS(*)))"""),
    "sparse_columns_dropped": (sparse_columns_dropped, f"""
        SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, 'doc_id,lang,n_chars,source' AS columns_kept
        FROM {_LABELLED} GROUP BY 1"""),
    "ordered_counts": (ordered_counts, """
        SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS "value", count(*) AS n,
               CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(substr(o_orderpriority, 1, 1) AS INT) END AS rank
        FROM orders GROUP BY 1, 3"""),
    "rule_violations": (rule_violations, f"""
        WITH t AS {_LABELLED}
        SELECT 'chars are positive' AS rule, count(*) FILTER (NOT coalesce(n_chars > 0, FALSE)) AS violations FROM t
        UNION ALL SELECT 'chars at least 200', count(*) FILTER (NOT coalesce(n_chars >= 200, FALSE)) FROM t
        UNION ALL SELECT 'quality present', count(*) FILTER (quality IS NULL) FROM t
        UNION ALL SELECT 'not toxic', count(*) FILTER (NOT coalesce(toxic = 0, FALSE)) FROM t"""),
    "positive_weight_filter": (positive_weight_filter, """
        SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0"""),
    **{name: (run, """
        SELECT id, lang, n_chars, quality, toxic, url_chars, c_acctbal
        FROM (SELECT doc_id AS id, lang, n_chars FROM documents)
        FULL JOIN (SELECT doc_id AS id, quality, toxic FROM labels) USING (id)
        FULL JOIN (SELECT page_id AS id, CAST(length(url) AS INT) AS url_chars FROM pages) USING (id)
        FULL JOIN (SELECT c_custkey AS id, c_acctbal FROM customer) USING (id)""")
       for name, run in (("outer_join_fold", outer_join_fold), ("outer_join_buckets", outer_join_buckets))},
    "outer_join_fold_dups": (outer_join_fold_dups, """
        SELECT orderkey, l_linenumber, l_quantity, o_totalprice
        FROM (SELECT l_orderkey AS orderkey, l_linenumber, l_quantity FROM lineitem)
        FULL JOIN (SELECT o_orderkey AS orderkey, o_totalprice FROM orders) USING (orderkey)"""),
    "target_dropna": (target_dropna, f"""
        SELECT * FROM {_LABELLED} WHERE quality IS NOT NULL AND toxic IS NOT NULL"""),
    "column_classification": (column_classification, """
        WITH m AS (SELECT 'p_partkey' AS "column", 'key' AS kind, TRUE AS is_numeric, count(p_partkey) AS present,
                          count(DISTINCT p_partkey) AS levels FROM part
        UNION ALL SELECT 'p_name', 'categorical', FALSE, count(p_name), count(DISTINCT p_name) FROM part
        UNION ALL SELECT 'p_brand', 'categorical', FALSE, count(p_brand), count(DISTINCT p_brand) FROM part
        UNION ALL SELECT 'p_type', 'categorical', FALSE, count(p_type), count(DISTINCT p_type) FROM part
        UNION ALL SELECT 'p_size', 'numeric', TRUE, count(p_size), count(DISTINCT p_size) FROM part
        UNION ALL SELECT 'p_retailprice', 'target', TRUE, count(p_retailprice), count(DISTINCT p_retailprice) FROM part)
        SELECT *, levels <= 20 AS low_cardinality FROM m"""),
    "unmapped_columns": (unmapped_columns, """
        SELECT 'p_partkey' AS "column", count(p_partkey) AS present FROM part
        UNION ALL SELECT 'p_name', count(p_name) FROM part"""),
    "label_lookup": (label_lookup, """
        SELECT 'size' AS name, round(avg(p_size), 4) AS mean, 'size' AS display_name, 'cm' AS unit, 'feature' AS role
        FROM part
        UNION ALL SELECT 'price', round(avg(p_retailprice), 4), 'Retail price', 'USD', 'target' FROM part"""),
    "row_concat_tagged": (row_concat_tagged, """
        SELECT party, nation, count(*) AS n, round(avg(bal), 4) AS mean_bal FROM (
          SELECT 'customer' AS party, c_nationkey AS nation, c_acctbal AS bal FROM customer
          UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier) GROUP BY 1, 2"""),
    "melt_measures": (melt_measures, """
        SELECT l_returnflag, measure, round(avg(value), 6) AS mean, count(value) AS n FROM (
          UNPIVOT (SELECT l_returnflag, l_quantity, l_discount, l_tax FROM lineitem)
          ON l_quantity, l_discount, l_tax INTO NAME measure VALUE value) GROUP BY 1, 2"""),
    "spread_measures": (spread_measures, "SELECT user_id, " + ", ".join(
        f"nullif(count(*) FILTER (event_type = '{e}'), 0) AS {e}" for e in EVENT_TYPES) + " FROM events GROUP BY 1"),
    "distinct_union": (distinct_union, """
        SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier"""),
    "key_difference": (key_difference, """
        SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels"""),
}
