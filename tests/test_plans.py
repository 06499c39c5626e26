"""Shapes of the physical plans that matter on large tables."""

from __future__ import annotations

import contextlib
import io

from conftest import SMALL
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from loomstat.operators import clean, combine, explain, features, profile
from loomstat.sources import tables


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def exchanges(text: str) -> int:
    return sum(" Exchange (" in line or "- Exchange (" in line for line in text.split("\n\n")[0].splitlines())


def test_trim_reaches_the_scan(spark):
    orders = table(spark, "orders")
    kept = clean.fit_trim(orders, ["o_totalprice"]).apply(orders).select("o_orderkey")
    text = plan(kept)
    assert "GreaterThanOrEqual(o_totalprice" in text and "LessThanOrEqual(o_totalprice" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text
    assert exchanges(text) == 0


def test_unique_join_of_four_tables_needs_one_shuffle(spark):
    parts = [table(spark, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias(f"v{i}"))
             for i in range(4)]
    assert exchanges(plan(combine.combine_on_key(parts, "k", "unique"))) == 1


def test_split_and_preprocessing_do_not_shuffle(spark):
    parts = features.assign_split(table(spark, "part"), ["p_partkey"])
    fitted = features.fit_preprocessor(parts, ["p_size"], ["p_type"])
    assert exchanges(plan(fitted.transform(parts))) == 0


def test_top_n_is_limited_before_the_shuffle(spark):
    top = explain.top_n(table(spark, "lineitem"), ["l_returnflag"], "l_extendedprice", 5, "l_orderkey")
    text = plan(top)
    assert text.count("WindowGroupLimit (") >= 2


def test_summaries_read_only_their_columns(spark):
    text = plan(profile.correlation(table(spark, "lineitem"), ["l_tax", "l_discount"]))
    assert "ReadSchema: struct<l_discount:double,l_tax:double>" in text


def test_hot_joins_grow_by_a_fixed_part_per_table(spark):
    def scans(n):
        parts = [table(spark, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias(f"v{i}")) for i in range(n)]
        return plan(combine.combine_on_key(parts, "k", "hot")).split("\n\n")[0].count("Scan parquet")

    assert scans(3) == scans(7)


def test_group_totals_do_not_shuffle_the_rows(spark):
    lines = table(spark, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    shared = explain.share_within(lines, ["l_returnflag"], "l_quantity", "share")
    assert exchanges(plan(shared)) == 0 and "BroadcastHashJoin" in plan(shared)


def test_partitions_are_written_without_sorting(spark, tmp_path, monkeypatch):
    """A few partitions are open at once, so that their rows are not sorted, and spilled, before; the setting is given back."""
    setting, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    before = spark.conf.get(setting)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (seen.append(int(spark.conf.get(setting))), write(self, path))[1])
    rows = spark.range(1000).selectExpr("id", "id % 3 as a", "cast(id % 2 as string) as b")
    tables.save_table(rows, str(tmp_path / "t"), ["a", "b"])
    assert seen == [tables.OPEN_FILES] and spark.conf.get(setting) == before
    assert sorted(map(tuple, tables.load_table(spark, str(tmp_path / "t")).select("id", "a", "b").collect())) == [(i, i % 3, i % 2) for i in range(1000)]
