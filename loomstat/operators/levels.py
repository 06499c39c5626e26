"""Levels of categorical columns: counted in one job, few of them listed, many of them kept as a table.

The table of a column has one row per level (level, index, count), in the order of the levels, and
lies in the shared folder.  It is built and used by Spark alone: the driver sees how many levels
there are and which one is the most frequent.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, scratch_path

#: Levels of a column up to which they are listed in the fitted preprocessing.
LISTED = 1000


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "index") -> DataFrame:
    """Numbers rows from 0 along ``order``: sorted in ranges, each range starting where the rows of those before it end.

    The sorted rows are stored, so a lost executor does not move them; what crosses ranges is one row
    per range.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ranges")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", (before - F.col("_first")).alias("_shift"))
    return stored.join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_row") + F.col("_shift")).alias(name))


def count_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, level, n) of all non-null levels of all columns, levels as text; stored.  NaN stands for a missing value, as null does."""
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    shown = {c: F.nanvl(F.col(c), F.lit(None)) if kinds[c] in ("double", "float") else F.col(c) for c in cols}
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), v.cast("string").alias("level")) for c, v in shown.items()])).alias("_e")
    path = scratch_path(spark, "levels")
    df.select(entries).select("_e.*").filter("level is not null").groupBy("column", "level").agg(
        F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.parquet(path)


def listed_levels(counts: DataFrame, kinds: dict[str, str], cols: Sequence[str]) -> dict[str, list[tuple[Any, int]]]:
    """The sorted levels and counts of columns that have few."""
    found: dict[str, list[tuple[Any, int]]] = {c: [] for c in cols}
    readers = {"double": float, "float": float, "int": int, "bigint": int, "smallint": int, "tinyint": int, "boolean": lambda text: text == "true"}
    if cols:
        for r in counts.filter(F.col("column").isin(list(cols))).collect():
            found[r["column"]].append((readers.get(kinds[r["column"]], str)(r["level"]), r["n"]))
    return {c: sorted(levels, key=lambda lv: lv[0]) for c, levels in found.items()}


def write_dictionary(counts: DataFrame, column: str, kind: str, path: str) -> tuple[Any, int]:
    """Writes the table of a column's levels; returns the most frequent level, the smallest on a tie, and their number."""
    own = counts.filter(F.col("column") == column).select(F.col("level").cast(kind).alias("level"), F.col("n").alias("count"))
    numbered(own, ["level"]).select("level", "index", "count").write.parquet(path)
    row = own.agg(F.min(F.struct((-F.col("count")).alias("n"), "level")).alias("top"), F.count(F.lit(1)).alias("levels")).first()
    return row["top"]["level"], row["levels"]


def look_up(df: DataFrame, column: str, fill: Any, dictionary: DataFrame, levels: int, name: str) -> DataFrame:
    """Adds the index of each row's level, the fill's for missing ones and ``levels`` for unknown ones.

    The table is broadcast only if it was counted to be small; a level that holds most rows is then
    split by adaptive execution.
    """
    kind = df.schema[column].dataType
    value = F.nanvl(F.col(column), F.lit(None)) if kind.simpleString() in ("double", "float") else F.col(column)
    side = dictionary.select(F.col("level").alias(f"_level{name}"), F.col("index").cast("double").alias(name))
    side = F.broadcast(side) if levels <= BROADCAST_ROWS else side
    joined = df.withColumn(f"_value{name}", F.coalesce(value, F.lit(fill).cast(kind))).join(
        side, F.col(f"_value{name}") == F.col(f"_level{name}"), "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(float(levels)))).drop(f"_value{name}", f"_level{name}")


def read_dictionary(spark: SparkSession, folder: str, column: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{column}")
