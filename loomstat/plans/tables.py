"""Reading the sample tables the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Floating-point columns rounded, so that results compare across engines.

    Adding 0.0 turns a negative zero into zero.
    """
    floating = {n for n, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*[(F.round(F.col(c), special.get(c, digits)) + F.lit(0.0)).alias(c) if c in floating
                       else F.col(c) for c in df.columns])
