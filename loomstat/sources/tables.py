"""Scans and sinks: topic files, CSV, Parquet tables, JSON metadata."""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.clean import nan_to_null, project_features
from ..session import scratch_path
from ..spec import Spec

# How a topic file is named, and the cycle suffix that a scoring run replaces.
TOPIC_FILE = "{file}.xpt.txt"
TRAINING_CYCLE = "_I"


def topic_paths(spec: Spec, folder: str, cycle: str | None = None, pattern: str = TOPIC_FILE) -> dict[str, str]:
    """Path of every topic file; ``cycle="H"`` addresses the same topics of another cycle."""
    def name(file: str) -> str:
        return file if cycle is None else file.replace(TRAINING_CYCLE, f"_{cycle}")

    return {f: f"{folder.rstrip('/')}/{pattern.format(file=name(f))}" for f in spec.files}


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system: the cluster's default one if it names none."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jvm_path).toString()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whichever file system it names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def existing_topics(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, str]:
    """The topics whose file exists; the others are reported."""
    found = {f: p for f, p in paths.items() if path_exists(spark, p)}
    for file in sorted(set(paths) - set(found)):
        warnings.warn(f"file not found: {paths[file]}", stacklevel=2)
    return found


def write_xport(df: DataFrame, folder: str) -> None:
    """One transport file per task; :func:`read_file` reads the folder."""
    from .xport import XportSource

    df.sparkSession.dataSource.register(XportSource)
    df.write.format("xport").mode("overwrite").save(qualified(df.sparkSession, folder))


def read_file(spark: SparkSession, path: str, fmt: str = "xport", columns: list[str] | None = None,
              schema: T.StructType | str | None = None) -> DataFrame:
    """A topic file, or a folder of files of one layout, as a table; ``columns`` are read when present.

    A schema spares the pass that finds the types of text files.
    """
    if fmt == "xport":
        from .xport import XportSource

        spark.dataSource.register(XportSource)
        reader = spark.read.format("xport")
        if columns is not None:
            reader = reader.option("columns", ",".join(columns))
        return reader.load(qualified(spark, path))
    reader = spark.read.format(fmt).option("header", "true")
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", "true")
    df = reader.load(path)
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def read_topic(spark: SparkSession, path: str, spec: Spec, file: str, fmt: str = "xport") -> DataFrame:
    """The key and the configured columns of one topic, renamed, NaN as null."""
    features = spec.of_file(file)
    raw = read_file(spark, path, fmt, [spec.key, *[f.source for f in features]])
    return project_features(nan_to_null(raw), features, spec.key)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header.  Without a schema the types are inferred, which costs a second pass."""
    reader = spark.read.option("header", "true")
    if schema is None:
        return reader.option("inferSchema", "true").csv(path)
    return reader.schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def store_csv(df: DataFrame, label: str) -> str:
    """Write CSV to a fresh place in the shared folder and return it."""
    path = scratch_path(df.sparkSession, label)
    write_csv(df, path)
    return path


#: Files that a task holds open at once; beyond them it sorts its rows by partition.
OPEN_FILES = 16


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, by partition if columns are named.

    Rows go to the open file of their partition, up to ``OPEN_FILES`` of them, instead of being sorted, and spilled, first.
    """
    spark, setting = df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(max(int(before), OPEN_FILES)))
    try:
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*(partition_by or [])).parquet(path)
    finally:
        spark.conf.set(setting, before)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_metadata(spark: SparkSession, values: Mapping[str, Any], path: str) -> None:
    """Small JSON metadata next to a table, in whichever file system the path names."""
    spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_metadata(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path).first()[0])


def matrix_bundle(df: DataFrame, path: str, names: list[str]) -> None:
    """Feature vectors and labels partitioned by split, with the feature names beside them."""
    save_table(df, f"{path}/rows", ["split"])
    save_metadata(df.sparkSession, {"feature_names": names}, f"{path}/names")


def load_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    return load_table(spark, f"{path}/rows"), load_metadata(spark, f"{path}/names")["feature_names"]


def publish_views(spark: SparkSession, views: Mapping[str, DataFrame]) -> None:
    """Make result tables available to SQL under their names."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


# Declared types of the published result files.
RESIDUALS_SCHEMA = "Model string, Target string, Residual double, True double, Predicted double"


def metrics_schema(targets: list[str]) -> T.StructType:
    """Declared types of a wide metrics file."""
    return T.StructType([
        T.StructField("Model", T.StringType()),
        *[T.StructField(f"{m} - {t}", T.DoubleType()) for m in ("R2", "RMSE") for t in targets],
    ])


