"""Session settings and the shared scratch folder used for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "loomstat", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is written for.

    Cluster-specific values (executors, memory, shuffle partitions) are left to
    spark-submit; ``conf`` adds or overrides settings.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the tasks, wherever the driver was started.

    An archive of the package's sources is added to the application's files, once.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="loomstat-package-"), "loomstat.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder, because there driver and tasks share a disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="loomstat-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_scratch: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; :func:`remove_scratch` deletes it."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete one scratch path that nothing reads any more."""
    own = _scratch.get(spark.sparkContext.applicationId, [])
    if path in own:
        own.remove(path)
        _delete(spark, path)


def remove_scratch(spark: SparkSession) -> int:
    """Delete all scratch paths of this application, once nothing reads them any more; returns their number."""
    paths = _scratch.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that later plans start from stored rows."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Rows up to which a table is broadcast after it was counted.
BROADCAST_ROWS = 100_000


def counted_broadcast(df: DataFrame) -> DataFrame:
    """``df`` stored, and marked for broadcasting if it is counted to be small; otherwise a plain join side."""
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def spread_rows(df: DataFrame) -> DataFrame:
    """A scan in fewer partitions than there are cores, spread over the cores.

    Meant for scans without a shuffle, whose partitions are known from planning.  Large
    tables have more partitions than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def materialise(df: DataFrame) -> DataFrame:
    """Rows that several jobs read, as a Parquet table in the shared folder.

    Later jobs read only the columns they need, and a lost executor costs no more than
    reading again.  A table in fewer partitions than there are cores is also spread over
    the cores: it is small then, and the work per row that follows is not.
    """
    spark = df.sparkSession

    def stored(rows: DataFrame) -> DataFrame:
        path = scratch_path(spark, "rows")
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    cores = spark.sparkContext.defaultParallelism
    table = stored(df)
    return table if table.rdd.getNumPartitions() >= cores else stored(table.repartition(cores))
