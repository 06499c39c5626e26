"""What several operators need: tables, labels, files in the shared folder."""

from __future__ import annotations

import ctypes
import posixpath
import sys
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def stored(df: DataFrame, label: str = "rows") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later jobs start from it, whatever is lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> tuple[str, ...]:
    """The wanted names, with underscores appended until no column of ``df`` bears them, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def seeded_sample(df: DataFrame, key: str, rows: int, total: int | None = None) -> DataFrame:
    """The ``rows`` rows with the smallest hashes of their keys, all if there are fewer.

    A first cut at twice the expected hash leaves about 2 * ``rows`` rows to be sorted, however
    large the table is.
    """
    total = df.count() if total is None else total
    place = F.pmod(F.xxhash64(key), F.lit(1 << 31))
    cut = int(min(1.0, (2 * rows + 100) / max(total, 1)) * (1 << 31))
    return df.where(place < cut).orderBy(place, key).limit(rows)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that all machines share (file:, hdfs:, s3: ...)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


_cache: tuple[object, object] | None = None


def worker_cache(key: object, make):
    """What ``make`` returned for ``key``, kept by this Python worker for its next task.

    A worker keeps one such thing: asking for another, or :func:`drop_worker_cache`, lets it go, so
    that operators that follow each other on the same workers do not add up their memory.
    """
    global _cache
    if _cache is None or _cache[0] != key:
        drop_worker_cache()
        _cache = (key, make())
    return _cache[1]


def drop_worker_cache() -> None:
    global _cache
    _cache = None
    release_memory()


def release_memory() -> None:
    """Gives back to the system what this worker has freed; called at the end of tasks with large arrays.

    Workers are kept for later tasks and other operators, and would keep their largest size.
    """
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in the GNU C library
        if trim is not None:
            trim(0)


class WholeFile:
    """Writes a file under a passing name and gives it its own name when closed without an error.

    A task that is run again, or twice at once, leaves one whole file.
    """

    def __init__(self, folder: str, name: str):
        self.fs, root = open_folder(folder)
        self.fs.create_dir(root, recursive=True)
        self.path = posixpath.join(root, name)
        self.passing = f"{self.path}.{uuid.uuid4().hex}.part"

    def __enter__(self) -> pa.NativeFile:
        self.stream = self.fs.open_output_stream(self.passing, compression=None)
        return self.stream

    def __exit__(self, kind, *_) -> None:
        self.stream.close()
        if kind is None:
            self.fs.move(self.passing, self.path)
        else:
            self.fs.delete_file(self.passing)
