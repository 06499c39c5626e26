"""Topic tables stored in buckets of their key, so that combining them moves no row.

A store is a folder of Parquet tables, all in the same number of buckets by one key and sorted by it.
How many rows share a key is counted when a table is written, from its buckets, and kept beside it.  A
set of tables is combined along the distinct keys of all of them, a bucketed table of its own that is
built once; joining the topics to it one after the other keeps its buckets, which a chain of full outer
joins would not.  Any session can read a store: its tables are declared over the files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import combine
from .tables import load_metadata, path_exists, save_metadata

#: Buckets of a store unless it is told otherwise; at least as many as tasks should share a join.
BUCKETS = 64


@dataclass(frozen=True)
class TopicStore:
    """Bucketed tables below ``path``; all have the column ``key``."""

    spark: SparkSession
    path: str
    key: str
    buckets: int = BUCKETS

    def write(self, name: str, df: DataFrame) -> dict:
        """Writes one topic and what is known of its keys: the most rows of one key, and whether keys are missing.

        Rows of one key share a bucket, so a key with very many rows makes one large bucket; tables with
        such keys are combined by plans that split it.
        """
        about = self._write(f"{self.path}/{name}", df) | {"version": uuid.uuid4().hex}
        counts = self._table(f"{self.path}/{name}", df.schema).groupBy(self.key).count()
        row = counts.agg(F.max("count").alias("largest"), F.count_if(F.col(self.key).isNull()).alias("missing")).first()
        about |= {"largest": row["largest"] or 0, "missing": bool(row["missing"])}
        save_metadata(self.spark, about, f"{self.path}/_about/{name}")
        return about

    def _write(self, path: str, df: DataFrame) -> dict:
        passing = f"bucketed_{uuid.uuid4().hex}"
        rows = df.repartition(self.buckets, self.key)
        rows.write.mode("overwrite").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", path).saveAsTable(passing)
        self.spark.sql(f"DROP TABLE {passing}")  # the files stay: the table is not the catalogue's own
        return {"schema": df.schema.json(), "buckets": self.buckets}

    def _table(self, path: str, schema: StructType) -> DataFrame:
        """The files as a bucketed table of this session."""
        name = f"bucketed_{hashlib.sha256(path.encode()).hexdigest()[:24]}_{uuid.uuid4().hex[:8]}"
        column = f"`{self.key}`"
        self.spark.sql(f"CREATE TABLE {name} ({schema.toDDL()}) USING parquet CLUSTERED BY ({column}) SORTED BY ({column}) "
                       f"INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def about(self, name: str) -> dict:
        return load_metadata(self.spark, f"{self.path}/_about/{name}")

    def read(self, name: str) -> DataFrame:
        about = self.about(name)
        if about["buckets"] != self.buckets:
            raise ValueError(f"{name} has {about['buckets']} buckets instead of {self.buckets}")
        return self._table(f"{self.path}/{name}", StructType.fromJson(json.loads(about["schema"])))

    def _keys(self, names: Sequence[str], abouts: Sequence[dict]) -> DataFrame:
        """The distinct keys of these tables as they are now, stored once; missing keys are left out."""
        mark = hashlib.sha256(json.dumps([[n, a["version"]] for n, a in zip(names, abouts, strict=True)]).encode()).hexdigest()[:24]
        path = f"{self.path}/_keys/{mark}"
        if path_exists(self.spark, f"{path}-done"):
            return self._table(path, StructType.fromJson(json.loads(load_metadata(self.spark, f"{path}-done")["schema"])))
        keys = [self.read(n).select(self.key).where(F.col(self.key).isNotNull()) for n in names]
        done = self._write(path, reduce(DataFrame.union, keys).distinct())
        save_metadata(self.spark, done, f"{path}-done")
        return self._table(path, StructType.fromJson(json.loads(done["schema"])))

    def combine(self, names: Sequence[str]) -> DataFrame:
        """Full outer join of topics on the key, missing keys matching each other.

        Tables without repeated keys are joined bucket by bucket, without a shuffle.  If a table repeats
        keys, the tables are joined by :func:`combine.combine_on_key`, which takes the counts of the store.
        """
        names = list(names)
        abouts, tables = [self.about(n) for n in names], [self.read(n) for n in names]
        columns = [c for t in tables for c in t.columns if c != self.key]
        repeated = sorted({c for c in columns if columns.count(c) > 1})
        if repeated:
            raise ValueError(f"columns occur in more than one table: {repeated}")
        if len(tables) == 1:
            return tables[0]
        if any(a["largest"] > 1 for a in abouts):
            return combine.combine_on_key(tables, self.key, largest=[a["largest"] for a in abouts])
        out = self._keys(names, abouts)
        for t in tables:
            out = out.join(t, self.key, "left")
        out = out.select(self.key, *columns)
        lacking = [t.where(F.col(self.key).isNull()) for t, a in zip(tables, abouts, strict=True) if a["missing"]]
        if lacking:  # at most one row of each table
            out = out.unionByName(combine.combine_on_key(lacking, self.key, "join"), allowMissingColumns=True)
        return out
