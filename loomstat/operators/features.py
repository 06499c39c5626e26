"""Split, folds, fitted preprocessing and target transforms."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..fixed import SEED, TEST_SHARE
from ..functions.columns import from_log, key_hash, to_log, unit_hash
from ..session import materialise, scratch_path
from ..spec import Spec
from . import levels
from .quantiles import DIRECT_ROWS, quantile_values, size_measures

def assign_split(df: DataFrame, key: Sequence[str], share: float = TEST_SHARE, seed: int = SEED,
                 name: str = "split") -> DataFrame:
    """Add ``train``/``test`` by a hash of the key.

    The same row gets the same side however the table is partitioned, and no row moves.
    """
    return df.withColumn(name, F.when(unit_hash(key, seed) < share, F.lit("test")).otherwise(F.lit("train")))


def assign_fold(df: DataFrame, key: Sequence[str], k: int, seed: int = SEED, name: str = "fold") -> DataFrame:
    """Add a fold number 0…k-1 by a hash of the key (the seed is offset from the split's)."""
    return df.withColumn(name, (key_hash(key, f"fold{seed}") % F.lit(k)).cast("int"))


def assign_contiguous_fold(df: DataFrame, order: str, k: int, name: str = "fold") -> DataFrame:
    """Add fold numbers for k runs of rows along a unique column of any ordered type.

    The first ``n mod k`` folds hold one row more.  Rows with a null key come first.  The keys are
    sorted in ranges; the number of rows of each range says where the borders lie, so there is no
    global row numbering.
    """
    spark = df.sparkSession
    keys = df.select(F.col(order).alias("x"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The id of a row is its range's number above 33 bits and its place in the range below.
    placed = materialise(keys.repartitionByRange(width, "x").sortWithinPartitions("x").select(
        "x", F.monotonically_increasing_id().alias("_id")))
    part = F.shiftright("_id", 33)
    sizes = dict(placed.groupBy(part.alias("p")).count().collect())
    n = sum(sizes.values())
    folds = [n // k + (1 if i < n % k else 0) for i in range(k)]
    starts = [r for r in (sum(folds[:i]) for i in range(1, k)) if r < n]
    wanted, before = [], 0
    for p, size in sorted(sizes.items()):
        wanted += [(p << 33) + r - before for r in starts if before <= r < before + size]
        before += size
    borders = [r["x"] for r in placed.filter(F.col("_id").isin(wanted)).orderBy("_id").select("x").collect()] if wanted else []
    kind = df.schema[order].dataType
    # A border inside the nulls lies below every key; all nulls stay in the first fold.
    position = sum([F.coalesce((F.col(order) >= F.lit(b).cast(kind)) if b is not None else F.col(order).isNotNull(), F.lit(False))
                    .cast("int") for b in borders], F.lit(0))
    return df.withColumn(name, position.cast("int"))


def _level_text(level: Any) -> str:
    return str(level)


def _encoded(numbers: Sequence[Column], indices: Sequence[Column], sizes: Sequence[int]) -> Column:
    """Sparse vectors of numbers and one-hot levels; an index that is its column's size is unknown.

    Spark's encoder names every level in the metadata of its column, on the driver; here the driver
    knows no more than the sizes.
    """
    width, starts = len(numbers), np.cumsum([len(numbers), *sizes])

    def run(given: pa.Array, levels: pa.Array) -> pa.Array:
        rows = len(levels)
        value = np.ones((rows, width + len(sizes)))
        place = np.empty(value.shape, np.int32)
        there = np.empty(value.shape, bool)
        value[:, :width] = given.flatten().to_numpy(zero_copy_only=False).reshape(rows, width)
        found = levels.flatten().to_numpy(zero_copy_only=False).reshape(rows, len(sizes)).astype(np.int64)
        place[:, :width], place[:, width:] = np.arange(width), found + starts[:-1]
        there[:, :width], there[:, width:] = value[:, :width] != 0, found < np.array(sizes)
        limits = pa.array(np.concatenate(([0], np.cumsum(there.sum(axis=1)))).astype(np.int32))
        return pa.StructArray.from_arrays(
            [pa.array(np.zeros(rows, np.int8)), pa.array(np.full(rows, starts[-1], np.int32)), pa.ListArray.from_arrays(limits, pa.array(place[there])),
             pa.ListArray.from_arrays(limits, pa.array(value[there]))], ["type", "size", "indices", "values"])

    return F.arrow_udf(run, VectorUDT())(F.array(*numbers).cast("array<double>"), F.array(*indices))


def met_features(df: DataFrame, vector: str = "features") -> DataFrame:
    """(feature, n): in how many rows each feature is not zero, without those that never are; sparse vectors stay sparse."""
    parts = df.select(F.unwrap_udt(vector).alias("_v")).filter("_v is not null")
    place = F.when(F.col("_v.type") == 0, F.col("_v.indices")).otherwise(F.sequence(F.lit(0), F.size("_v.values") - 1))
    entries = parts.filter(F.size("_v.values") > 0).select(F.explode(F.arrays_zip(place.alias("at"), F.col("_v.values").alias("x"))).alias("_e"))
    return entries.filter("_e.x != 0").groupBy(F.col("_e.at").alias("feature")).agg(F.count(F.lit(1)).alias("n"))


def _filled(column: str, fill: Any) -> Any:
    """A categorical column with its missing values filled; NaN is one of them, as it is when levels are counted."""
    value = F.nanvl(F.col(column), F.lit(None)) if isinstance(fill, float) else F.col(column)
    return F.coalesce(value, F.lit(fill))


@dataclass(frozen=True)
class Preprocessor:
    """Fitted imputation, scaling and one-hot levels.

    ``numeric`` holds (name, fill, mean, std); ``categorical`` holds (name, fill, levels), all as
    literals: then applying it is a projection without a shuffle, for batch and streaming tables
    alike.  A column with more levels than are listed holds their number instead; they are tables
    below ``dictionary``, and applying it is a join.
    """

    numeric: tuple[tuple[str, float, float, float], ...]
    categorical: tuple[tuple[str, Any, tuple | int], ...]
    dictionary: str | None = None

    @property
    def width(self) -> int:
        """Number of output features."""
        return len(self.numeric) + sum(levels if isinstance(levels, int) else len(levels) for _, _, levels in self.categorical)

    def _listed(self) -> tuple[tuple[str, Any, tuple], ...]:
        for n, _, levels in self.categorical:
            if isinstance(levels, int):
                raise ValueError(f"{n}: its {levels} levels are a table; name_table has the names")
        return self.categorical

    @property
    def names(self) -> list[str]:
        """Output feature names: the numeric block, then the one-hot block."""
        return [f"num__{n}" for n, *_ in self.numeric] + [
            f"cat__{n}_{_level_text(level)}" for n, _, levels in self._listed() for level in levels]

    @property
    def bases(self) -> dict[str, str]:
        """Output feature name → source column, also for levels that are words."""
        return {f"num__{n}": n for n, *_ in self.numeric} | {
            f"cat__{n}_{_level_text(level)}": n for n, _, levels in self._listed() for level in levels}

    def name_table(self, spark: SparkSession) -> DataFrame:
        """(position, name, base) of all output features, however many there are."""
        rows, tables, position = [], [], 0
        for n, *_ in self.numeric:
            rows.append((position, f"num__{n}", n))
            position += 1
        for n, _, found in self.categorical:
            if isinstance(found, int):
                tables.append(levels.read_dictionary(spark, self.dictionary, n).select(
                    (F.col("index") + position).alias("position"), F.concat(F.lit(f"cat__{n}_"), F.col("level").cast("string")).alias("name"), F.lit(n).alias("base")))
                position += found
                continue
            rows += [(position + i, f"cat__{n}_{_level_text(level)}", n) for i, level in enumerate(found)]
            position += len(found)
        return reduce(DataFrame.unionByName, tables, spark.createDataFrame(rows, "position long, name string, base string"))

    def columns(self) -> dict[str, Any]:
        """Output feature name → expression over the raw columns."""
        out = {}
        for n, fill, mean, std in self.numeric:
            value = F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")), F.lit(fill))
            out[f"num__{n}"] = (value - F.lit(mean)) / F.lit(std if std else 1.0)
        for n, fill, found in self._listed():
            for level in found:
                out[f"cat__{n}_{_level_text(level)}"] = (_filled(n, fill) == F.lit(level)).cast("double")
        return out

    def transform_columns(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """One column per output feature, beside the columns to keep; levels must be listed."""
        return df.select(*keep, *[c.alias(n) for n, c in self.columns().items()])

    def transform(self, df: DataFrame, keep: Sequence[str] | None = None, vector: str = "features") -> DataFrame:
        """The kept columns and one feature vector.

        Levels are indexed and encoded as sparse vectors, one column each: the plan does not grow
        with their number.  Unknown levels are all zeros.  Beside levels in tables the tasks encode them themselves.
        """
        keep = list(df.columns if keep is None else keep)
        numeric = list(Preprocessor(self.numeric, ()).columns().values())
        tables = {i: c for i, c in enumerate(self.categorical) if isinstance(c[2], int)}
        for i, (n, fill, size) in tables.items():
            df = levels.look_up(df, n, fill, levels.read_dictionary(df.sparkSession, self.dictionary, n), size, f"_i{i}")
        listed = {i: c for i, c in enumerate(self.categorical) if i not in tables}
        plain = df.select(*keep, *[c.alias(f"_f{i}") for i, c in enumerate(numeric)], *[f"_i{i}" for i in tables], *[
            _filled(n, fill).cast("string").alias(f"_s{i}") for i, (n, fill, _) in listed.items()])
        inputs = [f"_f{i}" for i in range(len(numeric))]
        metadata = {"ml_attr": {"num_attrs": self.width}}
        indices, encoded = ([f"_{k}{i}" for i in range(len(self.categorical))] for k in "ie")
        if self.categorical:
            spark = df.sparkSession
            labels = {i: self._level_texts(df, n, found) for i, (n, _, found) in listed.items()}
            if labels:
                plain = StringIndexerModel.from_arrays_of_labels(list(labels.values()), [f"_s{i}" for i in labels], [f"_i{i}" for i in labels],
                                                                 handleInvalid="keep").transform(plain)
            if tables:
                sizes = [len(labels[i]) if i in labels else tables[i][2] for i in range(len(self.categorical))]
                return plain.select(*keep, _encoded([F.col(c) for c in inputs], [F.col(c) for c in indices], sizes).alias(vector, metadata=metadata))
            last = [float(len(labels[i]) - 1) for i in range(len(self.categorical))]
            sizes = spark.createDataFrame([tuple(last)], ", ".join(f"{i} double" for i in indices))
            encoder = OneHotEncoder(inputCols=indices, outputCols=encoded, dropLast=True, handleInvalid="keep").fit(sizes)
            # Without the index metadata the number of levels is the encoder's own.
            plain = encoder.transform(plain.withColumns({i: F.expr(f"{i} + 0.0") for i in indices}))
            inputs += encoded
        assembled = VectorAssembler(inputCols=inputs, outputCol=vector).transform(plain)
        return assembled.select(*keep, F.col(vector).alias(vector, metadata=metadata))

    @staticmethod
    def _level_texts(df: DataFrame, column: str, found: tuple) -> list[str]:
        """Levels as the column's own type writes them."""
        if all(isinstance(v, str) for v in found):
            return list(found)
        kind = df.schema[column].dataType
        rows = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(found)], StructType([
            StructField("i", LongType()), StructField("v", kind)]))
        return [r[0] for r in rows.orderBy("i").select(F.col("v").cast("string")).collect()]

    def to_json(self) -> str:
        return json.dumps({"numeric": self.numeric, "categorical": self.categorical})

    @staticmethod
    def from_json(text: str, dictionary: str | None = None) -> Preprocessor:
        raw = json.loads(text)
        return Preprocessor(tuple(tuple(r) for r in raw["numeric"]),
                            tuple((n, fill, found if isinstance(found, int) else tuple(found)) for n, fill, found in raw["categorical"]), dictionary)

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes one JSON line, and beside it the tables of levels that are not listed."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)
        for n, _, found in self.categorical:
            if isinstance(found, int):
                levels.read_dictionary(spark, self.dictionary, n).write.mode("overwrite").parquet(f"{path}/_levels/{n}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Preprocessor:
        return Preprocessor.from_json(spark.read.text(path).first()[0], f"{path}/_levels")


def fit_levels(df: DataFrame, cols: Sequence[str], listed: int = levels.LISTED) -> tuple[list[tuple[str, Any, tuple | int]], str | None]:
    """(column, most frequent level, levels) of every column that has any, and the folder of the tables.

    Levels are counted in one job.  Those of columns with at most ``listed`` are listed in order; the others become
    a table each, of which only the number of levels comes here.  On a tie the smallest is the most frequent.
    """
    if not cols:
        return [], None
    spark, kinds = df.sparkSession, dict(df.dtypes)
    counts = levels.count_levels(df, cols)
    sizes = {r["column"]: r["count"] for r in counts.groupBy("column").count().collect()}
    few = levels.listed_levels(counts, kinds, [c for c in cols if 0 < sizes.get(c, 0) <= listed])
    folder = scratch_path(spark, "dictionary")
    found: list[tuple[str, Any, tuple | int]] = []
    for c in cols:
        if c in few:
            most = max(n for _, n in few[c])
            found.append((c, next(level for level, n in few[c] if n == most), tuple(level for level, _ in few[c])))
        elif c in sizes:
            found.append((c, *levels.write_dictionary(counts, c, kinds[c], f"{folder}/{c}")))
    return found, folder


def fit_preprocessor(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], impute: str = "median",
                     direct_rows: int = DIRECT_ROWS, listed: int = levels.LISTED) -> Preprocessor:
    """Fit on the given rows: median or mean fill, mean and population std after the fill,
    most frequent level (smallest on a tie) and sorted levels, as a table for columns with more than ``listed``.

    A numeric column without any value has no fill and is left out.
    """
    numeric, categorical = list(numeric), list(categorical)
    if impute not in ("median", "mean"):
        raise ValueError(f"unknown fill {impute!r}")
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in numeric}
    found = df.agg(F.count(F.lit(1)).alias("rows"), *[
        f(clean[c]).alias(f"_{n}{i}") for i, c in enumerate(numeric)
        for n, f in (("mean", F.avg), ("var", F.var_pop))], *size_measures(numeric)).first()
    sizes = [(found[f"_n{i}"], found[f"_d{i}"]) for i in range(len(numeric))]
    with ThreadPoolExecutor(2) as pool:
        counted = pool.submit(fit_levels, df, categorical, listed)
        medians = quantile_values(df, numeric, [0.5], direct_rows, sizes) if impute == "median" else {}
        fitted_categories, folder = counted.result()
    scaled = []
    for i, c in enumerate(numeric):
        present, mean, variance = found[f"_n{i}"], found[f"_mean{i}"], found[f"_var{i}"]
        if present:
            fill = medians[c][0] if impute == "median" else mean
            # Mean and variance of the present values and of the equal filled ones, put together.
            share = present / found["rows"]
            spread = share * variance + share * (1 - share) * (mean - fill) ** 2
            scaled.append((c, fill, share * mean + (1 - share) * fill, math.sqrt(spread)))
    return Preprocessor(tuple(scaled), tuple(fitted_categories), folder if any(isinstance(c[2], int) for c in fitted_categories) else None)


@dataclass(frozen=True)
class TargetTransform:
    """Log and optional standardisation of targets: (name, kind, mean, std)."""

    targets: tuple[tuple[str, str | None, float, float], ...]

    @property
    def names(self) -> list[str]:
        return [t for t, *_ in self.targets]

    def label(self, target: str) -> Any:
        """Expression of the transformed label over the raw target column."""
        kind, mean, std = next((k, m, s) for t, k, m, s in self.targets if t == target)
        return (to_log(F.col(target).cast("double"), kind) - F.lit(mean)) / F.lit(std)

    def invert(self, target: str, column: Any, logged: bool = False) -> Any:
        """Back to the original scale; ``logged`` stops at the log scale."""
        kind, mean, std = next((k, m, s) for t, k, m, s in self.targets if t == target)
        logs = column * F.lit(std) + F.lit(mean)
        return logs if logged else from_log(logs, kind)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"label_{t}": self.label(t) for t in self.names})


def fit_targets(df: DataFrame, kinds: Mapping[str, str | None], scale: bool = False) -> TargetTransform:
    """``kinds`` names each target's log (``log1p``, ``log`` or None); ``scale`` standardises after it."""
    if not scale:
        return TargetTransform(tuple((t, k, 0.0, 1.0) for t, k in kinds.items()))
    logged = {t: to_log(F.col(t).cast("double"), k) for t, k in kinds.items()}
    row = df.agg(*[f(logged[t]).alias(f"_{n}{i}") for i, t in enumerate(kinds)
                   for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
    return TargetTransform(tuple((t, k, row[f"_mean{i}"], row[f"_std{i}"] or 1.0)
                                 for i, (t, k) in enumerate(kinds.items())))


@dataclass(frozen=True)
class Prepared:
    """Feature vectors with labels and split, and what was fitted to get them."""

    rows: DataFrame
    preprocessor: Preprocessor
    targets: TargetTransform

    def stored(self) -> Prepared:
        """The same with its rows materialised, for fits that read them several times."""
        return Prepared(materialise(self.rows), self.preprocessor, self.targets)

    @property
    def train(self) -> DataFrame:
        return self.rows.filter("split = 'train'")

    @property
    def test(self) -> DataFrame:
        return self.rows.filter("split = 'test'")


def prepare(df: DataFrame, key: Sequence[str], numeric: Sequence[str], categorical: Sequence[str],
            kinds: Mapping[str, str | None], impute: str = "median", scale_targets: bool = False,
            share: float = TEST_SHARE, seed: int = SEED) -> Prepared:
    """Split, fit the preprocessing on the training rows only, transform all rows."""
    split = assign_split(df, key, share, seed)
    train = split.filter("split = 'train'")
    preprocessor = fit_preprocessor(train, numeric, categorical, impute)
    targets = fit_targets(train, kinds, scale_targets)
    labelled = targets.transform(split)
    keep = [*key, "split", *[f"label_{t}" for t in targets.names]]
    return Prepared(preprocessor.transform(labelled, keep), preprocessor, targets)


def prepare_spec(df: DataFrame, spec: Spec, impute: str = "median", share: float = TEST_SHARE,
                 seed: int = SEED) -> Prepared:
    """:func:`prepare` with the columns and log flags of a specification."""
    kinds = {t: "log1p" if t in spec.log_targets else None for t in spec.targets}
    return prepare(df, [spec.key], [c for c in spec.numeric if c in df.columns],
                   [c for c in spec.categorical if c in df.columns], kinds, impute, False, share, seed)
