"""Combining tables: full outer join on the key, row concat, melt and pivot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# A key with more rows than this is joined through plans that can split it.
HOT_KEY_ROWS = 1_000_000


def largest_key_group(df: DataFrame, key: str) -> int:
    return df.groupBy(key).count().agg(F.max("count")).first()[0] or 0


def _value_columns(dfs: Sequence[DataFrame], key: str) -> list[str]:
    names = [c for df in dfs for c in df.columns if c != key]
    repeated = sorted({c for c in names if names.count(c) > 1})
    if repeated:
        raise ValueError(f"columns occur in more than one table: {repeated}")
    return names


def _merge_unique(dfs: Sequence[DataFrame], key: str) -> DataFrame:
    """One shuffle for any number of tables: stack them and keep each key's only value."""
    values = _value_columns(dfs, key)
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    return stacked.groupBy(key).agg(*[F.max(c).alias(c) for c in values])


def _full_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join in which missing keys match each other."""
    r = right.withColumnRenamed(key, "_right_key")
    joined = left.join(r, F.col(key).eqNullSafe(F.col("_right_key")), "full")
    return joined.withColumn(key, F.coalesce(key, "_right_key")).drop("_right_key")


def _full_join_hot(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The same rows as :func:`_full_join`, from joins whose hot partitions can be split.

    Spark can split a skewed partition of an inner or a left anti join, but not of a
    full outer join.
    """
    def matches(a: str, b: str):
        return F.col(a).eqNullSafe(F.col(b))

    def keys_of(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).alias("_other_key")).distinct()

    r = right.withColumnRenamed(key, "_right_key")
    both = left.join(r, matches(key, "_right_key"), "inner").drop("_right_key")
    only_left = left.join(keys_of(right), matches(key, "_other_key"), "left_anti")
    only_right = right.join(keys_of(left), matches(key, "_other_key"), "left_anti")
    return both.unionByName(only_left, allowMissingColumns=True).unionByName(only_right, allowMissingColumns=True)


def combine_on_key(dfs: Sequence[DataFrame], key: str, strategy: str = "auto", largest: Sequence[int] | None = None) -> DataFrame:
    """Full outer join of all tables on the key.

    ``unique``: the caller knows that no table repeats a key.  ``join``: pairwise full
    outer joins, repeated keys multiply rows.  ``hot``: as ``join``, for keys that hold
    a large share of the rows.  ``auto`` measures the largest key group of every table unless ``largest`` gives it,
    merges the tables with unique keys in one shuffle and joins the others to the result.
    Complex columns (arrays, maps) always take the pairwise way.
    """
    dfs = list(dfs)
    values = _value_columns(dfs, key)
    if len(dfs) == 1:
        return dfs[0]
    if strategy == "unique":
        return _merge_unique(dfs, key)
    if strategy == "auto":
        largest = [largest_key_group(df, key) for df in dfs] if largest is None else list(largest)
        plain = [all(not kind.startswith(("array", "map")) for _, kind in df.dtypes) for df in dfs]
        single = [df for df, n, p in zip(dfs, largest, plain, strict=True) if n <= 1 and p]
        others = [df for df, n, p in zip(dfs, largest, plain, strict=True) if n > 1 or not p]
        strategy = "hot" if max(largest) > HOT_KEY_ROWS else "join"
        dfs = ([_merge_unique(single, key)] if single else []) + others
    result = dfs[0]
    for df in dfs[1:]:
        if strategy == "hot":
            # Each side is read three times: stored, so that the plan grows by a fixed part per table.
            result = _full_join_hot(materialise(result), materialise(df), key)
        elif strategy == "join":
            result = _full_join(result, df, key)
        else:
            raise ValueError(f"unknown strategy {strategy!r}")
    return result.select(key, *values)


def concat_rows(dfs: Sequence[DataFrame], tag: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """Stack tables of one shape; ``tag`` adds a column naming the part a row came from."""
    if tag is not None:
        dfs = [df.withColumn(tag, F.lit(t)) for df, t in zip(dfs, tags, strict=True)]
    return reduce(DataFrame.unionByName, dfs)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable",
         value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


def spread(df: DataFrame, ids: Sequence[str], variable: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long to wide for a known list of names; null where a name is absent."""
    return df.groupBy(*ids).pivot(variable, list(names)).agg(F.first(value, ignorenulls=True))


def columns_like(df: DataFrame, text: str, ids: Sequence[str] = ()) -> DataFrame:
    """The id columns and the columns whose name contains ``text``."""
    return df.select(*ids, *[c for c in df.columns if text in c and c not in ids])


def distinct_values(dfs: Sequence[DataFrame], col: str) -> DataFrame:
    """Sorted distinct values of a column over all tables."""
    return reduce(DataFrame.union, [df.select(col) for df in dfs]).distinct().orderBy(col)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` does not have."""
    return left.subtract(right)
