"""Cleaning: select, rename, recode, trim, map and check rows of one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import TRIM_LOWER, TRIM_UPPER
from ..functions.columns import absent_if_in, absent_if_nan, all_of, any_of, level_rank, lookup
from ..spec import Feature
from .quantiles import DIRECT_ROWS, quantile_values


def project_features(df: DataFrame, features: Sequence[Feature], key: str) -> DataFrame:
    """The key and the configured source columns that exist, under their names."""
    present = set(df.columns)
    return df.select(key, *[F.col(f.source).alias(f.name) for f in features if f.source in present])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating-point column."""
    floating = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*[absent_if_nan(F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns])


def recode_sentinels(df: DataFrame, codes: Mapping[str, Sequence[Any]]) -> DataFrame:
    """Listed codes become null, each only in its own column."""
    return df.withColumns({
        c: absent_if_in(F.col(c).cast("double"), v) for c, v in codes.items() if c in df.columns
    })


def drop_sentinel_rows(df: DataFrame, codes: Mapping[str, Sequence[Any]]) -> tuple[DataFrame, DataFrame]:
    """Rows without any listed code, and the number of rows each rule removed.

    Rules apply in order: a row is counted for the first rule it breaks.  Null
    values break no rule.
    """
    rules = [(c, v) for c, v in codes.items() if c in df.columns]
    broken = [F.coalesce(F.col(c).isin(*v), F.lit(False)) for c, v in rules]
    first = F.lit(None).cast("string")
    for (name, _), condition in reversed(list(zip(rules, broken, strict=True))):
        first = F.when(condition, F.lit(name)).otherwise(first)
    counts = [F.count_if(first == name).alias(name) for name, _ in rules]
    stacked = F.explode(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("rule"), F.col(name).alias("removed"))
        for i, (name, _) in enumerate(rules)
    ])).alias("_row")
    removed = df.agg(*counts).select(stacked).select("_row.step", "_row.rule", "_row.removed")
    return df.filter(~any_of(broken)), removed


@dataclass(frozen=True)
class Bounds:
    """Fitted inclusive bounds, applied one after the other in one scan."""

    limits: tuple[tuple[str, float | None, float | None], ...]

    def condition(self) -> Column:
        # A bound of null (a column without values) keeps no row, as a comparison with it would.
        return all_of([
            F.col(c).between(F.lit(lo), F.lit(hi)) if lo is not None else F.lit(False) for c, lo, hi in self.limits
        ])

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.condition()) if self.limits else df

    def restricted_to(self, columns: Sequence[str]) -> Bounds:
        return Bounds(tuple(limit for limit in self.limits if limit[0] in columns))


def fit_trim(df: DataFrame, cols: Sequence[str], lower: float = TRIM_LOWER, upper: float = TRIM_UPPER,
             direct_rows: int = DIRECT_ROWS) -> Bounds:
    """Percentile bounds, column after column on the survivors of the columns before.

    Each step is one aggregation; its bounds become literals, so that applying the
    result is a single filter which the scan can push down.
    """
    bounds = Bounds(())
    for c in cols:
        survivors = bounds.apply(df).select(c)
        lo, hi = quantile_values(survivors, [c], [lower, upper], direct_rows)[c]
        bounds = Bounds((*bounds.limits, (c, lo, hi)))
    return bounds


def trim_report(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Rows each bound removes, in order, from one pass over the table."""
    first = F.lit(None).cast("string")
    for c, lo, hi in reversed(bounds.limits):
        inside = F.coalesce(F.col(c).between(F.lit(lo), F.lit(hi)), F.lit(False))
        first = F.when(~inside, F.lit(c)).otherwise(first)
    counts = df.agg(*[F.count_if(first == c).alias(c) for c, _, _ in bounds.limits])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(c).alias("column"), F.lit(lo).cast("double").alias("lower"),
                 F.lit(hi).cast("double").alias("upper"), F.col(c).alias("removed"))
        for i, (c, lo, hi) in enumerate(bounds.limits)
    ])).alias("_row")
    return counts.select(stacked).select("_row.*")


def drop_extreme_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows that hold no column's overall minimum or maximum; nulls survive."""
    ends = df.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
                  *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    at_end = [
        F.coalesce(F.col(c).isin(ends[f"lo{i}"], ends[f"hi{i}"]), F.lit(False))
        for i, c in enumerate(cols) if ends[f"lo{i}"] is not None
    ]
    return df.filter(~any_of(at_end))


def map_values(df: DataFrame, maps: Mapping[str, Mapping[Any, Any]]) -> DataFrame:
    """Replace codes by labels; a code the map does not list becomes null."""
    return df.withColumns({c: lookup(F.col(c), m) for c, m in maps.items() if c in df.columns})


def drop_missing_targets(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(targets))


def filter_positive(df: DataFrame, col: str) -> DataFrame:
    """Rows with a positive weight; null fails."""
    return df.filter(F.col(col) > 0)


def missing_ratio(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, ratio) of missing values, largest first, from one pass."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"_m{i}") for i, c in enumerate(cols)])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("ratio")) for i, c in enumerate(cols)
    ])).alias("_row")
    return wide.select(stacked).select("_row.*").orderBy(F.desc("ratio"), "column")


def drop_sparse_columns(df: DataFrame, limit: float = 0.5) -> tuple[DataFrame, list[str]]:
    """The table without columns missing in more than ``limit`` of the rows, and their names."""
    ratios = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"_m{i}")
                      for i, c in enumerate(df.columns)]).first()
    dropped = [c for i, c in enumerate(df.columns) if (ratios[f"_m{i}"] or 0.0) > limit]
    return df.drop(*dropped), dropped


def order_levels(df: DataFrame, col: str, levels: Sequence[Any], rank: str | None = None) -> DataFrame:
    """Make a column ordered: values outside ``levels`` become null, ``rank`` holds the position."""
    rank = rank or f"{col}_rank"
    return df.withColumn(rank, level_rank(F.col(col), levels)).withColumn(
        col, F.when(F.col(rank).isNotNull(), F.col(col)))


def quality_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations): rows for which a rule does not hold; unknown counts as a violation."""
    names = list(rules)
    wide = df.agg(*[F.count_if(~F.coalesce(rules[n], F.lit(False))).alias(f"_v{i}") for i, n in enumerate(names)])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"_v{i}").alias("violations")) for i, n in enumerate(names)
    ])).alias("_row")
    return wide.select(stacked).select("_row.*")


def require(df: DataFrame, rules: Mapping[str, Column]) -> None:
    """Raise when any rule is violated."""
    broken = [f"{r['rule']}: {r['violations']} rows" for r in quality_report(df, rules).collect() if r["violations"]]
    if broken:
        raise ValueError("; ".join(broken))


def clean_topic(df: DataFrame, features: Sequence[Feature], key: str, sentinels: Mapping[str, Sequence[Any]],
                bounds: Bounds | None = None) -> tuple[DataFrame, Bounds]:
    """All cleaning steps of one topic table, and the trim bounds used.

    ``bounds`` re-uses bounds fitted on another cycle; otherwise they are fitted here.
    """
    named = project_features(nan_to_null(df), features, key)
    recoded = recode_sentinels(named, {f.name: sentinels[f.name] for f in features if f.name in sentinels})
    trimmed_columns = [f.name for f in features if f.drop_extrema and f.name in recoded.columns]
    fitted = bounds.restricted_to(trimmed_columns) if bounds is not None else fit_trim(recoded, trimmed_columns)
    trimmed = fitted.apply(recoded)
    return map_values(trimmed, {f.name: f.map for f in features if f.map}), fitted
