"""Exact quantiles that keep working when one group no longer fits one task.

Three ways give the same exact number:

* ``percentile`` holds every distinct value of a group in one buffer: the shortest plan
  for groups of up to ``DIRECT_ROWS`` rows.
* Larger groups are bracketed: an approximate quantile with a known rank error bounds the
  wanted value from both sides, and one more pass counts the rows below the bracket and
  the values inside it, about a two-thousandth of the rows.
* Groups above ``BRACKET_ROWS`` rows, and any rank a bracket missed, are narrowed: each
  pass counts rows per value interval and keeps the interval that holds the rank, until
  it holds a single value.

All passes aggregate on the map side; rows are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import any_of
from ..session import cut_lineage

DIRECT_ROWS = 200_000
BRACKET_ROWS = 2_000_000_000
INTERVALS = 1024

# The rank error of the approximate quantile is at most one part in ACCURACY.
ACCURACY = 10_000
BRACKET_SHARE = 2.5 / ACCURACY


def long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, x): one row per non-null, non-NaN value of the columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
                               .alias("x")) for c in cols])
    return (
        df.select(*by, F.explode(pairs).alias("_pair"))
        .select(*by, "_pair.column", "_pair.x")
        .filter(F.col("x").isNotNull())
    )


def _direct(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
    wide = df.groupBy(*by).agg(*[F.percentile(clean[c], wanted).alias(f"_q{i}") for i, c in enumerate(cols)])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_q{i}").alias("values")) for i, c in enumerate(cols)
    ])).alias("_row")
    return (
        wide.select(*by, stacked)
        .select(*by, "_row.column", F.posexplode("_row.values").alias("_pos", "value"))
        .select(*by, "column", F.element_at(wanted, F.col("_pos") + 1).alias("prob"), "value")
    )


def order_statistics(values: DataFrame, groups: Sequence[str], wanted: DataFrame,
                     intervals: int = INTERVALS) -> DataFrame:
    """The value at each 0-based rank, by narrowing value intervals.

    ``values`` is (groups…, x) without nulls, with at least one group column; ``wanted``
    is (groups…, rank), one row per group and rank.  The result is (groups…, rank, x).
    Infinite values are counted at their ends; only finite ones are narrowed.
    """
    groups = list(groups)
    keys = [*groups, "rank"]
    low, high = F.col("x") == float("-inf"), F.col("x") == float("inf")
    finite = F.when(~(low | high), F.col("x"))
    extent = values.groupBy(*groups).agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"),
                                         F.count_if(low).alias("skip"), F.count(finite).alias("_finite"))
    state = cut_lineage(wanted.join(extent, groups))
    inner = (F.col("rank") >= F.col("skip")) & (F.col("rank") < F.col("skip") + F.col("_finite"))
    found = [state.filter(~inner).select(*keys, F.when(F.col("rank") < F.col("skip"), F.lit(float("-inf"))).otherwise(
        F.lit(float("inf"))).alias("x"))]
    state, values = state.filter(inner).drop("_finite"), values.filter(~(low | high))
    while True:
        found.append(state.filter("lo = hi").select(*keys, F.col("lo").alias("x")))
        state = state.filter("lo < hi")
        if state.isEmpty():
            break
        open_ranges = F.broadcast(state) if state.count() <= 100_000 else state
        inside = F.col("x").between(F.col("lo"), F.col("hi"))
        # Halving the bounds first keeps the width finite for values near the double limit.
        share = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        interval = F.least(F.floor(share * intervals), F.lit(intervals - 1)).cast("int")
        matched = values.join(open_ranges, groups).filter(inside)
        counted = matched.groupBy(*keys, "skip", interval.alias("interval")).agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("n").over(W.partitionBy(*keys).orderBy("interval"))
        state = cut_lineage(
            counted.withColumn("upto", F.col("skip") + upto)
            .withColumn("before", F.col("upto") - F.col("n"))
            .filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
            .select(*keys, "lo", "hi", F.col("before").alias("skip"))
        )
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def _asked(hot: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(groups…, prob, part, below, above): the ranks between which each quantile lies."""
    position = F.col("prob") * (F.col("n") - 1)
    return hot.select(*groups, "n", F.explode(F.array(*[F.lit(p) for p in probs])).alias("prob")).select(
        *groups, "prob", F.floor(position).cast("long").alias("below"), F.ceil(position).cast("long").alias("above"),
        (position - F.floor(position)).alias("part"))


def _between(low: str, high: str):
    return (F.col(low) + (F.col(high) - F.col(low)) * F.col("part")).alias("value")


def _bracketed(values: DataFrame, groups: Sequence[str], asked: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(groups…, prob, value), null where the bracket does not hold the rank."""
    ends = [min(1.0, max(0.0, p + side * BRACKET_SHARE)) for p in probs for side in (-1, 1)]
    sketch = values.groupBy(*groups).agg(
        F.percentile_approx("x", F.array(*[F.lit(e) for e in ends]), F.lit(ACCURACY)).alias("ends"))
    number = F.array_position(F.array(*[F.lit(p) for p in probs]), F.col("prob"))
    brackets = asked.join(sketch, list(groups)).select(
        *groups, "prob", "below", "above", "part",
        F.element_at("ends", (2 * number - 1).cast("int")).alias("lo"),
        F.element_at("ends", (2 * number).cast("int")).alias("hi"))
    # One row per hot group, column and probability.
    brackets = cut_lineage(brackets)
    brackets = F.broadcast(brackets) if brackets.count() <= 100_000 else brackets
    key = [*groups, "prob", "below", "above", "part"]
    counted = values.join(brackets, list(groups)).filter("x <= hi").groupBy(
        *key, F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy(*groups, "prob").orderBy(F.asc_nulls_first("v")))

    def at(rank: str):
        return F.max(F.when((F.col("upto") - F.col("n") <= F.col(rank)) & (F.col(rank) < F.col("upto")), F.col("v")))

    picked = counted.withColumn("upto", upto).groupBy(*key).agg(at("below").alias("low"), at("above").alias("high"))
    return picked.select(*groups, "prob", _between("low", "high"))


def _narrowed(values: DataFrame, groups: Sequence[str], asked: DataFrame, intervals: int) -> DataFrame:
    """(groups…, prob, value) by interval narrowing."""
    ranks = asked.select(*groups, F.explode(F.array_distinct(F.array("below", "above"))).alias("rank")).distinct()
    at = order_statistics(values, groups, ranks, intervals)
    low = at.select(*groups, F.col("rank").alias("below"), F.col("x").alias("low"))
    high = at.select(*groups, F.col("rank").alias("above"), F.col("x").alias("high"))
    return asked.join(low, [*groups, "below"]).join(high, [*groups, "above"]).select(
        *groups, "prob", _between("low", "high"))


def _hot(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str], hot: DataFrame,
         bracket_rows: int, intervals: int) -> DataFrame:
    """Quantiles of the hot (by…, column, n) groups."""
    groups = [*by, "column"]
    values = long_values(df, cols, by)
    asked = _asked(hot, groups, probs)
    largest = hot.agg(F.max("n")).first()[0] or 0
    if largest > bracket_rows:
        return _narrowed(values, groups, asked, intervals)
    found = cut_lineage(_bracketed(values, groups, asked, probs))
    missed = asked.join(found.filter("value is not null"), [*groups, "prob"], "left_anti")
    if missed.isEmpty():
        return found
    return found.filter("value is not null").unionByName(_narrowed(values, groups, missed, intervals))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
              direct_rows: int = DIRECT_ROWS, intervals: int = INTERVALS, largest: int | None = None,
              bracket_rows: int = BRACKET_ROWS) -> DataFrame:
    """Linear-interpolated quantiles as (by…, column, prob, value).

    A group without values has a null ``value``; rows with a null group are left out.
    ``largest`` is the size of the largest group, if the caller knows it.
    """
    cols, probs, by = list(cols), [float(p) for p in probs], list(by)
    df = df.dropna(subset=by) if by else df
    if largest is None:
        largest = df.groupBy(*by).count().agg(F.max("count")).first()[0]
    if largest is None or largest <= direct_rows:
        return _direct(df, cols, probs, by)
    present = [F.count(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(f"_n{i}")
               for i, c in enumerate(cols)]
    counts = cut_lineage(df.groupBy(*by).agg(*present, F.count(F.lit(1)).alias("_rows")))
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("n"))
                                  for i, c in enumerate(cols)])).alias("_row")
    hot = counts.filter(F.col("_rows") > direct_rows).select(*by, stacked).select(*by, "_row.column", "_row.n")
    empty = hot.filter("n = 0").select(*by, "column", F.explode(F.array(*[F.lit(p) for p in probs])).alias("prob"),
                                       F.lit(None).cast("double").alias("value"))
    result = _hot(df, cols, probs, by, hot.filter("n > 0"), bracket_rows, intervals).unionByName(empty)
    if by:
        cold = counts.filter(F.col("_rows") <= direct_rows).select(*by)
        result = result.unionByName(_direct(df.join(cold, by), cols, probs, by))
    return result


def _pick(counted: DataFrame, key: str, ranks: Sequence[Sequence[tuple[int, int]]]) -> dict[int, list[tuple]]:
    """The values at the ranks asked for each key 0…, from (key, x, n) value counts.

    Each key's counts are summed up in the order of the values; they are few.
    """
    upto = F.sum("n").over(W.partitionBy(key).orderBy("x"))

    def at(j: int, side: int):
        rank = F.element_at(F.array(*[F.lit(r[j][side]).cast("long") for r in ranks]), F.col(key) + 1)
        return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("x")))

    width = len(ranks[0])
    rows = counted.withColumn("upto", upto).groupBy(key).agg(
        *[at(j, side).alias(f"_{j}{name}") for j in range(width) for side, name in ((0, "low"), (1, "high"))]).collect()
    return {r[key]: [(r[f"_{j}low"], r[f"_{j}high"]) for j in range(width)] for r in rows}


def _counted_quantiles(df: DataFrame, clean: dict, sizes: dict[str, int], probs: Sequence[float]) -> dict[str, list]:
    """Quantiles of columns with few distinct values, from their value counts."""
    cols = [c for c in clean if sizes[c]]
    if not cols:
        return {}
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), clean[c].alias("x")) for k, c in enumerate(cols)]))
    counted = df.select(entries.alias("_e")).select("_e.*").filter("x is not null").groupBy("k", "x").agg(
        F.count(F.lit(1)).alias("n"))
    positions = [[p * (sizes[c] - 1) for p in probs] for c in cols]
    found = _pick(counted, "k", [[(math.floor(q), math.ceil(q)) for q in row] for row in positions])
    return {c: [low + (high - low) * (q - math.floor(q)) for (low, high), q in zip(found[k], positions[k], strict=True)]
            for k, c in enumerate(cols)}


def _bracketed_quantiles(df: DataFrame, clean: dict, sizes: dict[str, int],
                         probs: Sequence[float]) -> dict[str, list]:
    """Quantiles of columns with many distinct values; None where a bracket missed its rank.

    Brackets are literals: one job finds them, one counts the rows below them and one
    counts the few values inside.
    """
    cols = list(clean)
    ends = F.array(*[F.lit(min(1.0, max(0.0, p + side * BRACKET_SHARE))) for p in probs for side in (-1, 1)])
    sketch = df.agg(*[F.percentile_approx(clean[c], ends, F.lit(ACCURACY)).alias(f"_e{i}")
                      for i, c in enumerate(cols)]).first()
    wanted = [(c, j, p * (sizes[c] - 1), sketch[f"_e{i}"][2 * j], sketch[f"_e{i}"][2 * j + 1])
              for i, c in enumerate(cols) for j, p in enumerate(probs)]
    under = df.agg(*[F.count_if(clean[c] < F.lit(lo)).alias(f"_b{k}") for k, (c, _, _, lo, _) in enumerate(wanted)]).first()
    inside = [clean[c].between(F.lit(lo), F.lit(hi)) for c, _, _, lo, hi in wanted]
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when(inside[k], clean[w[0]]).alias("x"))
                                  for k, w in enumerate(wanted)]))
    counted = df.filter(any_of(inside)).select(entries.alias("_e")).select("_e.*").filter("x is not null").groupBy(
        "k", "x").agg(F.count(F.lit(1)).alias("n"))
    ranks = [[(math.floor(q) - under[f"_b{k}"], math.ceil(q) - under[f"_b{k}"])] for k, (_, _, q, _, _) in enumerate(wanted)]
    found = _pick(counted, "k", ranks)
    result: dict[str, list] = {c: [None] * len(probs) for c in cols}
    for k, (c, j, q, _, _) in enumerate(wanted):
        low, high = found.get(k, [(None, None)])[0]
        if low is not None and high is not None:
            result[c][j] = low + (high - low) * (q - math.floor(q))
    return result


def size_measures(cols: Sequence[str]) -> list:
    """Aggregates that tell :func:`quantile_values` how many and how many distinct values there are."""
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols]
    return [f.alias(f"_{n}{i}") for i, c in enumerate(clean)
            for n, f in (("n", F.count(c)), ("d", F.approx_count_distinct(c)))]


def quantile_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float], direct_rows: int = DIRECT_ROWS,
                    sizes: Sequence[tuple[int, int]] | None = None,
                    bracket_rows: int = BRACKET_ROWS) -> dict[str, list[float | None]]:
    """Quantiles of whole columns as numbers, in the order of ``probs``.

    ``sizes`` holds the present and the (approximately) distinct values of each column, if
    the caller has counted them with :func:`size_measures`.
    """
    cols, probs = list(cols), [float(p) for p in probs]
    if not cols:
        return {}
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
    if sizes is None:
        row = df.agg(*size_measures(cols)).first()
        sizes = [(row[f"_n{i}"], row[f"_d{i}"]) for i in range(len(cols))]
    present = {c: n for c, (n, _) in zip(cols, sizes, strict=True)}
    distinct = {c: d for c, (_, d) in zip(cols, sizes, strict=True)}
    largest = max(present.values())

    def at_once(names: Sequence[str], direct: int) -> dict[str, list[float | None]]:
        rows = quantiles(df, names, probs, direct_rows=direct, largest=largest, bracket_rows=bracket_rows).collect()
        at = {(r["column"], r["prob"]): r["value"] for r in rows}
        return {c: [at.get((c, p)) for p in probs] for c in names}

    if largest <= direct_rows:
        return at_once(cols, direct_rows)
    few = [c for c in cols if distinct[c] <= direct_rows]
    many = [c for c in cols if c not in few]
    result: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    with ThreadPoolExecutor(1) as pool:
        counted = pool.submit(_counted_quantiles, df, {c: clean[c] for c in few}, present, probs)
        if many and largest <= bracket_rows:
            result |= _bracketed_quantiles(df, {c: clean[c] for c in many}, present, probs)
            # A bracket misses only when the approximate quantile is further off than its bound.
            many = [c for c in many if None in result[c]]
        if many:
            result |= at_once(many, 0)
        return result | counted.result()
