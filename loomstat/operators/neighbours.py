"""Exact nearest rows by a partitioned search.

Training rows are assigned to the nearest of a few sampled pivots, whose number grows with the
square root of the rows.  Every query first searches its own cell.  The k-th distance found there
bounds the others: a cell is left out if its radius, or for Euclidean distances the border between
its pivot and the query's, says that all its rows are farther.  On data without clusters (many
dimensions, no structure) neither bound rules out much, and an exact search must compare nearly
all pairs.

Cells are cut into blocks of bounded bytes and so are the queries visiting them; each task
compares one block of queries with one block of rows and passes on at most k rows per query, and a
top-k over the blocks gives the exact result.

Inside a task distances are abandoned early, still exactly: vectors are turned so that the columns of
largest variance come first, and the part of a distance that lies in the first columns is a lower
bound of the whole.  Runs of rows whose box is farther than the k-th distance known are skipped; of the
others, pairs are dropped column block by column block.  The k-th distance of a query's own cell goes
along to the others.  What is left is measured on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed import SEED
from ..session import counted_broadcast, materialise

# Rows up to which one cell is enough, and bytes of vectors in a block.
CELL_ROWS = 4096
BLOCK_BYTES = 8 << 20

# Rows that the rotation is fitted on at most, and the widest vectors that are turned; wider ones
# are only put in the order of their columns' variance.  Neither changes a result.
ROTATION_ROWS = 2048
TURNED = 1024

# Rows of a run with one box, queries searched together, columns by which a bound grows.
RUN_ROWS = 1024
TOGETHER = 256
STEP = 8

# Share of pairs below which the others are added up one by one, rows of queries whose absolute differences are held at
# once, and the number up to which sums of powers fit single precision.
SPARSE = 0.2
TILE = 32
SINGLE = 1e15

# Elements of a matrix of distances to pivots that is held at once, and bytes of vectors that are sent on at once.
HELD = 1 << 20
SENT_BYTES = 4 << 20


def as_array(df: DataFrame, col: str) -> Column:
    """A vector or array column as array<double>."""
    if isinstance(df.schema[col].dataType, T.ArrayType):
        return F.col(col).cast("array<double>")
    return vector_to_array(F.col(col))


def pairwise(left: np.ndarray, right: np.ndarray, p: int) -> np.ndarray:
    """Minkowski distances, summed dimension by dimension, so that equal rows are at exactly 0."""
    total = np.zeros((len(left), len(right)))
    for j in range(left.shape[1]):
        gap = np.abs(left[:, j, None] - right[None, :, j])
        total += gap * gap if p == 2 else gap
    return np.sqrt(total) if p == 2 else total


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def rotation(sample: np.ndarray, p: int) -> np.ndarray:
    """An orthogonal matrix that puts the directions of largest variance first; for p = 1, or wide vectors, a permutation."""
    width = sample.shape[1]
    if p == 2 and width <= TURNED and len(sample) > 1:
        _, axes = np.linalg.eigh(np.atleast_2d(np.cov(sample, rowvar=False)))
        return axes[:, ::-1]
    return np.eye(width)[:, np.argsort(-sample.std(axis=0), kind="stable")] if len(sample) else np.eye(width)


def _add_parts(total: np.ndarray, left: np.ndarray, right: np.ndarray, p: int) -> None:
    """Adds the parts of all distances (squared for p = 2) in some columns, without a matrix besides one of few rows."""
    if p == 2:
        total -= (2 * left) @ right.T
        total += (left * left).sum(1)[:, None]
        total += (right * right).sum(1)[None, :]
        return
    right = np.ascontiguousarray(right.T)
    gap = np.empty((min(TILE, len(left)), total.shape[1]), total.dtype)
    for a in range(0, len(left), TILE):
        part, own = total[a : a + TILE], gap[: len(left) - a]
        for j in range(left.shape[1]):
            np.subtract(left[a : a + TILE, j, None], right[j], out=own)
            np.abs(own, out=own)
            part += own


def _measured(left: np.ndarray, right: np.ndarray, p: int) -> np.ndarray:
    """Distances of pairs, rounded as :func:`pairwise` rounds them."""
    total = np.zeros(len(left))
    for j in range(left.shape[1]):
        gap = np.abs(left[:, j] - right[:, j])
        total += gap * gap if p == 2 else gap
    return np.sqrt(total) if p == 2 else total


class Search:
    """The k nearest of some rows, in the order of their ids, within a limit; counts the terms of distances that it adds up."""

    def __init__(self, rows: np.ndarray, k: int, p: int, turn: np.ndarray):
        self.rows, self.k, self.p, self.turn = rows, k, p, turn
        turned = rows @ turn
        order = np.argsort(turned[:, 0], kind="stable")
        self.runs = [order[a : a + RUN_ROWS] for a in range(0, len(order), RUN_ROWS)]
        self.turned = [turned[r] for r in self.runs]
        self.most = float(np.abs(rows).max(initial=0.0))
        self.single = [t.astype(np.float32) for t in self.turned] if self.most < SINGLE else []
        self.low, self.high = (np.stack([f(t, axis=0) for t in self.turned]) for f in (np.min, np.max))
        self.size = float((np.abs(rows) ** p).sum(axis=1).max()) if len(rows) else 0.0
        self.terms = 0

    def _allowed(self, limit: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Limits of sums of powers, with a margin that covers rounding."""
        slack = 1e-11 * ((np.abs(queries) ** self.p).sum(axis=1) + self.size)
        return (limit * limit if self.p == 2 else limit) * (1 + 1e-9) + slack

    def __call__(self, queries: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of at most k rows for every query, none farther than its limit."""
        found = []
        for a in range(0, len(queries), TOGETHER):
            q, row, distance = self._some(queries[a : a + TOGETHER], limit[a : a + TOGETHER])
            found.append((q + a, row, distance))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    def _some(self, queries: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        turned, limit = queries @ self.turn, limit.copy()
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        least = np.zeros((len(queries), len(self.runs)))
        for r in range(len(self.runs)):
            gap = np.maximum(np.maximum(self.low[r] - turned, turned - self.high[r]), 0.0)
            least[:, r] = (gap ** self.p).sum(axis=1)
        for r in np.argsort(least.sum(axis=0), kind="stable"):
            own = np.flatnonzero(least[:, r] <= self._allowed(limit, queries))
            if not len(own):
                continue
            q, row, limit[own] = self._pairs(queries[own], turned[own], r, limit[own])
            self.terms += len(q) * self.rows.shape[1]
            distance = _measured(queries[own[q]], self.rows[row], self.p)
            best = self._top(*(np.concatenate(c) for c in zip(best, (own[q], row, distance), strict=True)))
            count = np.bincount(best[0], minlength=len(queries))
            last = np.cumsum(count) - 1
            full = count >= self.k
            limit[full] = np.minimum(limit[full], best[2][last[full]])
        near = best[2] <= limit[best[0]]
        return best[0][near], best[1][near], best[2][near]

    def _top(self, q: np.ndarray, row: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((row, distance, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = rank < self.k
        return q[keep], row[order][keep], distance[order][keep]

    def _pairs(self, queries: np.ndarray, turned: np.ndarray, r: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a run that may be near enough, and limits lowered by the rows that look nearest.

        Sums are added up in single precision where numbers allow it; what they can be wrong by is added to the limits.
        """
        ids, width = self.runs[r], turned.shape[1]
        kind = np.float32 if max(self.most, float(np.abs(queries).max(initial=0.0))) < SINGLE else np.float64
        rows, turned = self.turned[r].astype(kind, copy=False) if kind == np.float64 else self.single[r], turned.astype(kind)
        wrong = 4 * (width + 8) * float(np.finfo(kind).eps) * ((np.abs(queries) ** self.p).sum(axis=1) + self.size) + 1e-35

        def allowed(limit: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                return ((self._allowed(limit, queries) + wrong) * (1 + 1e-6)).astype(kind)

        most, unbounded, at = allowed(limit), np.flatnonzero(np.isinf(limit)), 0
        part = np.zeros((len(queries), len(ids)), kind)
        while at < width and (not at or len(unbounded) or np.count_nonzero(part <= most[:, None]) > SPARSE * part.size):
            end = min(at + STEP, width)
            _add_parts(part, turned[:, at:end], rows[:, at:end], self.p)
            self.terms += part.size * (end - at)
            at = end
        if len(unbounded) and len(ids) > self.k:
            look = np.argpartition(part[unbounded], self.k - 1, axis=1)[:, : self.k]
            seen = _measured(np.repeat(queries[unbounded], self.k, axis=0), self.rows[ids[look.ravel()]], self.p).reshape(look.shape)
            self.terms += look.size * width
            limit[unbounded] = seen.max(axis=1)
            most = allowed(limit)
        q, row = np.nonzero(part <= most[:, None])
        sums = part[q, row]
        while at < width and len(q):
            end = min(at + STEP, width)
            sums = sums + (np.abs(turned[q, at:end] - rows[row, at:end]) ** self.p).sum(axis=1)
            self.terms += len(q) * (end - at)
            keep = sums <= most[q]
            q, row, sums, at = q[keep], row[keep], sums[keep], end
        crowded = np.bincount(q, minlength=len(queries)) > 2 * self.k
        if crowded.any():
            # Queries with many such rows: the k that look nearest bound the others.
            own = np.flatnonzero(crowded[q])
            own = own[np.lexsort((sums[own], q[own]))]
            own = own[np.arange(len(own)) - np.searchsorted(q[own], q[own], side="left") < self.k]
            seen = _measured(queries[q[own]], self.rows[ids[row[own]]], self.p).reshape(-1, self.k).max(axis=1)
            self.terms += len(own) * width
            limit[crowded] = np.minimum(limit[crowded], seen)
            keep = sums <= allowed(limit)[q]
            q, row = q[keep], row[keep]
        return q, ids[row], limit


def _assign(rows: DataFrame, pivots: np.ndarray, cells: np.ndarray, p: int) -> DataFrame:
    """Add the cell of the nearest pivot and the distance to it."""
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType())])
    shared, step = rows.sparkSession.sparkContext.broadcast((pivots, cells)), max(1, HELD // len(pivots))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, cells = shared.value
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.iloc[start:start + step]
                distance = pairwise(_stack(part["x"]), pivots, p)
                nearest = distance.argmin(axis=1)
                yield part.assign(cell=cells[nearest].astype("int32"), reach=distance[np.arange(len(part)), nearest])

    return rows.mapInPandas(run, schema)


def _route(queries: DataFrame, pivots: np.ndarray, cells: np.ndarray, radius: np.ndarray, p: int) -> DataFrame:
    """One row per query and further cell that can hold a row nearer than ``limit``; ``pivots``: of the cells.

    A row of cell c is at least d(q, c) - radius(c) from the query (triangle inequality); for
    p = 2 it is also at least as far as the plane between c and the query's own pivot o, which is
    (d(q, c)² - d(q, o)²) / (2 d(c, o)) away.
    """
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), queries.schema["x"],
                           T.StructField("cell", T.IntegerType()), T.StructField("limit", T.DoubleType())])
    shared, step = queries.sparkSession.sparkContext.broadcast((pivots, cells, radius)), max(1, HELD // len(cells))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, cells, radius = shared.value
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.iloc[start:start + step]
                distance = pairwise(_stack(part["x"]), pivots, p)
                own = np.searchsorted(cells, part["cell"].to_numpy())
                least = distance - radius[None, :]
                if p == 2:
                    homes, place = np.unique(own, return_inverse=True)
                    apart = pairwise(pivots[homes], pivots, 2)[place]
                    home = distance[np.arange(len(part)), own][:, None]
                    plane = (distance * distance - home * home) / (2 * np.where(apart > 0, apart, np.inf))
                    least = np.maximum(least, plane)
                # The margin covers rounding in the distances.
                limit = part["limit"].to_numpy(dtype=float, na_value=np.inf)
                visit = least <= (limit * (1 + 1e-9) + 1e-9)[:, None]
                visit[np.arange(len(part)), own] = False
                row, cell = np.nonzero(visit)
                # Every visit carries its query's vector.
                most = max(1, SENT_BYTES // (8 * pivots.shape[1]))
                for a in range(0, len(row), most):
                    r, c = row[a : a + most], cell[a : a + most]
                    yield part.iloc[r][["qid", "x"]].assign(cell=cells[c].astype("int32"), limit=limit[r])

    return queries.mapInPandas(run, schema)


def _nearest_in_block(queries: pd.DataFrame, train: pd.DataFrame, k: int, p: int, turn: np.ndarray) -> pd.DataFrame:
    """The k nearest rows of one block for every query, within its limit, ties by row id."""
    train = train.sort_values("tid", kind="stable")
    q, row, distance = Search(_stack(train["x"]), k, p, turn)(_stack(queries["x"]), queries["limit"].to_numpy(dtype=float))
    taken = train.iloc[row]
    return pd.DataFrame({"qid": queries["qid"].to_numpy()[q], "tid": taken["tid"].to_numpy(), "payload": taken["payload"].to_numpy(), "distance": distance})


def _compared(asked: DataFrame, placed: DataFrame, sizes: DataFrame, k: int, p: int, result: T.StructType, block_bytes: int,
              turn: np.ndarray) -> DataFrame:
    """The k nearest rows of every visited cell block for every query; ``asked``: (cell, qid, x, limit)."""
    rows = max(1, block_bytes // (8 * len(turn)))
    shared = asked.sparkSession.sparkContext.broadcast(turn)
    grid = sizes.join(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("qblocks")), "cell").select(
        "cell", "qblocks", F.ceil(F.col("rows") / rows).cast("int").alias("tblocks"))
    grid = counted_broadcast(grid)
    spread = placed.join(grid, "cell").select(
        "cell", "tid", "x", "payload", F.pmod(F.xxhash64("tid"), F.col("tblocks")).cast("int").alias("tblock"),
        F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)).alias("qblock"))
    asked = asked.join(grid, "cell").select(
        F.col("cell").alias("qcell"), "qid", F.col("x").alias("qx"), "limit", F.pmod(F.xxhash64("qid"), F.col("qblocks")).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("tblocks") - 1)).alias("tb"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in result.fields})
        return _nearest_in_block(left.rename(columns={"qx": "x"}), right, k, p, shared.value)

    return asked.groupBy("qcell", "tb", "qb").cogroup(spread.groupBy("cell", "tblock", "qblock")).applyInPandas(compare, result)


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("qid").orderBy("distance", "tid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, train: DataFrame, k: int, query_id: str, train_id: str, vector: str = "features",
            p: int = 2, payload: list[str] | None = None, cell_rows: int = CELL_ROWS, block_bytes: int = BLOCK_BYTES,
            seed: int = SEED) -> DataFrame:
    """(qid, tid, distance, rank, payload): the k nearest training rows of every query.

    Ids must be unique.  ``payload`` names numeric training columns to carry along, as an
    array.  Distances tie by training id.  With fewer than k training rows all are returned.
    Rows whose vector is null or holds null or NaN take no part, on either side.
    """
    carried = F.array(*[F.col(c).cast("double") for c in payload or []]).cast("array<double>")
    whole = "x is not null and forall(x, v -> v is not null and not isnan(v))"
    t = train.select(F.col(train_id).alias("tid"), as_array(train, vector).alias("x"), carried.alias("payload")).where(whole)
    q = queries.select(F.col(query_id).alias("qid"), as_array(queries, vector).alias("x")).where(whole)
    n = t.count()
    result = T.StructType([q.schema["qid"], t.schema["tid"], t.schema["payload"],
                           T.StructField("distance", T.DoubleType())])
    if n == 0:
        empty = train.sparkSession.createDataFrame([], result)
        return empty.select("qid", "tid", "distance", F.lit(1).alias("rank"), "payload")
    wanted_cells = 1 if n <= cell_rows else math.ceil(math.sqrt(n) / 4)
    chosen = t.select("x", F.xxhash64(F.lit(seed), "tid").alias("h")).orderBy("h").limit(max(wanted_cells, ROTATION_ROWS))
    sample = np.array([r["x"] for r in chosen.collect()], dtype=float)
    turn = rotation(sample[:ROTATION_ROWS], p)
    pivots = np.unique(sample[:wanted_cells], axis=0)
    columns = ["qid", "tid", "distance", "rank", "payload"]

    placed = materialise(_assign(t, pivots, np.arange(len(pivots)), p))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("reach").alias("radius"))
    found_cells = sorted(sizes.collect(), key=lambda r: r["cell"])  # as many rows as pivots
    cells = np.array([r["cell"] for r in found_cells])
    pivots = pivots[cells]
    sizes = train.sparkSession.createDataFrame([(r["cell"], r["rows"]) for r in found_cells], "cell int, rows long")
    home = _assign(q, pivots, cells, p).drop("reach").withColumn("limit", F.lit(float("inf")))
    if len(cells) == 1:
        return _first(_compared(home, placed, sizes, k, p, result, block_bytes, turn), k).select(*columns)
    home = materialise(home)
    near = materialise(_first(_compared(home, placed, sizes, k, p, result, block_bytes, turn), k).drop("rank"))
    # Without k rows in its own cell a query has no bound yet.
    limits = near.groupBy("qid").agg(F.max("distance").alias("limit"), F.count(F.lit(1)).alias("_n"))
    limits = limits.select(F.col("qid").alias("_qid"), F.when(F.col("_n") >= k, F.col("limit")).otherwise(float("inf")).alias("limit"))
    bounded = home.drop("limit").join(limits, F.col("qid") == F.col("_qid")).select("qid", "x", "cell", "limit")
    routed = materialise(_route(bounded, pivots, cells, np.array([r["radius"] for r in found_cells]), p))
    far = _compared(routed, placed, sizes, k, p, result, block_bytes, turn)
    return _first(near.unionByName(far), k).select(*columns)


def neighbour_mean(found: DataFrame, position: int, weights: str = "uniform") -> Column:
    """Aggregate expression: the (weighted) mean of one payload entry over a query's neighbours.

    With distance weights, rows at distance 0 take all the weight.
    """
    value = F.element_at("payload", position + 1)
    if weights == "uniform":
        return F.avg(value)
    hit = F.avg(F.when(F.col("distance") == 0, value))
    weight = F.when(F.col("distance") > 0, 1.0 / F.col("distance"))
    return F.coalesce(hit, F.sum(value * weight) / F.sum(weight))
