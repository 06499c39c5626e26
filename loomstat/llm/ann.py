"""Approximate nearest neighbours: probed lists and adaptive dimension scans.

Rows are dealt to the nearest of some centres (k-means on a bounded sample), every row of the
table.  A query probes its nearest lists.  Inside a list, vectors are rotated at random and
read in column blocks: after d of D dimensions the partial distance, scaled by D / d, estimates
the whole one, and a candidate is abandoned when the hypothesis that it is near enough can be
rejected (Gao and Long 2023).  Survivors are measured exactly, on original vectors in double
precision.  A query that is left with fewer than ``k`` rows probes further lists by the distance of
their centres, without abandoning, until it has them or no list is left.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import seeded_sample, stored

#: The sample that centres, number of probes and first thresholds come from.
SAMPLE_ROWS = 16_384
SAMPLE_BYTES = 64 << 20
MAX_LISTS = 4_096
TARGET = 0.98
COLUMNS = 16
#: A candidate is abandoned if its estimate exceeds the threshold by more than (1 + SLACK / sqrt(d)).
SLACK = 2.1


@dataclass
class Index:
    centres: np.ndarray
    rotation: np.ndarray
    probes: int
    sample: np.ndarray
    sample_list: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        for c in range(k):
            own = x[near == c]
            centres[c] = own.mean(0) if len(own) else x[rng.integers(len(x))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.int64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = squared(x[i : i + 4096], centres).argmin(1)
    return out


def fit(x: np.ndarray, lists: int, k: int, target: float, seed: int) -> Index:
    """Centres from the sample, and the fewest probes that find ``target`` of sampled neighbours in it."""
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    centres = kmeans(x, min(lists, len(x)), seed)
    near = nearest(x, centres)
    asked = rng.choice(len(x), min(256, len(x)), replace=False)
    dist = squared(x[asked], x)
    dist[np.arange(len(asked)), asked] = np.inf
    true = np.argsort(dist, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    rank = np.argsort(np.argsort(squared(x[asked], centres), axis=1), axis=1)
    needed = np.sort(rank[np.arange(len(asked))[:, None], near[true]].ravel()) if true.size else np.zeros(1)
    probes = int(needed[min(len(needed) - 1, math.ceil(target * len(needed)))]) + 1
    return Index(centres, rotation, min(probes, len(centres)), x, near)


def scan(index: Index, q: np.ndarray, x: np.ndarray, limit: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, distance) of all candidates that no test rejects.

    ``limit``: squared distance that a query's neighbours surely stay within; ``same``: pairs to leave out.
    """
    d = x.shape[1]
    rq, rx = q @ index.rotation, x @ index.rotation
    first = min(COLUMNS, d)
    part = squared(rq[:, :first], rx[:, :first])
    qi, xi = np.nonzero(~same & (part * (d / first) <= (limit * (1 + SLACK / math.sqrt(first)) ** 2)[:, None]))
    part = part[qi, xi]
    for a in range(first, d, COLUMNS):
        b = min(a + COLUMNS, d)
        part = part + ((rq[qi, a:b] - rx[xi, a:b]) ** 2).sum(1)
        slack = (1 + SLACK / math.sqrt(b)) ** 2 if b < d else 1 + 1e-9
        keep = part * (d / b) <= limit[qi] * slack
        qi, xi, part = qi[keep], xi[keep], part[keep]
    return qi, xi, np.sqrt(((q[qi] - x[xi]) ** 2).sum(1))


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _closest(qid: np.ndarray, vid: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` nearest of every query, ties to the smaller id."""
    order = np.lexsort((vid, dist, qid))
    qs = qid[order]
    begin = np.flatnonzero(np.concatenate(([True], qs[1:] != qs[:-1]))) if len(qs) else np.zeros(0, np.int64)
    rank = np.arange(len(qs)) - np.repeat(begin, np.diff(np.append(begin, len(qs))))
    return order[rank < k]


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
           target: float = TARGET, seed: int = 4, lists: int | None = None, block: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest rows found for each row that ``is_query`` (a column) marks.

    ``score`` is the Euclidean distance; ties go to the smaller id.  Rows with a null id, a null
    or empty vector, null or non-finite components, only zeros, or a length other than the most
    frequent one take no part.  Rows with the query's own id are no candidates; otherwise repeated
    rows are candidates of their own.  Index fitting reads a sample of at most ``SAMPLE_ROWS``
    rows and ``SAMPLE_BYTES``; every row is indexed.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("asks"))
    rows = rows.where("id is not null and v is not null and size(v) > 0").where(
        F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    if not lengths:
        return empty
    d, n = lengths[0]
    rows = rows.where(F.size("v") == d)
    bound = max(2, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * d)))
    sample = seeded_sample(rows, "id", bound, n).select("v").collect()
    lists = lists or min(max(1, round(math.sqrt(n) / 2)), MAX_LISTS)
    block = block or max(256, round(math.sqrt(n)))
    index = spark.sparkContext.broadcast(fit(np.array([r.v for r in sample]), lists, k, target, seed))

    def deal(batches):
        """Every row with its list, queries also with the lists that they probe and their first threshold."""
        held = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch["v"].flatten()).reshape(batch.num_rows, d)
            own = nearest(x, held.centres)
            asks = np.asarray(batch["asks"].fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
            probed, limit = [None] * len(x), np.full(len(x), np.nan)
            at = np.flatnonzero(asks)
            order = np.argsort(squared(x[at], held.centres), axis=1)[:, : held.probes] if len(at) else []
            for i, mine in zip(at, order, strict=True):
                probed[i] = mine.tolist()
                seen = held.sample[np.isin(held.sample_list, mine)]
                # One more than k: the query itself may be in the sample.  The last term covers rounding.
                near = np.partition(((seen - x[i]) ** 2).sum(1), k)[k] if len(seen) > k else np.inf
                limit[i] = near * (1 + 1e-9) + 1e-9 * (x[i] @ x[i])
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(own), pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary()),
                 pa.array(probed, pa.list_(pa.int64())), pa.array(limit)], ["id", "list", "v", "probed", "bound"])

    dealt = stored(rows.mapInArrow(deal, "id long, list long, v binary, probed array<long>, bound double"), "lists")
    counted = dealt.groupBy("list").count()  # at most MAX_LISTS rows
    counts = np.zeros(len(index.value.centres), np.int64)
    for r in counted.collect():
        counts[r["list"]] = r["count"]
    sizes = F.broadcast(counted.select("list", F.ceil(F.col("count") / block).alias("blocks")))
    held = dealt.join(sizes, "list").select("list", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id", "v")

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            vid, x = left["id"].to_numpy(), _vectors(left["v"])
            for a in range(0, right.num_rows, 512):
                part = right.slice(a, 512)
                qid, q, limit = part["query_id"].to_numpy(), _vectors(part["query"]), part["bound"].to_numpy()
                qi, xi, dist = scan(index.value, q, x, limit, qid[:, None] == vid[None, :])
                best = _closest(qi, vid[xi], dist, k)
                found.append((qid[qi[best]], vid[xi[best]], dist[best]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table(dict(zip(("query_id", "id", "score"), map(pa.array, columns), strict=True)))

    def answered(asking: DataFrame) -> DataFrame:
        """The best of the probed lists; ``asking``: (id, v, bound, probed)."""
        asked = asking.select("id", "v", "bound", F.explode("probed").alias("list")).join(sizes, "list")
        asked = asked.select(F.col("list").alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"),
                             F.col("id").alias("query_id"), F.col("v").alias("query"), "bound")
        pairs = held.groupBy("list", "block").cogroup(asked.groupBy("at", "part")).applyInArrow(
            measure, "query_id long, id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
        return pairs.withColumn("rank", rank).where(F.col("rank") <= k)

    asking = dealt.where("probed is not null").select("id", "v", "bound", "probed")
    result, wanted = stored(answered(asking), "found"), 2 * k
    while True:
        complete = result.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
        short = stored(asking.join(complete, "id", "left_anti"), "short")
        if short.isEmpty() or wanted >= 2 * n:
            break
        # Few rows in the probed lists, or too many abandoned: more lists, and no row abandoned.
        more = stored(answered(short.mapInArrow(_further(index, counts, wanted), short.schema)), "found")
        result = result.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(more)
        wanted = min(8 * wanted, 2 * n)
    return result.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _further(index, counts: np.ndarray, wanted: int):
    """Queries that probe as many lists, nearest first, as hold ``wanted`` rows, without a threshold."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(squared(_vectors(batch["v"]), index.value.centres), axis=1)
                enough = (np.cumsum(counts[order], axis=1) < wanted).sum(axis=1) + 1
                probed = [o[:e].tolist() for o, e in zip(order, enough.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(np.full(batch.num_rows, np.inf)), pa.array(probed, pa.list_(pa.int64()))],
                                                 ["id", "v", "bound", "probed"])

    return run


def query(spark, folder: str) -> DataFrame:
    """``op4``: ten nearest rows of every row whose id is divisible by 100."""
    from .shared import table

    return search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)
