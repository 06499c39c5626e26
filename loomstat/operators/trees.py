"""Tree ensembles as flat arrays, and their growth from histograms of binned features.

Features are cut into at most ``BINS`` bins, at every value of features with few of them, at quantiles
of the others, and rows are stored once as blocks of bytes.  A level of a tree is one pass over the
blocks: each task walks its rows to their nodes and adds up gradients and Hessians by node, feature
and bin; only these cells leave a task.  The best split of a node maximises

    T(GL)² / (HL + λ) + T(GR)² / (HR + λ) - T(G)² / (H + λ),    T(G) = sign(G) · max(|G| - α, 0),

a leaf's value is -T(G) / (H + λ).  Boosting fits the squared error, so a gradient is prediction
minus label and a Hessian 1; a forest's trees start from predictions of 0, and their leaves are means.
Rows and columns are sampled by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import SEED
from ..session import drop_scratch, scratch_path

#: Bins of a feature; they are numbered in one byte.
BINS = 256
#: Rows of a block, and most boosted trees after which the blocks' predictions are written anew.
BLOCK_ROWS = 8192
REWRITE = 16
#: Seconds that a job takes besides its rows, that a row takes to be written, and that it takes to be walked through one tree.
JOB_S, WRITE_S, WALK_S = 0.3, 150e-9, 20e-9
#: Cells of several features that are counted together, and cells of a tree's level that a task holds as arrays.
JOINT = 1024
DENSE = 1 << 16
#: Bytes of binned rows up to which a task holds all of them and grows whole trees, and trees that it grows in a row.
HELD_BYTES = 64 << 20
TREES_A_TURN = 4
#: In such trees, what a later feature's gain must exceed an earlier one's by; less is rounding.
LEAD = 1 + 1e-9
#: Cells that the driver adds up itself; more are added up by Spark.
CELLS = 2_000_000
#: Bytes of trees that are broadcast at once; larger ensembles are broadcast tree group by tree group.
BROADCAST_BYTES = 128 << 20
#: Elements of a matrix of rows and trees that is walked at once.
WALK = 1 << 20
#: Nodes up to which a tree is walked for all rows of a block at once; node numbers fit one byte.
SMALL = 64


@dataclass
class FlatTrees:
    """Nodes of all trees, one after the other: a row goes left where its feature is at most the threshold.

    Leaves have feature -1.  Values already hold the weight of their tree.  NaN goes right.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    roots: np.ndarray
    width: int
    base: float = 0.0
    #: Importances: gains added up, or averaged over the splits of a feature.
    averaged: bool = False

    def tree_values(self, x: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
        """The value of every tree for every row, as rows × trees."""
        roots = self.roots if roots is None else roots
        out = np.empty((len(x), len(roots)))
        step = max(1, WALK // max(len(roots), 1))
        for a in range(0, len(x), step):
            part = x[a : a + step]
            node = np.broadcast_to(roots, (len(part), len(roots))).copy()
            rows = np.arange(len(part))[:, None]
            while (inner := self.feature[node] >= 0).any():
                low = part[rows, np.maximum(self.feature[node], 0)] <= self.threshold[node]
                node = np.where(inner, np.where(low, self.left[node], self.right[node]), node)
            out[a : a + step] = self.value[node]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.tree_values(x).sum(axis=1)

    def used_by_tree(self) -> list[np.ndarray]:
        """The features that each tree splits on."""
        return [np.unique(f[f >= 0]) for f in np.split(self.feature, self.roots[1:])]

    def swapped(self, x: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Predictions with one feature after the other taken from ``other``, as rows × features.

        Only trees that split on a feature are walked again for it.
        """
        plain = self.tree_values(x)
        total = self.base + plain.sum(axis=1)
        out = np.repeat(total[:, None], x.shape[1], axis=1)
        used = self.used_by_tree()
        for j in range(x.shape[1]):
            trees = np.array([t for t, u in enumerate(used) if j in u], dtype=np.int64)
            if len(trees):
                own = x[:, j].copy()
                x[:, j] = other[:, j]
                out[:, j] += (self.tree_values(x, self.roots[trees]) - plain[:, trees]).sum(axis=1)
                x[:, j] = own
        return out

    @property
    def size(self) -> int:
        return sum(a.nbytes for a in (self.feature, self.threshold, self.left, self.right, self.value))

    def groups(self, most: int = BROADCAST_BYTES) -> list[FlatTrees]:
        """The ensemble in groups of whole trees of at most ``most`` bytes, or one tree; the base is in the first."""
        limits = [*self.roots.tolist(), len(self.feature)]
        row = max(1, self.size // max(len(self.feature), 1))
        cuts = [0]
        for t in range(1, len(self.roots) + 1):
            if t == len(self.roots) or (limits[t + 1] - limits[cuts[-1]]) * row > most:
                cuts.append(t)
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = limits[a], limits[b]
            out.append(FlatTrees(self.feature[lo:hi], self.threshold[lo:hi], self.left[lo:hi] - lo, self.right[lo:hi] - lo, self.value[lo:hi],
                                 self.gain[lo:hi], self.roots[a:b] - lo, self.width, self.base if a == 0 else 0.0, self.averaged))
        return out

    def transform(self, df: DataFrame, vector: str, prediction: str) -> DataFrame:
        """Adds predictions; the trees are broadcast, in groups if they are large."""
        spark = df.sparkSession

        def added(group: FlatTrees):
            shared = spark.sparkContext.broadcast(group)

            @F.pandas_udf("double")
            def predicted(x: pd.Series) -> pd.Series:
                return pd.Series(shared.value.predict(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

            return predicted(vector_to_array(vector))

        parts = [added(g) for g in self.groups()] or [F.lit(self.base)]
        return df.withColumn(prediction, reduce(lambda a, b: a + b, parts))

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - as Spark's models call it
        """Shares of the features in the gains of all splits, 0 without a split."""
        inner = self.feature >= 0
        total = np.bincount(self.feature[inner], self.gain[inner], self.width)
        if self.averaged:
            total = total / np.maximum(np.bincount(self.feature[inner], minlength=self.width), 1)
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    def save(self, spark: SparkSession, path: str) -> None:
        columns = {c: getattr(self, c) for c in ("feature", "threshold", "left", "right", "value", "gain")}
        nodes = pa.table({"node": np.arange(len(self.feature)), **columns})
        spark.createDataFrame(nodes).write.mode("overwrite").parquet(f"{path}/nodes")
        about = pa.table({"root": self.roots.astype(np.int64)})
        spark.createDataFrame(about).selectExpr("*", f"{self.width} as width", f"cast('{self.base!r}' as double) as base", f"{str(self.averaged).lower()} as averaged") \
            .write.mode("overwrite").parquet(f"{path}/roots")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FlatTrees:
        nodes, about = spark.read.parquet(f"{path}/nodes").orderBy("node").toArrow(), spark.read.parquet(f"{path}/roots").orderBy("root").toArrow()
        columns = {c: nodes[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value", "gain")}
        return FlatTrees(**columns, roots=about["root"].to_numpy(), width=about["width"][0].as_py(), base=about["base"][0].as_py(),
                         averaged=about["averaged"][0].as_py())


def joined(trees: Sequence[FlatTrees], width: int, base: float = 0.0, averaged: bool = False) -> FlatTrees:
    """One ensemble of several."""
    starts = np.concatenate(([0], np.cumsum([len(t.feature) for t in trees]))).astype(np.int64)

    def column(name: str, kind: type) -> np.ndarray:
        shift = name in ("left", "right", "roots")
        return np.concatenate([getattr(t, name) + (s if shift else 0) for t, s in zip(trees, starts[:-1], strict=True)] or [[]]).astype(kind)

    return FlatTrees(column("feature", np.int32), column("threshold", float), column("left", np.int64), column("right", np.int64),
                     column("value", float), column("gain", float), column("roots", np.int64), width, base, averaged)


def from_spark(model, width: int) -> FlatTrees | None:
    """The trees of a Spark forest or booster, read from where it saves them; None if a split is on more than two categories."""
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    node = F.col("nodeData") if "nodeData" in data.columns else F.struct("*")
    rows = data.select(F.col("treeID").alias("tree"), node.alias("n")).select(
        "tree", F.col("n.id").alias("id"), F.col("n.prediction").alias("value"), F.col("n.gain").alias("gain"), F.col("n.rawCount").alias("count"),
        F.col("n.leftChild").alias("left"), F.col("n.rightChild").alias("right"), F.col("n.split.featureIndex").alias("feature"),
        F.get("n.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.size("n.split.leftCategoriesOrThreshold").alias("listed"), F.col("n.split.numCategories").alias("categories"))
    table = rows.orderBy("tree", "id").toArrow()
    drop_scratch(spark, path)
    column = {c: table[c].to_numpy() for c in table.column_names}
    inner = column["left"] >= 0
    sets = inner & (column["categories"] >= 0)
    if (sets & ((column["categories"] > 2) | (column["listed"] != 1))).any():
        return None
    roots = np.searchsorted(column["tree"], np.arange(len(model.treeWeights)))
    start = roots[column["tree"]]
    left, right = (np.where(inner, column[c] + start, 0) for c in ("left", "right"))
    swap = sets & (column["threshold"] > 0)  # the category 1 goes left
    left, right = np.where(swap, right, left), np.where(swap, left, right)
    weights = np.array(model.treeWeights, dtype=float)
    weights = weights / weights.sum() if type(model).__name__.startswith("RandomForest") else weights
    return FlatTrees(np.where(inner, column["feature"], -1).astype(np.int32), np.where(sets, 0.5, column["threshold"]).astype(float), left.astype(np.int64),
                     right.astype(np.int64), column["value"] * weights[column["tree"]], np.where(inner, column["gain"] * column["count"], 0.0), roots.astype(np.int64), width)


# Binned rows -------------------------------------------------------------------

@dataclass(frozen=True)
class Growth:
    """How trees grow.

    ``least``: smallest Hessian of a child; ``split_least``: smallest one of a node that is split;
    ``rows`` and ``columns``: shares drawn for a tree; ``per_node``: features tried at a split, ``sqrt``,
    ``log2`` or a share.  ``gamma`` takes back, from below, splits that gain less.
    """

    depth: int = 6
    rate: float = 0.3
    l1: float = 0.0
    l2: float = 0.0
    gamma: float = 0.0
    least: float = 1.0
    split_least: float = 2.0
    rows: float = 1.0
    columns: float = 1.0
    per_node: str | float | None = None
    bootstrap: bool = False
    seed: int = SEED


@dataclass
class Binned:
    """Rows as blocks (n, x, y, u, m): bins by feature, labels, hashes, predictions so far."""

    blocks: DataFrame
    edges: list[np.ndarray]
    rows: int
    mean: float
    tasks: int
    path: str

    @property
    def width(self) -> int:
        return len(self.edges)

    @property
    def bins(self) -> list[int]:
        return [len(e) + 1 for e in self.edges]

    def rewrite(self, levels: int) -> int:
        """Trees after which predictions are written anew: the more rows, the fewer, as every level walks through all that wait."""
        own = self.rows / max(1, self.blocks.sparkSession.sparkContext.defaultParallelism)
        return max(1, min(REWRITE, round(np.sqrt(2 * (JOB_S + WRITE_S * own) / (max(1, levels) * WALK_S * max(own, 1.0))))))


def _few_values(x: DataFrame, width: int, bins: int) -> dict[int, np.ndarray]:
    """All values of the features that have at most ``bins`` of them."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray | None] = [np.zeros(0)] * width
        for batch in batches:
            block = _matrix(batch["x"], width)
            for f, had in enumerate(seen):
                if had is not None:
                    both = np.union1d(had, block[:, f][~np.isnan(block[:, f])])
                    seen[f] = both if len(both) <= bins else None
        few = [(f, v) for f, v in enumerate(seen) if v is not None]
        feature = np.concatenate([np.full(len(v), f) for f, v in few] + [np.array([f for f, v in enumerate(seen) if v is None])])
        value = np.concatenate([v for _, v in few] + [np.zeros(sum(v is None for v in seen))])
        many = np.arange(len(feature)) >= len(feature) - sum(v is None for v in seen)
        yield pa.RecordBatch.from_arrays([pa.array(feature.astype(np.int32)), pa.array(value), pa.array(many)], ["feature", "value", "many"])

    found = x.mapInArrow(values, "feature int, value double, many boolean").groupBy("feature").agg(
        F.max("many").alias("many"), F.collect_set("value").alias("values"))
    kept = found.where(f"not many and size(values) <= {bins}").select("feature", "values").collect()
    return {r.feature: np.array(sorted(r["values"])) for r in kept}


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _plain(df: DataFrame, label: str, vector: str, key: Sequence[str]) -> DataFrame:
    """(x, y, u) of the rows with a label."""
    x = df.where(F.col(label).isNotNull()).select(vector_to_array(vector).alias("x"), F.col(label).cast("double").alias("y"), *key)
    return x.select("x", "y", F.xxhash64(*(key or ("x", "y"))).alias("u"))


def bin_rows(df: DataFrame, label: str, vector: str = "features", key: Sequence[str] = (), bins: int = BINS, width: int | None = None) -> Binned:
    """Stores ``df`` in blocks; rows without a label are left out.  The key, or else the row's content, draws samples."""
    spark = df.sparkSession
    x = _plain(df, label, vector, key)
    about = x.agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.max(F.size("x")).alias("width")).first()
    width = int(width or about["width"] or 0)
    few = _few_values(x.select("x"), width, bins) if about["n"] else {}
    edges = [np.zeros(0)] * width
    for f, values in few.items():
        edges[f] = (values[1:] + values[:-1]) / 2
    rest = [f for f in range(width) if f not in few] if about["n"] else []
    for a in range(0, len(rest), 64):
        own = rest[a : a + 64]
        at = [i / bins for i in range(1, bins)]
        there = lambda f: F.when(~F.isnan(F.get("x", F.lit(f))), F.get("x", F.lit(f)))
        row = x.agg(*[F.percentile_approx(there(f), at, 20 * bins).alias(f"q{f}") for f in own]).first()
        for f in own:
            edges[f] = np.unique(np.array(row[f"q{f}"] or [], dtype=float))

    path = scratch_path(spark, "blocks")
    _coded(x, edges, width).write.parquet(path)
    stored = spark.read.parquet(path)
    return Binned(stored, edges, int(about["n"]), float(about["mean"] or 0.0), max(1, stored.rdd.getNumPartitions()), path)


def _coded(x: DataFrame, edges: Sequence[np.ndarray], width: int) -> DataFrame:
    """Blocks of (x, y, u) rows."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _matrix(batch["x"], width)
            y, u = batch["y"].to_numpy(), batch["u"].to_numpy()
            for a in range(0, len(y), BLOCK_ROWS):
                part = whole[a : a + BLOCK_ROWS]
                coded = np.stack([np.searchsorted(e, part[:, f], side="left") for f, e in enumerate(edges)]).astype(np.uint8) if width else np.zeros(0, np.uint8)
                cells = [coded.tobytes(), y[a : a + BLOCK_ROWS].tobytes(), u[a : a + BLOCK_ROWS].tobytes(), np.zeros(len(part)).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], ["n", "x", "y", "u", "m"])

    return x.mapInArrow(blocks, "n int, x binary, y binary, u binary, m binary")


def _read(row: int, batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    n = batch["n"][row].as_py()
    x, y, u, m = (batch[c][row].as_py() for c in ("x", "y", "u", "m"))
    return (np.frombuffer(x, np.uint8).reshape(width, n), np.frombuffer(y), np.frombuffer(u, np.int64).view(np.uint64), np.frombuffer(m))


# Growth ------------------------------------------------------------------------

@dataclass
class _Tree:
    """A tree while it grows; ``cut``: the last bin that goes left, ``slot``: place among the nodes to split, or -1."""

    number: int
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    g: list[float] = field(default_factory=lambda: [0.0])
    h: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    value: list[float] = field(default_factory=lambda: [0.0])
    slot: list[int] = field(default_factory=lambda: [0])

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(c, dtype=np.int64) for c in (self.feature, self.cut, self.left, self.right, self.slot)) + (np.array(self.value),)


def _walk(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The node of every row."""
    feature, cut, left, right = tree[:4]
    if len(feature) <= SMALL:
        return _walk_small(x, *(c.tolist() for c in (feature, cut, left, right)))
    node, rows = np.zeros(x.shape[1], dtype=np.int64), np.arange(x.shape[1])
    while (inner := feature[node] >= 0).any():
        low = x[np.maximum(feature[node], 0), rows] <= cut[node]
        node = np.where(inner, np.where(low, left[node], right[node]), node)
    return node


def _walk_small(x: np.ndarray, feature: list[int], cut: list[int], left: list[int], right: list[int]) -> np.ndarray:
    """The node of every row in one byte: from the leaves up, a split takes the bits of one side or the other."""

    def below(node: int) -> np.ndarray:
        if feature[node] < 0:
            return np.full(1, node, np.uint8)
        low, high = below(left[node]), below(right[node])
        mask = np.negative((x[feature[node]] <= cut[node]).view(np.uint8))
        return high ^ ((low ^ high) & mask)

    return np.broadcast_to(below(0), x.shape[1])


def _uniform(u: np.ndarray, number: int, seed: int) -> np.ndarray:
    """A number of [0, 1) for every row and tree."""
    z = u ^ np.uint64((number * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(18)])


def _weights(u: np.ndarray, number: int, how: Growth) -> np.ndarray | None:
    """How often each row is drawn for a tree; None: all once."""
    if how.bootstrap:
        return np.searchsorted(_POISSON, _uniform(u, number, how.seed), side="right").astype(float)
    return None if how.rows >= 1 else (_uniform(u, number, how.seed) < how.rows).astype(float)


def joint_groups(bins: Sequence[int], features: Sequence[int], most: int = JOINT) -> list[list[int]]:
    """Features in groups with at most ``most`` combinations of bins, or one feature."""
    groups: list[list[int]] = []
    sizes: list[int] = []
    for f in sorted(features, key=lambda f: -bins[f]):
        fits = next((i for i, size in enumerate(sizes) if size * bins[f] <= most), None)
        if fits is None:
            groups.append([f])
            sizes.append(bins[f])
        else:
            groups[fits].append(f)
            sizes[fits] *= bins[f]
    return groups


def _joint(x: np.ndarray, group: Sequence[int], bins: Sequence[int]) -> np.ndarray:
    """The combination of bins of every row."""
    code = x[group[0]].astype(np.uint16)
    for f in group[1:]:
        code = code * np.uint16(bins[f]) + x[f]
    return code


class Counted:
    """Gradients and Hessians of some slots by feature and bin; features are counted in groups, one combination of bins a row."""

    def __init__(self, bins: Sequence[int], features: Sequence[int], slots: int):
        self.bins, self.slots, self.groups = bins, slots, joint_groups(bins, features) or [[]]
        self.sizes = [int(np.prod([bins[f] for f in group], dtype=np.int64)) for group in self.groups]
        self.g, self.h = ([np.zeros(slots * n) for n in self.sizes] for _ in range(2))

    @staticmethod
    def cells(bins: Sequence[int], features: Sequence[int], slots: int) -> int:
        return slots * sum(int(np.prod([bins[f] for f in group], dtype=np.int64)) for group in joint_groups(bins, features) or [[]])

    def add(self, x: np.ndarray, own: np.ndarray | None, slot: np.ndarray, g: np.ndarray, h: np.ndarray | None) -> None:
        """Rows ``own`` of ``x`` (all if None) with their slots, gradients and Hessians (1 each if None)."""
        for i, (group, size) in enumerate(zip(self.groups, self.sizes, strict=True)):
            key = slot * size
            if group:
                code = _joint(x, group, self.bins)
                key += code if own is None else code[own]
            self.g[i] += np.bincount(key, g, self.slots * size)
            self.h[i] += np.bincount(key, h, self.slots * size)

    def by_feature(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(feature, g, h), as slots × bins; feature -1: the slots' totals."""
        for i, group in enumerate(self.groups):
            shape = (self.slots, *(self.bins[f] for f in group))
            g, h = self.g[i].reshape(shape), self.h[i].reshape(shape)
            axes = range(1, len(shape))
            if i == 0:
                yield -1, g.sum(axis=tuple(axes))[:, None], h.sum(axis=tuple(axes))[:, None]
            for at, f in enumerate(group, 1):
                other = tuple(a for a in axes if a != at)
                yield f, g.sum(axis=other), h.sum(axis=other)

    def found(self, first: int) -> Iterator[tuple[np.ndarray, ...]]:
        """The cells with rows, the slots numbered from ``first``."""
        for f, g, h in self.by_feature():
            slot, place = np.nonzero(h)
            yield slot + first, np.full(len(slot), f), place, g[slot, place], h[slot, place]


def _cells(binned: Binned, growing: Sequence[_Tree], pending: Sequence[tuple], how: Growth, columns: Sequence[np.ndarray], forest: bool) -> DataFrame:
    """(slot, feature, bin, g, h) of the rows of every task; feature -1 holds a node's totals."""
    width, bins = binned.width, binned.bins
    shared = binned.blocks.sparkSession.sparkContext.broadcast(([(t.number, t.arrays()) for t in growing], list(pending), list(columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, done, columns = shared.value
        found: list[tuple[np.ndarray, ...]] = []
        # The slots of a tree are numbered in a row.
        first = [int(tree[4][tree[4] >= 0].min(initial=1 << 62)) for _, tree in trees]
        slots = [int((tree[4] >= 0).sum()) for _, tree in trees]
        few = [0 < n and Counted.cells(bins, c.tolist(), n) <= DENSE for n, c in zip(slots, columns, strict=True)]
        counted: dict[int, Counted] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                x, y, u, m = _read(row, batch, width)
                if not forest:
                    m = reduce(lambda a, t: a + t[5][_walk(x, t)], done, m)
                for t, ((number, tree), allowed) in enumerate(zip(trees, columns, strict=True)):
                    slot = tree[4][_walk(x, tree)]
                    weight = _weights(u, number, how)
                    own = np.flatnonzero(slot >= 0 if weight is None else (slot >= 0) & (weight > 0))
                    if not len(own):
                        continue
                    s, g = slot[own], (m - y)[own]
                    h = None if weight is None else weight[own]
                    g = g if weight is None else g * h
                    if few[t]:
                        if t not in counted:
                            counted[t] = Counted(bins, allowed.tolist(), slots[t])
                        counted[t].add(x, own, s - first[t], g, h if how.bootstrap else None)
                        continue
                    h = np.ones(len(own)) if h is None else h
                    for f in (-1, *allowed.tolist()):
                        key = s * BINS + x[f, own] if f >= 0 else s * BINS
                        size = int(key.max()) + 1
                        if size <= 8 * len(own) + BINS:
                            hs = np.bincount(key, h, size)
                            at = np.flatnonzero(hs)
                            gs, hs = np.bincount(key, g, size)[at], hs[at]
                        else:
                            at, inverse = np.unique(key, return_inverse=True)
                            gs, hs = np.bincount(inverse, g), np.bincount(inverse, h)
                        found.append((at // BINS, np.full(len(at), f), at % BINS, gs, hs))
        for t, sums in counted.items():
            found += sums.found(first[t])
        if found:
            slot, feature, place, g, h = (np.concatenate(c) for c in zip(*found, strict=True))
            slot, feature, place, g, h = add_cells(slot, feature, place, g, h)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(feature.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(g), pa.array(h)],
                                             ["slot", "feature", "bin", "g", "h"])

    return binned.blocks.mapInArrow(run, "slot int, feature int, bin int, g double, h double")


def add_cells(slot, feature, place, g, h) -> tuple[np.ndarray, ...]:
    """Cells of the same slot, feature and bin added up, in that order."""
    key = (slot.astype(np.int64) * (1 << 24) + feature + 1) * BINS + place
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    at = order[first]
    sums = [np.add.reduceat(v[order], first) if len(first) else v for v in (g, h)]
    return slot[at], feature[at], place[at], *sums


def _score(g: np.ndarray, h: np.ndarray, how: Growth) -> np.ndarray:
    t = np.maximum(np.abs(g) - how.l1, 0.0)
    return np.divide(t * t, h + how.l2, out=np.zeros_like(t), where=h + how.l2 > 0)


def best_splits(slot, feature, place, g, h, how: Growth, allowed: Sequence[np.ndarray]) -> dict[int, tuple]:
    """slot → (G, H, gain, feature, bin, GL, HL) of its best split; feature -1 without one.  Cells come added up and in order.

    Ties go to the smaller feature, then to the smaller bin.
    """
    totals = feature < 0
    out = {int(s): (float(a), float(b), 0.0, -1, 0, 0.0, 0.0) for s, a, b in zip(slot[totals], g[totals], h[totals], strict=True)}
    slot, feature, place, g, h = (v[~totals] for v in (slot, feature, place, g, h))
    if not len(slot):
        return out
    key = slot.astype(np.int64) << 24 | feature
    first = np.append(True, key[1:] != key[:-1])
    run = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    stops = np.append(starts[1:], len(key)) - 1

    def below(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.cumsum(v)
        before = (total - v)[starts][run]
        return total - before, (total[stops] - (total - v)[starts])[run]

    (gl, gt), (hl, ht) = below(g), below(h)
    gain = _score(gl, hl, how) + _score(gt - gl, ht - hl, how) - _score(gt, ht, how)
    last = np.zeros(len(key), dtype=bool)
    last[stops] = True
    able = ~last & (hl >= how.least) & (ht - hl >= how.least) & (ht >= how.split_least)
    able &= gain > 1e-12 * np.maximum(1.0, _score(gt, ht, how))
    if how.per_node is not None:
        able &= np.array([f in allowed[s] for s, f in zip(slot.tolist(), feature.tolist(), strict=True)])
    at = np.flatnonzero(able)
    if len(at):
        order = at[np.lexsort((at, -gain[at], slot[at]))]
        for i in order[np.append(True, slot[order][1:] != slot[order][:-1])].tolist():
            total = out[int(slot[i])]
            out[int(slot[i])] = (total[0], total[1], float(gain[i]), int(feature[i]), int(place[i]), float(gl[i]), float(hl[i]))
    return out


def _tried(count: int, choice: str | float | None) -> int:
    if choice is None:
        return count
    if choice in ("sqrt", "log2"):
        return max(1, int(np.sqrt(count) if choice == "sqrt" else np.log2(max(count, 2))))
    return max(1, int(float(choice) * count))


def _drawn(nodes: np.ndarray, number: int, columns: np.ndarray, how: Growth) -> np.ndarray:
    """The features tried at some nodes of a tree, in order, as nodes × tried."""
    place = nodes.astype(np.uint64)[:, None] * np.uint64(1 << 20) + columns.astype(np.uint64)[None, :]
    first = np.argsort(_uniform(place, number, how.seed + 1), axis=1, kind="stable")[:, : _tried(len(columns), how.per_node)]
    return np.sort(columns[first], axis=1)


def _found_splits(cells: DataFrame, how: Growth, allowed: list[np.ndarray], collect: bool) -> dict[int, tuple]:
    if collect:
        table = cells.toArrow()
        return best_splits(*add_cells(*(table[c].to_numpy() for c in ("slot", "feature", "bin", "g", "h"))), how, allowed)
    added = cells.groupBy("slot", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    names = ["slot", "G", "H", "gain", "feature", "bin", "GL", "HL"]

    def best(part: pa.Table) -> pa.Table:
        found = best_splits(*add_cells(*(part[c].to_numpy() for c in ("slot", "feature", "bin", "g", "h"))), how, allowed)
        columns = [np.array(c) for c in zip(*((s, *v) for s, v in found.items()), strict=True)]
        return pa.table([pa.array(c.astype(np.int32) if n in ("slot", "feature", "bin") else c.astype(float)) for n, c in zip(names, columns, strict=True)], names=names)

    rows = added.groupBy("slot").applyInArrow(best, "slot int, G double, H double, gain double, feature int, bin int, GL double, HL double").collect()
    return {r.slot: tuple(r)[1:] for r in rows}


def _grow(binned: Binned, numbers: Sequence[int], pending: Sequence[tuple], how: Growth, forest: bool) -> list[_Tree]:
    """Trees grown together, one pass a level."""
    trees, width = [_Tree(n) for n in numbers], binned.width
    columns = [np.arange(width)] * len(trees)
    if how.columns < 1:
        columns = [np.sort(np.random.default_rng([how.seed, n]).permutation(width)[: _tried(width, how.columns)]) for n in numbers]
    for depth in range(how.depth + 1):
        allowed: list[np.ndarray] = []
        active = []
        for t, tree in enumerate(trees):
            for node, slot in enumerate(tree.slot):
                if slot >= 0:
                    tree.slot[node] = len(active)
                    active.append((t, node))
                    allowed.append(columns[t] if how.per_node is None else _drawn(np.array([node]), tree.number, columns[t], how)[0])
        if not active or (depth == how.depth and depth > 0):
            break
        most = min(len(active) * BINS, binned.rows * len(trees)) * (width + 1)
        cells = _cells(binned, trees, pending, how, columns, forest)
        found = _found_splits(cells, how, allowed if how.per_node is not None else [], most * binned.tasks <= CELLS)
        for s, (t, node) in enumerate(active):
            tree = trees[t]
            tree.slot[node] = -1
            g, h, gain, feature, cut, gl, hl = found.get(s, (0.0, 0.0, 0.0, -1, 0, 0.0, 0.0))
            tree.g[node], tree.h[node] = g, h
            if feature < 0 or how.depth == 0:
                continue
            tree.feature[node], tree.cut[node], tree.gain[node] = feature, cut, gain
            for side, (a, b) in (("left", (gl, hl)), ("right", (g - gl, h - hl))):
                getattr(tree, side)[node] = len(tree.feature)
                more = depth + 1 < how.depth and b >= max(2 * how.least, how.split_least)
                for column, v in ((tree.feature, -1), (tree.cut, 0), (tree.left, 0), (tree.right, 0), (tree.depth, depth + 1), (tree.g, a), (tree.h, b),
                                  (tree.gain, 0.0), (tree.value, 0.0), (tree.slot, 0 if more else -1)):
                    column.append(v)
    for tree in trees:
        _finish(tree, how)
    return trees


def _finish(tree: _Tree, how: Growth) -> None:
    """Takes back splits that gain less than gamma, children before parents, and gives the leaves their values."""
    for node in reversed(range(len(tree.feature))):
        if tree.feature[node] >= 0 and tree.gain[node] < how.gamma and tree.feature[tree.left[node]] < 0 and tree.feature[tree.right[node]] < 0:
            tree.feature[node], tree.gain[node] = -1, 0.0
        if tree.feature[node] < 0:
            g, h = tree.g[node], tree.h[node]
            t = max(abs(g) - how.l1, 0.0)
            tree.value[node] = -np.sign(g) * t / (h + how.l2) * how.rate if h + how.l2 > 0 else 0.0


def _flat(tree: _Tree, edges: Sequence[np.ndarray], scale: float = 1.0) -> FlatTrees:
    """The nodes that are left after pruning, in order."""
    keep, stack = [], [0]
    while stack:
        node = stack.pop()
        keep.append(node)
        if tree.feature[node] >= 0:
            stack += [tree.right[node], tree.left[node]]
    place = {node: i for i, node in enumerate(keep)}
    inner = [tree.feature[n] >= 0 for n in keep]
    return FlatTrees(np.array([tree.feature[n] for n in keep], np.int32),
                     np.array([edges[tree.feature[n]][tree.cut[n]] if i else 0.0 for n, i in zip(keep, inner, strict=True)], float),
                     *(np.array([place[side[n]] if i else 0 for n, i in zip(keep, inner, strict=True)], np.int64) for side in (tree.left, tree.right)),
                     np.array([tree.value[n] * scale if not i else 0.0 for n, i in zip(keep, inner, strict=True)], float),
                     np.array([tree.gain[n] for n in keep], float), np.zeros(1, np.int64), len(edges))


def _rewritten(binned: Binned, pending: Sequence[tuple]) -> Binned:
    """The blocks with the predictions of the pending trees added; the old ones are deleted."""
    spark, width = binned.blocks.sparkSession, binned.width
    shared = spark.sparkContext.broadcast(list(pending))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = []
            for row in range(batch.num_rows):
                x, _, _, m = _read(row, batch, width)
                added.append(reduce(lambda a, t: a + t[5][_walk(x, t)], shared.value, m).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("n", "x", "y", "u")), pa.array(added, pa.binary())], ["n", "x", "y", "u", "m"])

    path = scratch_path(spark, "blocks")
    binned.blocks.mapInArrow(run, "n int, x binary, y binary, u binary, m binary").write.parquet(path)
    drop_scratch(spark, binned.path)
    return replace(binned, blocks=spark.read.parquet(path), path=path)


def boost(df: DataFrame, label: str, trees: int, how: Growth, vector: str = "features", key: Sequence[str] = (), averaged: bool = False) -> FlatTrees:
    """Gradient boosting of the squared error, from the mean label.

    An empty table, or one without labels, gives an ensemble that predicts 0.
    """
    binned = bin_rows(df, label, vector, key)
    start = _Tree(-1)
    start.value[0], start.slot[0] = binned.mean, -1
    pending, made, most = [start.arrays()], [], binned.rewrite(how.depth)
    for number in range(trees if binned.rows else 0):
        tree = _grow(binned, [number], pending, how, forest=False)[0]
        made.append(_flat(tree, binned.edges))
        whole = how.rows >= 1 and how.columns >= 1 and how.per_node is None
        if whole and tree.feature[0] < 0 and abs(tree.value[0]) < 1e-12:
            break  # nothing is left that a tree of this kind could fit
        pending.append(tree.arrays())
        if len(pending) >= most:
            binned, pending = _rewritten(binned, pending), []
    drop_scratch(df.sparkSession, binned.path)
    return joined(made, binned.width, binned.mean, averaged)


def forest(df: DataFrame, label: str, trees: int, how: Growth, vector: str = "features", key: Sequence[str] = ()) -> FlatTrees:
    """Means of trees, each grown on its own draw of the rows; several grow in the same passes."""
    binned = bin_rows(df, label, vector, key)
    how = replace(how, rate=1.0)
    together = max(1, min(trees, CELLS // max(1, min(binned.rows * (binned.width + 1), Counted.cells(binned.bins, range(binned.width), 1) << max(how.depth - 1, 0)))))
    made: list[FlatTrees] = []
    for a in range(0, trees if binned.rows else 0, together):
        grown = _grow(binned, range(a, min(a + together, trees)), [], how, forest=True)
        made += [_flat(t, binned.edges, 1.0 / trees) for t in grown]
    drop_scratch(df.sparkSession, binned.path)
    return joined(made, binned.width)


# Forests over rows that a task can hold --------------------------------------------

@dataclass
class Whole:
    """All rows that trees grow on, binned, and rows to predict."""

    x: np.ndarray
    y: np.ndarray
    u: np.ndarray
    bins: list[int]
    asked: np.ndarray
    truth: np.ndarray


def whole_tree(rows: Whole, number: int, how: Growth) -> tuple[np.ndarray, ...]:
    """(feature, cut, left, right, value) of the nodes of a forest's tree, as :func:`_grow` grows it, in the same order."""
    weight = _weights(rows.u, number, how)
    own = np.arange(len(rows.y)) if weight is None else np.flatnonzero(weight > 0)
    # Gains do not change with the labels' mean; sums of small numbers lose less.
    mean = float(rows.y.mean()) if len(rows.y) else 0.0
    x, h = np.take(rows.x, own, axis=1), np.ones(len(own)) if weight is None else weight[own]
    g, slot, columns = (mean - rows.y[own]) * h, np.zeros(len(own), np.int32), np.arange(len(rows.bins))
    nodes = [(np.array([-1]), np.array([0]), np.array([0]), np.array([0]), np.array([g.sum()]), np.array([h.sum()]))]
    active, count = np.zeros(1, np.int64), 1
    for depth in range(how.depth):
        if not len(active) or not len(slot):
            break
        feature, cut, left, right, gt, ht = (c[active - (count - len(nodes[-1][0]))] for c in nodes[-1])
        tried = np.broadcast_to(columns, (len(active), len(columns))) if how.per_node is None else _drawn(active, number, columns, how)
        feature, cut, gl, hl = _best_held(x, slot, g, h, gt, ht, gt - mean * ht, tried, rows.bins, how)
        split = feature >= 0
        left = np.where(split, count + 2 * (np.cumsum(split) - 1), 0)
        place = active - (count - len(nodes[-1][0]))
        for column, v in zip(nodes[-1], (feature, cut, left, np.where(split, left + 1, 0)), strict=False):
            column[place] = v
        made = 2 * int(split.sum())
        if not made:
            break
        cg = np.stack([gl, gt - gl], axis=1)[split].ravel()
        ch = np.stack([hl, ht - hl], axis=1)[split].ravel()
        nodes.append((np.full(made, -1), np.zeros(made, np.int64), np.zeros(made, np.int64), np.zeros(made, np.int64), cg, ch))
        more = (ch >= max(2 * how.least, how.split_least)) & (depth + 1 < how.depth)
        new = np.where(more, np.cumsum(more) - 1, -1).astype(np.int32)
        into = np.full((len(active), 2), -1, np.int32)
        into[split] = new.reshape(-1, 2)
        low = _bins_of(x, np.maximum(feature, 0), slot, np.arange(len(slot))) <= cut[slot]
        slot = np.where(low, into[slot, 0], into[slot, 1])
        active = count + np.flatnonzero(more)
        count += made
        kept = np.flatnonzero(slot >= 0)
        if len(kept) < len(slot):
            x, g, h, slot = np.take(x, kept, axis=1), g[kept], h[kept], slot[kept]
    feature, cut, left, right, gs, hs = (np.concatenate(c) for c in zip(*nodes, strict=True))
    value = np.where((feature < 0) & (hs > 0), mean - gs / np.where(hs > 0, hs, 1.0), 0.0)
    return feature, cut, left, right, value


def _bins_of(x: np.ndarray, feature: np.ndarray, slot: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bin of every row (numbered ``at``) in the feature of its slot."""
    return np.take(x.ravel(), (feature * x.shape[1])[slot] + at)


def _best_held(x: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, gt: np.ndarray, ht: np.ndarray, plain: np.ndarray, tried: np.ndarray,
               bins: Sequence[int], how: Growth) -> tuple[np.ndarray, ...]:
    """(feature, cut, GL, HL) of the best split of every slot, feature -1 without one; ``plain``: the slots' gradients without a shift.

    Rows of few slots are counted by bin, of many they are sorted.
    """
    n, every, most = len(gt), np.arange(len(gt)), max(bins, default=1)
    best, feature, cut, gl, hl = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    floor = 1e-12 * np.maximum(1.0, np.divide(plain * plain, ht, out=np.zeros(n), where=ht > 0))
    parent = np.divide(gt * gt, ht, out=np.zeros(n), where=ht > 0)

    def gains(a: np.ndarray, b: np.ndarray, slots) -> np.ndarray:
        g2, h2 = gt[slots] - a, ht[slots] - b
        able = (b >= how.least) & (h2 >= how.least) & (ht[slots] >= how.split_least)
        gain = np.divide(a * a, b, out=np.zeros_like(a), where=able) + np.divide(g2 * g2, h2, out=np.zeros_like(a), where=able) - parent[slots]
        return np.where(able & (gain > floor[slots]), gain, 0.0)

    def taken(better: np.ndarray, f, place: np.ndarray, gain: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        best[better], cut[better], gl[better], hl[better] = gain, place, a, b
        feature[better] = f

    few, at = n * most <= max(2 * len(slot), 1 << 14), np.arange(len(slot))
    for j in range(tried.shape[1]):
        f = tried[:, j]
        key = slot * (np.int32 if n * BINS < 1 << 31 else np.int64)(most if few else BINS) + _bins_of(x, f, slot, at)
        if few:
            a, b = (np.cumsum(np.bincount(key, v, n * most).reshape(n, most), axis=1) for v in (g, h))
            gain = gains(a, b, every[:, None])
            place = gain.argmax(axis=1)
            found = every, place
            more = gain[found] > best * LEAD
            taken(more, f[more], place[more], *(v[found][more] for v in (gain, a, b)))
            continue
        order = np.argsort(key)
        key = key[order]
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        a, b, of = np.cumsum(g[order])[ends], np.cumsum(h[order])[ends], (key[ends] // BINS).astype(np.int64)
        start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        before = np.repeat(start - 1, np.diff(np.append(start, len(of))))
        a, b = (v - np.where(before >= 0, v[before], 0.0) for v in (a, b))
        gain = gains(a, b, of)
        highest = np.maximum.reduceat(gain, start)
        top = np.flatnonzero(gain == np.repeat(highest, np.diff(np.append(start, len(of)))))
        top = top[np.append(True, of[top][1:] != of[top][:-1])]
        top = top[gain[top] > best[of[top]] * LEAD]
        taken(of[top], f[of[top]], key[ends][top] % BINS, gain[top], a[top], b[top])
    return feature, cut, gl, hl


def forest_errors(train: DataFrame, asked: DataFrame, label: str, points: Sequence[tuple[int, Growth]], vector: str = "features",
                  key: Sequence[str] = ()) -> list[tuple[int, float]]:
    """(rows, sum of squared errors) on ``asked`` of forests of so many trees, grown on ``train`` by tasks that hold all of its rows.

    The trees are those of :func:`forest`; none leaves its task, only sums of predictions do.
    """
    spark = train.sparkSession
    binned = bin_rows(train, label, vector, key)
    width = binned.width

    def together(blocks: DataFrame) -> tuple[np.ndarray, ...]:
        parts = [_read(i, batch, width)[:3] for batch in blocks.toArrow().to_batches() for i in range(batch.num_rows)]
        x, y, u = zip(*parts, strict=True) if parts else ([np.zeros((width, 0), np.uint8)], [np.zeros(0)], [np.zeros(0, np.uint64)])
        return np.concatenate(x, axis=1), np.concatenate(y), np.concatenate(u)

    # Rows in the order of their hashes: sums do not depend on partitions.
    (x, y, u), (ax, ay, au) = together(binned.blocks), together(_coded(_plain(asked, label, vector, key), binned.edges, width))
    by, asked_by = np.argsort(u, kind="stable"), np.argsort(au, kind="stable")
    drop_scratch(spark, binned.path)
    if not len(y) or not len(ay):
        return [(len(ay), float((ay * ay).sum()))] * len(points)
    shared = spark.sparkContext.broadcast(Whole(x[:, by], y[by], u[by], binned.bins, ax[:, asked_by], ay[asked_by]))
    units = [(p, a, min(a + TREES_A_TURN, n)) for p, (n, how) in enumerate(points) for a in range(0, n, TREES_A_TURN)]
    units.sort(key=lambda unit: -points[unit[0]][1].depth)
    tasks = min(len(units), 4 * spark.sparkContext.defaultParallelism)
    points = list(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = shared.value, {}
        for batch in batches:
            for task in batch["id"].to_pylist():
                for p, a, b in units[task::tasks]:
                    how = replace(points[p][1], rate=1.0)
                    for number in range(a, b):
                        tree = whole_tree(rows, number, how)
                        sums[p] = sums.get(p, 0.0) + tree[4][_walk(rows.asked, tree)]
        for p, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["point", "sums"])

    def error(key, part):
        p, truth = key[0].as_py(), shared.value.truth
        miss = truth - sum(np.frombuffer(v) for v in part["sums"].to_pylist()) / points[p][0]
        return pa.table({"point": pa.array([p], pa.int32()), "error": pa.array([float(miss @ miss)])})

    found = spark.range(0, tasks, 1, tasks).mapInArrow(run, "point int, sums binary").groupBy("point").applyInArrow(error, "point int, error double").collect()
    shared.destroy()
    errors = {r.point: r.error for r in found}
    return [(len(ay), errors[p]) for p in range(len(points))]
