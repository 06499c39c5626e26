"""The prefix trie of conversations and sums over its subtrees by centroid decomposition.

A node is a distinct sequence of first turns, named by its smallest member and its depth: all
deeper nodes on that member's path which it is the smallest member of bear its name too.  Prefixes
are compared by two 64-bit hashes, the exclusive or of hashes of (depth, turn), which is a running
sum that ranges of a sorted table can form apart.

Sums over subtrees: a node weighs as many conversations as pass through it, so the weight of its
subtree follows from the same grouping that finds the nodes, and halves or better from one
component to those that its centroid leaves.  In every round the deepest node that holds at least
half of its component's weight is the component's centroid.  What lies below it in the component is added
up and goes to it and to all nodes on the path from it to the component's top; then the centroid is
taken out, its children become tops, and the path's weights shrink.  Paths are looked up by the
centroid's smallest member, so a round is a fixed number of joins, however deep the trie is, and
a component of n needs log2(n) rounds.  Components of at most ``BLOCK`` are finished inside tasks,
by the same rounds over arrays.

No conversation is collected: turns are numbered and hashes summed in ranges, what a range takes
over from those before it are a few rows per range.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS
from .shared import stored, table

#: Weight up to which a component is finished inside one task.
BLOCK = 4096
#: A conversation takes turns from the one whose id is the next multiple of this at or below it.
STRIDE = 5
NAME = ["rep", "depth"]
EMPTY = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, group: str, order: list[Column], sums: dict[str, tuple[Column, object]]) -> DataFrame:
    """Running aggregates along ``order`` within each group, itself included, and the rows' own columns.

    ``sums``: name → (values, aggregate); the aggregate must also combine its own results.  The
    rows are sorted in ranges that may cut a group; only a range's first group can go on from
    earlier ranges, so at most one row per range is broadcast.
    """
    keys = [F.col(group), *order]
    placed = rows.select("*", *(values.alias(name) for name, (values, _) in sums.items()))
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(placed.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "sorted")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part", group).agg(*(how(name).alias(name) for name, (_, how) in sums.items()))
    carried = totals.select("_part", group, F.count(F.lit(1)).over(before).alias("_earlier"),
                            *(how(name).over(before).alias(f"_{name}") for name, (_, how) in sums.items()))
    carried = F.broadcast(carried.where("_earlier > 0").drop("_earlier"))
    along = Window.partitionBy("_part", group).orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select(*rows.columns, "_part", *(how(name).over(along).alias(name) for name, (_, how) in sums.items()))
    joined = local.join(carried, ["_part", group], "left")
    both = {name: F.coalesce(_combine(how, F.col(name), F.col(f"_{name}")), F.col(name)) for name, (_, how) in sums.items()}
    return joined.select(*rows.columns, *(c.alias(name) for name, c in both.items()))


def _combine(how: object, a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b) if how is F.bit_xor else a + b


def shared_turns(conv: Column) -> Column:
    """How many first turns a rebuilt conversation takes from its base."""
    return (F.crc32(conv.cast("string").cast("binary")) % 9).cast("long")


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, len) of every conversation, and (c, depth, u1, u2, bytes) of its rebuilt turns, from depth 1.

    Turns are ordered by ``turn``, nulls first, ties by role and text.  Null roles and texts become empty;
    rows without a conv_id belong to no conversation.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", *text)
    turns = running(turns, "conv", [F.col("turn"), F.col("role"), F.col("text")], {"place": (F.lit(1).cast("long"), F.sum)})
    turns = stored(turns.select("conv", (F.col("place") - 1).alias("i"), F.xxhash64("role", "text").alias("u1"),
                                F.xxhash64(F.lit("turn"), "text", "role").alias("u2"), F.octet_length("text").cast("long").alias("bytes")), "turns")
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    convs = sizes.select(F.col("conv").alias("c"), "own", shared_turns(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % STRIDE).alias("base"))
    convs = convs.join(sizes.toDF("base", "base_own"), "base", "left")
    convs = stored(convs.select("c", "h", F.least("h", F.coalesce("base_own", F.lit(0))).alias("lead"), "own"), "conversations")
    head = turns.where((F.col("conv") % STRIDE == 0) & (F.col("i") < 8))
    away = F.explode(F.sequence(F.lit(1 - STRIDE), F.lit(STRIDE - 1)))
    taken = head.select("*", away.alias("away")).withColumn("c", F.expr("try_add(conv, cast(away as bigint))"))
    taken = taken.where((F.col("c") - F.col("c") % STRIDE == F.col("conv")) & (F.col("i") < shared_turns(F.col("c"))))
    taken = taken.join(convs.select("c"), "c", "left_semi").select("c", (F.col("i") + 1).alias("depth"), "u1", "u2", "bytes")
    kept = turns.withColumnRenamed("conv", "c").where(F.col("i") >= shared_turns(F.col("c"))).join(convs.select("c", "h", "lead"), "c")
    kept = kept.select("c", (F.col("i") - F.col("h") + F.col("lead") + 1).alias("depth"), "u1", "u2", "bytes")
    rest = F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return convs.select("c", (F.col("lead") + rest).alias("len")), taken.unionByName(kept)


def build(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and paths of the trie.

    Nodes: (rep, depth, parent, n_convs, n_children, bytes, weight).  Paths: (c, depth, rep, next, len) - the
    names of the node at every depth of every conversation, from 0, and of the node after it.
    """
    convs, turns = rebuild(conversations)
    convs = stored(convs, "lengths")
    own = {f"t{k}": F.xxhash64("depth", f"u{k}") for k in (1, 2)}
    turns = turns.select("c", "depth", "bytes", *(v.alias(k) for k, v in own.items()))
    turns = running(turns, "c", [F.col("depth")], {f"x{k}": (F.col(f"t{k}"), F.bit_xor) for k in (1, 2)})
    turns = turns.join(convs, "c").select("c", "depth", "bytes", "x1", "x2", "len", *(F.col(f"x{k}").bitwiseXOR(F.col(f"t{k}")).alias(f"p{k}") for k in (1, 2)))
    turns = stored(turns, "prefixes")
    found = stored(turns.groupBy("depth", "x1", "x2").agg(
        F.min("c").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("len") - F.col("depth") + 1).alias("weight"),
        *(F.max(k).alias(k) for k in ("bytes", "p1", "p2"))), "found")
    root = convs.agg(F.min("c").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("len") + 1).alias("weight")).where("n_convs > 0")
    root = stored(root.select("rep", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("bytes"), "weight"), "root")
    top = F.broadcast(root.select(F.col("rep").alias("parent")))
    columns = ["rep", "depth", "parent", "n_convs", "bytes", "weight"]
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("rep").alias("parent"))
    deep = found.where("depth > 1").join(above, ["depth", "p1", "p2"]).select(columns)
    nodes = stored(root.union(found.where("depth = 1").crossJoin(top).select(columns)).union(deep), "named")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, NAME, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    path = turns.select("c", "depth", "x1", "x2", "len").join(found.select("depth", "x1", "x2", "rep"), ["depth", "x1", "x2"]).select("c", "depth", "rep", "len")
    start = convs.crossJoin(F.broadcast(root.select("rep"))).select("c", F.lit(0).cast("long").alias("depth"), "rep", "len")
    path = stored(path.union(start), "paths")
    after = path.select("c", (F.col("depth") - 1).alias("depth"), F.col("rep").alias("next"))
    return stored(nodes, "nodes"), stored(path.join(after, ["c", "depth"], "left"), "paths-on")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: list[str], block: int = BLOCK) -> DataFrame:
    """``nodes`` with every column of ``values`` replaced by its sum over the node's subtree.

    ``nodes`` needs rep, depth, parent and weight besides, ``paths`` c, depth, rep and next.
    """
    out = nodes.columns
    top = ["top_rep", "top_depth"]
    live = nodes.select("*", *(F.lit(0).cast("long").alias(f"sum_{v}") for v in values))
    if (least := nodes.where("depth = 0").select("rep").first()) is None:
        return nodes
    live = stored(live.withColumn("top_rep", F.lit(least.rep)).withColumn("top_depth", F.lit(0).cast("long")), "live")
    done, settled = [], []
    while True:
        large = live.groupBy(*top).agg(F.max("weight").alias("total")).where(F.col("total") > block)
        large = stored(large, "large")
        n = large.count()
        if not n:
            settled.append(live)
            break
        settled.append(stored(live.join(_small(large, n), top, "left_anti"), "settled"))
        big = live.join(_small(large, n), top)
        deepest = F.max_by(F.struct("rep", "depth", "weight"), "depth").alias("g")
        centre = big.where(F.col("weight") * 2 >= F.col("total")).groupBy(*top).agg(deepest)
        centre = stored(centre.select(*top, F.col("g.rep").alias("g_rep"), F.col("g.depth").alias("g_depth"), F.col("g.weight").alias("g_weight")), "centres")
        # A node is below the centroid if its smallest member's path goes through it.
        at = paths.select(F.col("c").alias("rep"), F.col("depth").alias("g_at"), F.col("rep").alias("through"), "next")
        known = big.join(_small(centre, n), top).withColumn("g_at", F.expr("case when depth >= g_depth then g_depth end")).join(at, ["rep", "g_at"], "left")
        known = known.withColumn("below", F.coalesce(F.col("through") == F.col("g_rep"), F.lit(False)))
        known = stored(known.drop("g_at", "through", "total"), "known")
        below = known.where("below").groupBy(*top).agg(*(F.sum(v).alias(f"add_{v}") for v in values))
        below = stored(centre.join(below, top), "totals")
        # From the centroid's parent up to the top.
        up = paths.join(_small(below, n).withColumnRenamed("g_rep", "c"), "c").where("depth >= top_depth and depth < g_depth")
        up = up.select("rep", "depth", F.col("g_weight").alias("less"), *(f"add_{v}" for v in values))
        kept = known.where("not (rep = g_rep and depth = g_depth)").join(up, NAME, "left")
        more = [(F.col(f"sum_{v}") + F.coalesce(f"add_{v}", F.lit(0))).alias(f"sum_{v}") for v in values]
        weight = (F.col("weight") - F.coalesce("less", F.lit(0))).alias("weight")
        into = [F.when(F.col("below"), F.col("next")).otherwise(F.col("top_rep")).alias("top_rep"),
                F.when(F.col("below"), F.col("g_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth")]
        own = known.where("rep = g_rep and depth = g_depth").join(_small(below.select(*top, *(f"add_{v}" for v in values)), n), top)
        done.append(stored(own.select(*(c for c in out if c not in values), *((F.col(f"sum_{v}") + F.col(f"add_{v}")).alias(v) for v in values)), "done"))
        live = stored(kept.select(*(c for c in out if c != "weight"), weight, *more, *into), "live")
    rest = settled[0]
    for part in settled[1:]:
        rest = rest.unionByName(part)
    rest = stored(rest, "settled")
    buckets = rest.count() // block + 1
    local = _in_tasks(rest.withColumn("bucket", F.pmod(F.xxhash64(*top), F.lit(buckets))), values)
    local = local.select(*(c for c in out if c not in values), *(F.col(f"sum_{v}").alias(v) for v in values))
    for part in done:
        local = local.unionByName(part)
    return local.select(out)


def _in_tasks(rest: DataFrame, values: list[str]) -> DataFrame:
    sums = [f"sum_{v}" for v in values]

    def finish(part: pa.Table) -> pa.Table:
        rep, depth, parent, weight = (part[c].to_numpy() for c in ("rep", "depth", "parent", "weight"))
        # Names of parents are looked up among the bucket's nodes; a component's top has none there.
        ids = {name: i for i, name in enumerate(zip(rep.tolist(), depth.tolist(), strict=True))}
        inside = (part["top_rep"].to_numpy() != rep) | (part["top_depth"].to_numpy() != depth)
        up = np.array([ids[p, d - 1] if x else -1 for p, d, x in zip(parent.tolist(), depth.tolist(), inside.tolist(), strict=True)], dtype=np.int64)
        got = centroid_sums(up, depth, weight, np.stack([part[v].to_numpy() for v in values]))
        for name, more in zip(sums, got, strict=True):
            at = part.column_names.index(name)
            part = part.set_column(at, name, pa.array(part[name].to_numpy() + more))
        return part

    return rest.groupBy("bucket").applyInArrow(finish, rest.schema)


def _tops(up: np.ndarray) -> np.ndarray:
    """The top of every node's component, by doubling steps."""
    top = np.where(up >= 0, up, np.arange(len(up)))
    while not np.array_equal(further := top[top], top):
        top = further
    return top


def centroid_sums(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of every row of ``values`` over the subtrees of a forest; ``parent`` is -1 for tops.

    ``weight``: of subtrees, larger than the weights of all children together.
    """
    n = len(parent)
    up, weight, out = parent.copy(), weight.astype(np.int64).copy(), np.zeros_like(values)
    alive, top = np.arange(n), _tops(up)
    while len(alive):
        heavy = alive[2 * weight[alive] >= weight[top[alive]]]
        heavy = heavy[np.lexsort((depth[heavy], top[heavy]))]
        last = np.append(top[heavy][1:] != top[heavy][:-1], True)
        centre = heavy[last]
        mark = np.full(n, -1)
        mark[centre] = np.arange(len(centre))
        above = up[centre]
        under = (up >= 0) & (mark[np.maximum(up, 0)] >= 0)  # children of centroids become tops
        owner = np.where(mark >= 0, mark, np.where(under, mark[np.maximum(up, 0)], -1))
        up[under] = -1
        up[centre] = -1
        top = _tops(up)
        belongs = owner[top[alive]]
        add = np.zeros((len(values), len(centre)), dtype=values.dtype)
        for total, v in zip(add, values, strict=True):
            np.add.at(total, belongs[belongs >= 0], v[alive][belongs >= 0])
        out[:, centre] += add
        at, less = above, weight[centre]
        while (on := at >= 0).any():
            at, add, less = at[on], add[:, on], less[on]
            out[:, at] += add
            weight[at] -= less
            at = up[at]
        alive = alive[mark[alive] < 0]
    return out


def digests(ends: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256) of (rep, depth, c): the digest of a node's ids in ascending order, joined by commas.

    Tasks that hold ranges of the sorted ids join them piece by piece; the pieces of a node are
    digested one after the other, so that nothing but a digest's state is kept.
    """
    keys = [*NAME, "c"]
    ordered = ends.select(keys).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def join(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, depth, c = (batch[k].to_numpy() for k in keys)
            first = np.flatnonzero(np.concatenate(([True], (rep[1:] != rep[:-1]) | (depth[1:] != depth[:-1]))))
            names, limits = list(map(str, c.tolist())), [*first.tolist(), len(c)]
            pieces = [",".join(names[a:b]) for a, b in zip(limits[:-1], limits[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rep[first]), pa.array(depth[first]), pa.array(c[first]), pa.array(pieces, pa.string())], [*keys, "piece"])

    pieces = ordered.mapInArrow(join, "rep long, depth long, c long, piece string")
    pieces = pieces.repartition(*NAME).sortWithinPartitions(*keys)

    def digest(batches):
        name, state = None, None
        for batch in batches:
            found: list[tuple[int, int, str]] = []
            for rep, depth, piece in zip(*(batch[k].to_pylist() for k in (*NAME, "piece")), strict=True):
                if (rep, depth) == name:
                    state.update(b"," + piece.encode())
                    continue
                if name is not None:
                    found.append((*name, state.hexdigest()))
                name, state = (rep, depth), hashlib.sha256(piece.encode())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], [*NAME, "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*name, state.hexdigest())], [*NAME, "ends_sha256"])

    return pieces.mapInArrow(digest, "rep long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    Ids are whole numbers; ``conv_id % 5`` keeps the sign of the id.  A conversation may be
    rebuilt without turns: then it ends at the root.  Repeated rows are turns of their own.  An
    empty table, or one without ids, has no members and no nodes.  Other columns are not read.
    """
    nodes, paths = build(conversations)
    nodes = nodes.select(*NAME, "parent", "n_convs", "n_children", "weight", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                         ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    summed = subtree_sums(nodes, paths, ["n_leaves", "saved_tokens"], block)
    ended = digests(paths.where("depth = len").select("rep", "depth", "c"))
    return summed.join(ended, NAME, "left").select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """``op13``: the trie of the rebuilt conversations."""
    return trie(table(spark, folder, "conversations"))


#: CRC-32 of an id's digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda z, w: xor(z >> 1, 3988292384 * (z & 1)))))"""

#: The same by lists of turns as keys: every node joined to all nodes on its path.
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, r, x) AS turns FROM t GROUP BY c),
h AS (SELECT c, turns, {_CRC} % 9 AS h, c - c % 5 AS base FROM o),
p AS (SELECT h.c, list_concat(coalesce(b.turns[1:h], []::STRUCT(r VARCHAR, x VARCHAR)[]), h.turns[h + 1:]) AS path FROM h LEFT JOIN o b ON b.c = h.base),
k AS (SELECT c, d AS depth, path[1:d] AS node, len(path) = d AS at_end FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM p)),
n AS (SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (at_end), '') AS ids
      FROM k GROUP BY node, depth),
b AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(b.n_children, 0) AS n_children FROM n LEFT JOIN b USING (node)),
s AS (SELECT node[1:d] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves,
             sum(CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(node[depth].x) ELSE 0 END) AS saved
      FROM (SELECT *, unnest(range(depth + 1)) AS d FROM v) GROUP BY 1)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(v.ids) AS ends_sha256
FROM v JOIN s USING (node) LEFT JOIN n u ON v.depth > 0 AND u.node = v.node[1:v.depth - 1]"""
