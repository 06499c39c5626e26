"""Near-duplicates by SuperMinHash, banding, verification on full sets, and components.

1. Every text becomes its set of distinct word shingles.  Texts with equal sets are one class.
2. SuperMinHash gives each class ``bands * rows`` ranks; the ranks of one band are its key.
3. In every bucket of equal keys, each class is compared with the smallest one (full sets), and
   the links are united.
4. Where a bucket still holds classes of different components that were not compared, it is cut
   into blocks and all such classes are compared inside block pairs; a block pair passes on no
   more links than it has classes.  So nothing that shares a bucket stays unexamined.

A pair at the threshold of 0.8 shares none of 32 bands of 4 ranks with probability 5e-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .components import components
from .shared import drop_worker_cache, stored

BANDS, ROWS = 32, 4
#: Classes of a block; a block pair is compared in one task.
BLOCK = 256
#: Set elements whose permutations are held at once.
STATE = 100_000
NONE = np.uint64(T.MASK)


def shingle_sets(words: T.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document; shorter documents have one, empty ones none."""
    h, first = words.runs(size)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.array([T.runs(words.hash[words.first[d] : words.first[d + 1]], np.array([0, counts[d]]),
                                 int(counts[d]))[0][0] for d in short], dtype=np.uint64)
        h = np.insert(h, first[short], whole)
        first = first + np.searchsorted(short, np.arange(len(first)), side="left")
    return T.distinct_per_group(h, first)


def superminhash(values: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """Ranks of ``m`` components for every group of distinct hashes (Ertl 2017).

    Element e is given, in round j, the j-th place of its own random permutation and the rank
    j + r with r random in [0, 1), held as (j << 32) + r * 2**32.  A component's value is the
    smallest rank it gets, and a group stops after the round in which all its components have one:
    later ranks are larger.  Most texts stop after round 0 or 1.  Empty groups keep NONE.
    """
    n = len(first) - 1
    ranks = np.full((n, m), NONE, dtype=np.uint64)
    group = np.repeat(np.arange(n), np.diff(first))

    def draw(elements, j):
        x = T.mix(elements + np.uint64((j + 1) * 0xA0761D6478BD642F & T.MASK))
        return j + ((x >> np.uint64(32)) % np.uint64(m - j)).astype(np.int64), np.uint64(j << 32) + (x & np.uint64(0xFFFFFFFF))

    place, rank = draw(values, 0)
    np.minimum.at(ranks.reshape(-1), group * m + place, rank)
    open_groups = np.flatnonzero((ranks == NONE).any(axis=1) & (np.diff(first) > 0))
    a = 0
    while a < len(open_groups):
        sizes = np.cumsum(first[open_groups[a:] + 1] - first[open_groups[a:]])
        b = a + max(1, int(np.searchsorted(sizes, STATE, side="right")))
        own = open_groups[a:b]
        a = b
        rows = np.concatenate([np.arange(first[g], first[g + 1]) for g in own])
        e, g, k = values[rows], group[rows], place[rows]
        order = np.tile(np.arange(m, dtype=np.uint16), (len(e), 1))
        order[np.arange(len(e)), k] = 0
        order[:, 0] = k
        for j in range(1, m):
            k, rank = draw(e, j)
            at = np.arange(len(e))
            chosen = order[at, k]
            order[at, k] = order[:, j]
            np.minimum.at(ranks.reshape(-1), g * m + chosen, rank)
            active = (ranks[own] == NONE).any(axis=1)
            if not active.any():
                break
            alive = np.zeros(n, dtype=bool)
            alive[own[active]] = True
            alive = alive[g]
            if alive.sum() * 2 < len(e):
                e, g, order = e[alive], g[alive], order[alive]
    return ranks


def band_keys(ranks: np.ndarray, bands: int) -> np.ndarray:
    n = len(ranks)
    parts = ranks.reshape(n, bands, -1)
    key = np.broadcast_to(T.mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for i in range(parts.shape[2]):
        key = T.mix(key + parts[:, :, i])
    return key


def _signed(column: pa.Array, size: int, bands: int, rows: int):
    """(set key, set size, band keys) of every text of a column."""
    keys, sizes = np.zeros(len(column), np.uint64), np.zeros(len(column), np.int64)
    out = np.zeros((len(column), bands), np.uint64)
    for a, b, words in T.chunks(column, fold=True):
        values, first = shingle_sets(words, size)
        n = np.diff(first)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(T.mix(values), out=total[1:])
        keys[a:b] = T.mix(T.mix(total[first[1:]] - total[first[:-1]]) + n.astype(np.uint64))
        sizes[a:b] = n
        out[a:b] = band_keys(superminhash(values, first, bands * rows), bands)
    return keys.view(np.int64), sizes, out.view(np.int64)


def sets_of(bodies: pa.Array, size: int) -> list[np.ndarray]:
    found = []
    for _, _, words in T.chunks(bodies, fold=True):
        values, first = shingle_sets(words, size)
        found += [values[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
    return found


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def block_links(node: np.ndarray, comp: np.ndarray, bodies: pa.Array, size: int, percent: int) -> list[tuple[int, int]]:
    """Links that join different components among the given classes, a forest of them."""
    sets = sets_of(bodies, size)
    n = np.array([len(s) for s in sets], dtype=np.int64)
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    shared = np.bincount(inverse) > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    owner, column = owner[keep], column[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for low in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((len(sets), 4096), dtype=np.float32)
        part[owner[i:j], column[i:j] - low] = 1
        common += part @ part.T
    linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    root = {c: c for c in comp.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    links = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        ci, cj = find(int(comp[i])), find(int(comp[j]))
        if ci != cj:
            root[max(ci, cj)] = min(ci, cj)
            links.append((int(node[i]), int(node[j])))
    return links


def _leaders(members: DataFrame) -> DataFrame:
    return members.groupBy("band").agg(F.min(F.struct("node", "n")).alias("lead"), F.max("node").alias("last"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, hash_col: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept[, xxhash64 of the text as ``hash_col``]) for every row of ``docs``.

    Words are folded A-Z only.  Sets are compared as sets of 64-bit hashes.  A text of fewer
    words than ``size`` is one shingle; null, empty and blank texts have no shingle and are linked
    with nothing.  A row with a null id is linked with nothing either: component null, kept.
    Rows that repeat an id are rows of their own with one id: their components need not be one,
    even if both are named by that id.  Of a component that has several texts under its smallest
    id one text is kept, the one of the smallest xxhash64, in all rows that repeat it.  Other
    columns are not read.
    """
    if docs.schema[id_col].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError(f"{id_col} must be an integer column")

    def signed(batches):
        drop_worker_cache()
        for batch in batches:
            key, n, keys = _signed(batch["text"], size, bands, rows)
            flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["tie"], pa.array(key), pa.array(n), flat], ["id", "tie", "cls", "n", "bands"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("tie", F.xxhash64("text"))
    each = stored(texts.mapInArrow(signed, "id long, tie long, cls long, n long, bands array<long>"), "signed")
    some = each.where("n > 0 and id is not null")
    # Sets are the nodes: one id may be the smallest of several.
    classes = stored(some.groupBy(F.col("cls").alias("node")).agg(
        F.min(F.struct("id", "tie")).alias("low"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    spread = classes.select("node", "n", F.explode("bands").alias("band"))
    crowded = _leaders(spread).where("lead.node < last").select("band", F.col("lead.node").alias("lead"),
                                                                F.col("lead.n").alias("lead_n"))
    members = stored(spread.join(crowded, "band"), "members")

    near = members.where(f"node != lead and 100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)")
    pairs = stored(near.select(F.col("lead").alias("u"), F.col("node").alias("v")).distinct(), "pairs")
    wanted = members.select("node").distinct()
    # One text per class: that of its smallest id.
    ids = classes.join(wanted, "node", "left_semi").select("node", "low")
    rows_of = texts.join(ids, (texts.id == ids.low.id) & (texts.tie == ids.low.tie)).select("node", "text")

    def right_class(batches):
        for batch in batches:
            ok = _signed_keys(batch["text"], size) == np.asarray(batch["node"])
            yield batch.filter(pa.array(ok))

    bodies = stored(rows_of.mapInArrow(right_class, "node long, text string").dropDuplicates(["node"]), "bodies")

    def confirmed(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                yes = [alike(x, y, percent) for x, y in zip(sets_of(part["a"], size), sets_of(part["b"], size), strict=True)]
                yield part.select(["u", "v"]).filter(pa.array(yes, pa.bool_()))

    both = pairs.join(bodies.toDF("v", "b"), "v").join(bodies.toDF("u", "a"), "u").select("u", "v", "a", "b")
    links = stored(both.mapInArrow(confirmed, "u long, v long"), "links")
    roots = components(links)

    # Buckets whose classes are not all one component and were not all compared.
    root_of = roots.select("node", "root")
    placed = members.join(root_of, "node", "left").select("band", "node", "lead", F.coalesce("root", "node").alias("comp"))
    placed = placed.join(root_of.toDF("lead", "lead_root"), "lead", "left")
    placed = stored(placed.select("band", "node", "comp", (F.coalesce("lead_root", "lead") == F.col("comp")).alias("with_lead")),
                    "placed")
    sizes = placed.groupBy("band").agg(
        F.sum(F.col("with_lead").cast("long")).alias("n_with"), F.sum((~F.col("with_lead")).cast("long")).alias("n_rest"),
        F.min(F.when(~F.col("with_lead"), F.col("comp"))).alias("low"),
        F.max(F.when(~F.col("with_lead"), F.col("comp"))).alias("high"))
    unsettled = sizes.where("n_rest > 0 and (n_with > 1 or low < high)")
    unsettled = unsettled.select("band", F.ceil(F.col("n_with") / block).alias("b_with"), F.ceil(F.col("n_rest") / block).alias("b_rest"))
    work = placed.join(unsettled, "band")
    spot = F.pmod(F.xxhash64("node"), F.when(F.col("with_lead"), F.col("b_with")).otherwise(F.col("b_rest")))
    work = work.withColumn("spot", spot)
    # Block pairs: (with the leader i, rest j) and (rest i, rest j >= i).
    across = F.when(F.col("with_lead"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("b_rest") - 1),
                                                    lambda j: F.struct(F.lit("x").alias("k"), F.col("spot").alias("i"), j.alias("j"))))
    across = across.otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("b_with") - 1),
                                          lambda i: F.struct(F.lit("x").alias("k"), i.alias("i"), F.col("spot").alias("j"))))
    inner = F.when(~F.col("with_lead"), F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("b_rest") - 1),
        lambda j: F.struct(F.lit("r").alias("k"), F.least(F.col("spot"), j).alias("i"), F.greatest(F.col("spot"), j).alias("j"))))
    inner = F.coalesce(inner, F.array().cast("array<struct<k:string,i:bigint,j:bigint>>"))
    work = work.select("band", "node", "comp", F.explode(F.concat(across, inner)).alias("at"))
    work = work.join(bodies, "node").select("band", F.col("at.k").alias("k"), F.col("at.i").alias("i"),
                                            F.col("at.j").alias("j"), "node", "comp", "text")

    def compared(group: pa.Table) -> pa.Table:
        comp = group["comp"].to_numpy()
        found = []
        if len(np.unique(comp)) > 1:
            found = block_links(group["node"].to_numpy(), comp, group["text"].combine_chunks(), size, percent)
        return pa.table({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})

    more = work.groupBy("band", "k", "i", "j").applyInArrow(compared, "u long, v long")
    more = stored(more.distinct(), "links")
    if not more.isEmpty():
        onto = more.join(root_of.toDF("u", "ru"), "u", "left").join(root_of.toDF("v", "rv"), "v", "left")
        second = components(onto.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")))
        first = roots.join(second.toDF("root", "last"), "root", "left").select("node", F.coalesce("last", "root").alias("root"))
        roots = stored(first.union(second.join(roots, "node", "left_anti")), "roots")
    named = classes.select("node", "low").join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("first"))
    shown = named.join(lows, "root").select(F.col("node").alias("cls"), "first")
    own = F.struct("id", "tie") == F.col("first")
    out = some.select("id", "tie", "cls", "n").join(shown, "cls").select("id", "n", F.col("first.id").alias("component_id"), own.alias("kept"), "tie")
    alone = each.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"), F.lit(True).alias("kept"), "tie")
    also = [F.col("tie").alias(hash_col)] if hash_col else []
    return out.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept", *also)


def _signed_keys(column: pa.Array, size: int) -> np.ndarray:
    keys = np.zeros(len(column), np.uint64)
    for a, b, words in T.chunks(column, fold=True):
        values, first = shingle_sets(words, size)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(T.mix(values), out=total[1:])
        keys[a:b] = T.mix(T.mix(total[first[1:]] - total[first[:-1]]) + np.diff(first).astype(np.uint64))
    return keys.view(np.int64)


def query(spark, folder: str) -> DataFrame:
    """``op6``: four-word shingles, Jaccard of at least 0.8, every document."""
    from .shared import table

    return near_duplicates(table(spark, folder, "documents"), size=4, percent=80)
