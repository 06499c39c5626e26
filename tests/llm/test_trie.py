from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstat.llm import trie as X
from loomstat.llm.queries import QUERIES

FIELDS = "conv_id long, turn long, role string, text string"


def truncated(c):
    return c - int(np.fmod(c, 5))


def brute(rows):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, ends)} by walking a dictionary of prefixes."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        path = (*turns.get(truncated(c), [])[:h], *turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, sums = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below = children[node]
        sums[node] = (sum(sums[n][0] for n in below) if below else 1, own + sum(sums[n][1] for n in below))
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out[min(members[node]), len(node)] = (min(members[node[:-1]]) if node else None, len(members[node]), len(below), *sums[node], digest)
    return out


def rows_of(df):
    got = {(r.conv_id, r.depth): tuple(r)[2:] for r in df.collect()}
    return got


def made(seed, convs, words, longest):
    """Conversations over few distinct turns, so that prefixes are shared; rows in any order."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(3 * convs), convs):
        for t in range(r.randint(1, longest)):
            rows.append((c, t, r.choice(["user", "assistant"][: 1 + t % 2]), "ab" * r.randrange(words) + "é" * (t % 3)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "convs", "words", "longest", "block"), [(1, 60, 2, 12, 1), (2, 150, 3, 6, 40), (3, 40, 1, 9, X.BLOCK)])
def test_shared_prefixes(spark, seed, convs, words, longest, block):
    rows = made(seed, convs, words, longest)
    docs = spark.createDataFrame(rows, FIELDS).repartition(3)
    assert rows_of(X.trie(docs, block)) == brute(rows)


@pytest.mark.parametrize("block", [8, 100])
def test_one_long_conversation_and_many_copies(spark, block):
    """One id holds a third of all rows, and one conversation a third of all ids."""
    rows = [(10, t, "user", f"turn {t % 7}") for t in range(300)]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(5)]
    rows += made(5, 60, 2, 10)
    rows = [r for r in rows if r[0] != 10 or r[3].startswith("turn")]
    docs = spark.createDataFrame(rows, FIELDS).repartition(4)
    assert rows_of(X.trie(docs, block)) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "no id"), (None, None, None, None), (1, None, "user", "first"), (1, 0, None, None), (1, 1, "user", ""),
            (0, 5, "user", "a"), (0, 5, "user", "a"), (0, 5, "assistant", "b"), (-3, 0, "user", "a"), (-5, 0, "user", "a"), (-5, 1, None, "x" * 100_000),
            (2**63 - 1, 0, "user", "a"), (-(2**63), 0, "user", "a"), (7, 0, "user", "a"), (4, 2, "user", "own"), (3, 0, "ab", "c"), (2, 0, "a", "bc")]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], FIELDS + ", rep int, depth string, i int").repartition(3)
    assert rows_of(X.trie(docs, 4)) == brute(rows)
    none = X.trie(docs.limit(0))
    assert none.count() == 0 and X.trie(docs.where("conv_id is null")).count() == 0
    assert none.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-1, 60), min_size=1, max_size=60), st.integers(0, 1 << 30))
def test_forests_in_arrays(links, seed):
    """Any forest: parents come before children; sums over subtrees as by adding upwards."""
    n = len(links)
    parent = np.array([-1 if p < 0 or i == 0 else p % i for i, p in enumerate(links)])
    depth, own = np.zeros(n, np.int64), np.random.default_rng(seed).integers(1, 9, (3, n))
    for i in range(n):
        depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 0
    total = own.copy()
    for i in range(n - 1, 0, -1):
        if parent[i] >= 0:
            total[:, parent[i]] += total[:, i]
    order = np.random.default_rng(seed).permutation(n)
    place = np.argsort(order)
    moved = np.where(parent[order] >= 0, place[np.maximum(parent[order], 0)], -1)
    got = X.centroid_sums(moved, depth[order], total[0][order], own[1:, order])
    assert (got == total[1:, order]).all()


def test_running_sums_across_ranges(spark):
    from pyspark.sql import functions as F

    rows = [(i % 3 if i % 2 else 1, i) for i in range(500)]
    got = X.running(spark.createDataFrame(rows, "g long, v long").repartition(7), "g", [F.col("v")], {"s": (F.col("v"), F.sum), "x": (F.col("v"), F.bit_xor)})
    seen = defaultdict(lambda: (0, 0))
    want = set()
    for g, v in sorted(rows):
        seen[g] = (seen[g][0] + v, seen[g][1] ^ v)
        want.add((g, v, *seen[g]))
    assert {tuple(r) for r in got.collect()} == want


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op13_trie"][0](spark, SMALL)) == brute(rows)
