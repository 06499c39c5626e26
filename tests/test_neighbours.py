from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstat.operators import neighbours


def brute(queries, rows, k, p, limit=None):
    distance = neighbours.pairwise(queries, rows, p)
    out = []
    for i, d in enumerate(distance):
        near = sorted((x, j) for j, x in enumerate(d) if limit is None or x <= limit[i])[:k]
        out += [(i, j, x) for x, j in near]
    return out


def found(search, queries, limit):
    q, row, distance = search(queries, limit)
    return sorted(zip(q.tolist(), distance.tolist(), row.tolist(), strict=True))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.sampled_from([1, 2]), st.sampled_from([1, 3, 40]), st.integers(1, 12))
def test_search_is_exact(seed, p, width, k):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-3, 4, (int(rng.integers(1, 300)), width)).astype(float) * rng.choice([1, 1e-3, 1e6])
    queries = np.vstack([rows[:5], rng.normal(size=(4, width))])
    limit = np.where(rng.random(len(queries)) < 0.5, np.inf, np.abs(rng.normal(size=len(queries))) * 3)
    search = neighbours.Search(rows, k, p, neighbours.rotation(rows, p))
    assert found(search, queries, limit) == sorted((i, x, j) for i, j, x in brute(queries, rows, k, p, limit))


@pytest.mark.parametrize(("kind", "share"), [("clustered", 0.25), ("decaying", 0.2), ("structureless", 0.85)])
def test_terms_of_distances(monkeypatch, kind, share):
    """How many of all squared differences are computed: few on data with structure, most on 64 independent dimensions."""
    monkeypatch.setattr(neighbours, "RUN_ROWS", 256)
    rng = np.random.default_rng(4)
    n, width = 6000, 64
    rows = rng.normal(size=(n, width))
    if kind == "clustered":
        rows = rng.normal(size=(30, width))[rng.integers(0, 30, n)] * 10 + rows
    if kind == "decaying":
        rows = rows * 0.9 ** np.arange(width) @ np.linalg.qr(rng.normal(size=(width, width)))[0]
    queries = rows[:100]
    search = neighbours.Search(rows, 5, 2, neighbours.rotation(rows[:2000], 2))
    got = found(search, queries, np.full(100, np.inf))
    assert got == sorted((i, x, j) for i, j, x in brute(queries, rows, 5, 2))
    used = search.terms / (len(queries) * n * width)
    print(f"{kind}: {used:.3f} of all terms")
    assert used < share


def test_routing_compares_only_own_pivots(monkeypatch, spark):
    """No matrix larger than the held elements is built, whatever the number of cells."""
    monkeypatch.setattr(neighbours, "HELD", 64)
    rng = np.random.default_rng(9)
    points = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(points)], "id int, x array<double>")
    got = neighbours.nearest(df, df, 4, "id", "id", "x", cell_rows=10).collect()
    assert sorted((r.qid, r.distance, r.tid) for r in got) == sorted((i, x, j) for i, j, x in brute(points, points, 4, 2))


def test_vectors_that_take_no_part(spark):
    rows = [(0, [0.0, 0.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [3.0, 4.0]), (5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    got = {(r.qid, r.tid): r.distance for r in neighbours.nearest(df, df, 9, "id", "id", "x").collect()}
    assert got.keys() == {(a, b) for a in (0, 4, 5) for b in (0, 4, 5)} and got[0, 4] == 5
    assert neighbours.nearest(df, df.where("id in (1, 2, 3)"), 2, "id", "id", "x").count() == 0


def test_route_sends_bounded_batches(spark):
    """Visits carry vectors, so they leave a task in batches of bounded bytes, however many cells a query visits."""
    rng, width, cells = np.random.default_rng(5), 64, 100
    rows, pivots = rng.normal(size=(9000, width)), rng.normal(size=(cells, width))
    sent = []

    class Rows:
        schema, sparkSession = spark.createDataFrame([], "qid long, x array<double>, cell int, limit double").schema, spark

        def mapInPandas(self, run, schema):  # noqa: N802 - as Spark calls it
            sent.extend(run(iter([pd.DataFrame({"qid": np.arange(len(rows)), "x": list(rows), "cell": 0, "limit": np.inf})])))

    neighbours._route(Rows(), pivots, np.arange(cells), np.ones(cells), 2)
    assert sum(map(len, sent)) == len(rows) * (cells - 1)
    assert max(map(len, sent)) * width * 8 <= 4 << 20
    assert len(pd.concat(sent).drop_duplicates(["qid", "cell"])) == len(rows) * (cells - 1)


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e14, 1e16, 1e100])
def test_single_precision_loses_no_row(monkeypatch, p, scale):
    """Sums of all pairs take no matrix of doubles for every column, and are exact also where single precision ends or many rows look near."""
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(700, 24))
    rows[::7] = rows[0] * (1 + 1e-9 * rng.normal(size=(100, 1)))
    rows *= scale
    queries = np.vstack([rows[:20], rng.normal(size=(20, 24)) * scale])
    limit = np.where(np.arange(40) % 3 == 0, np.inf, 1e3 * scale)
    want = sorted((i, x, j) for i, j, x in brute(queries, rows, 4, p, limit))
    search = neighbours.Search(rows, 4, p, neighbours.rotation(rows, p))
    monkeypatch.setattr(neighbours, "pairwise", None)
    assert found(search, queries, limit) == want
