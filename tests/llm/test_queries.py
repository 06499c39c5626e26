"""The registered queries of this package over the smallest sample tables."""

from __future__ import annotations

import os
import sys
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

import corpus_pipeline
import verify
from conftest import SMALL
from loomstat.llm.queries import QUERIES
from loomstat.llm.shared import stored


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql is not None])
def test_as_by_sql(spark, name):
    run, sql = QUERIES[name]
    assert verify.difference(verify.spark_rows(run(spark, SMALL)), verify.sql_rows(verify.connect(SMALL), sql)) is None


@pytest.mark.parametrize(("name", "modulus", "left"), [("op3_toxicity", 3, 1), ("op5_quality", 5, 0)])
def test_scores(spark, docs, name, modulus, left):
    got = QUERIES[name][0](spark, SMALL).collect()
    assert {r.doc_id for r in got} == docs.keys() and len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == left) and 0 <= r.score <= 1


def test_neighbours(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = {}
    for r in QUERIES["op4_ann"][0](spark, SMALL).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = wanted = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hits, wanted = hits + len(best & got[ids[q]]), wanted + len(best)
    assert hits >= 0.9 * wanted


def test_near_duplicates(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op6_neardup"][0](spark, SMALL).collect()}
    assert got == brute.near_duplicates(docs.items(), 4, 80)


def test_language_model(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op7_lm"][0](spark, SMALL).collect()}
    train = [t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in [*brute.words(t, True), "end"])
    n, v = sum(c.values()), len(c)
    held = [0.0, 0.0]
    for i, t in docs.items():
        w = [*brute.words(t, True), "end"]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-12)
        if r.held_out:
            held = [held[0] + r.score, held[1] + r.base_score]
    assert held[0] > held[1]  # the pair model finds held-out texts likelier than the word model does


def test_removed_passages(spark, docs):
    import hashlib

    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op10_repeats"][0](spark, SMALL).collect()}
    expected = brute.kept_words(docs.values(), 35)
    assert got == {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in zip(docs, expected, strict=True)}


def test_pipeline_stages(spark, docs):
    """Every stage works on what the one before kept; its decisions are those of its operator."""
    from test_decontaminate import distance

    from loomstat.llm import decontaminate, mixing

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = [table]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stored(stage(spark, steps[-1], SMALL)))
    kept = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in steps[:-1]]
    assert all(s.columns == table.columns for s in steps[:-1])
    near = brute.near_duplicates(kept[1].items(), 5, 80)
    assert kept[2].keys() == {i for i, (_, c) in near.items() if c == i}
    items = [brute.words(r.text, True) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    vocabulary = [set(i) for i in items]

    def leaks(text):
        w = brute.words(text, True)
        have = set(w)
        return any(len(v & have) >= 0.5 * len(v) and distance(i, w)[0] <= decontaminate.budget(len(i), 0.2)
                   for i, v in zip(items, vocabulary, strict=True) if i)

    assert kept[3].keys() == {i for i, t in kept[2].items() if not leaks(t)}
    words = lambda rows: sum(len(brute.words(t)) for t in rows.values())
    assert kept[4].keys() <= kept[3].keys()
    assert words(kept[4]) == pytest.approx(corpus_pipeline.SHARE * words(kept[3]), abs=mixing.BUCKET_DOCS)
    last = steps[-1].collect()
    assert {r.doc_id for r in last} == kept[4].keys()
    assert sorted(r.start for r in last) == np.cumsum([0, *(r.n_tokens for r in sorted(last, key=lambda r: r.start))])[:-1].tolist()


def test_nothing_else_imports_the_package():
    root = os.path.dirname(os.path.abspath(verify.__file__))
    for folder, _, names in os.walk(os.path.join(root, "loomstat")):
        for name in names:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, name)) as f:
                    assert "llm" not in f.read(), name
    assert "loomstat.llm" in sys.modules
