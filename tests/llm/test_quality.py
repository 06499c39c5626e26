from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from loomstat.llm import quality as Q


def corpus(n=400):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 60))]
        bad = i % 4 == 0
        if bad:
            words = [w + rng.choice(["$$$", "%%%", " |"]) for w in words] if i % 8 else [w for w in words for _ in range(9)]
        rows.append((i, " ".join(words), int(not bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, predicted double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 300], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    with pytest.raises(ValueError, match="predicted"):
        Q.score(docs, model)
    got = {r.doc_id: r for r in Q.score(docs, model, keep=["doc_id"]).collect()}
    assert len(got) == 400 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[i].score >= 0.5) == bool(y) for i, _, y in rows if i >= 300]
    assert np.mean(held) >= 0.95


def test_same_result_again_and_softmax_of_the_mean(spark):
    rows = corpus(80)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = Q.fit(docs, labels, epochs=2)
    again = Q.fit(docs.repartition(5), labels, epochs=2)
    assert (model.vectors == again.vectors).all()
    column = pa.array([rows[1][1]])
    (_, _, words, offsets), = Q._chunks(column)
    slots = np.concatenate([p[0] for p in Q.feature_parts(words, offsets)])
    z = model.layer.astype(float) @ model.vectors[slots].astype(float).mean(0) + model.bias
    expected = np.exp(z[1]) / np.exp(z).sum()
    got = Q.score(docs.where("doc_id = 1"), model).first().score
    assert got == pytest.approx(expected, abs=1e-5)


def test_features_of_a_word():
    (_, _, words, offsets), = Q._chunks(pa.array(["ab ab", "x"]))
    parts = list(Q.feature_parts(words, offsets))
    assert [len(p[0]) for p in parts[:2]] == [3, 1]  # words, pairs
    assert [p[1].tolist() for p in parts[2:]] == [[0, 0], [], []]  # "ab " and " ab"; nothing longer inside one word's edges


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "word"), (3, "w" * 100_000)], "doc_id long, text string")
    model = Q.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = Q.score(docs, model).collect()
    assert len(got) == 4 and len({r.score for r in got if not r.text}) == 1
    assert Q.score(docs.limit(0), model).count() == 0
