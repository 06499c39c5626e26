from __future__ import annotations

import pytest

from loomstat.llm import toxicity as X

P = X.PATTERNS.index


def matched(text):
    return {p: n for p, n in zip(X.PATTERNS, X.Matcher(X.Lexicon())(text), strict=True) if n}


@pytest.mark.parametrize(("text", "expected"), [
    ("what an idiot.", {"insult": 1}),
    ("you are an idiot.", {"insult": 1, "insult@": 1}),
    ("she is not an idiot.", {"insult~": 1}),
    ("no. an idiot.", {"insult": 1}),  # a clause end stops the negation
    ("not one two three four idiot.", {"insult": 1}),  # beyond the negation's reach
    ("he said idiot.", {'insult"': 1}),
    ("he said she was not an idiot.", {'insult~"': 1}),
    ("i will kill you.", {"threat@": 1}),
    ("i will kill time.", {}),
    ("never kill you.", {"threat@~": 1}),
    ("nothing here.", {}),
    ("", {}),
    (None, {}),
    ("IDIOT!!! Idiot,", {"insult": 2}),
])
def test_patterns(text, expected):
    assert matched(text) == expected


def test_composition_equals_running_one_after_the_other():
    go, out = X.machine()
    parts = [X.negation(), X.reported(), X.targeted(), X.named()]
    line = ["other", "negation", "insult", "end", "report", "threat", "target", "insult", "end", "target", "negation",
            "other", "threat", "insult"]
    state, states = 0, [p.start for p in parts]
    for symbol in line:
        code, s = X.CODE[symbol], symbol
        for i, p in enumerate(parts):
            states[i], s = p.step(states[i], s)
        assert out[state][code] == tuple(P(x) for x in s)
        state = go[state][code]


def frames(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learned_terminals_and_held_out_rows(spark):
    base = "der und die mit von auf {} ein wort das ist {}"
    rows = [(i, base.format(f"w{i}a", f"lowei{i % 17}x" if i % 5 == 0 else f"w{i % 11}b"), "x") for i in range(400)]
    docs, labels = frames(spark, rows, [(i, int(i % 5 == 0)) for i in range(200)])
    model = X.fit(docs, labels)
    assert "lowei" in {b[:5] for b in model.lexicon.beginnings} or any(b.startswith("low") for b in model.lexicon.beginnings)
    got = {r.doc_id: r for r in X.score(docs, model, keep=["doc_id"]).collect()}
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(400))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_copies_do_not_make_terminals(spark):
    rows = [(i, "common words with a sparrow inside the text", None) for i in range(60)]
    rows += [(100 + i, f"common words number {i} inside", None) for i in range(60)]
    docs, labels = frames(spark, rows, [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)])
    model = X.fit(docs, labels)
    assert model.lexicon == X.Lexicon()


def test_edges(spark):
    docs, labels = frames(spark, [(1, None, "a"), (None, "an idiot", "b"), (2, "", None), (2, "idiot " * 50_000, "c")], [])
    model = X.fit(docs, labels)
    assert model.bias == X.START_BIAS
    with pytest.raises(ValueError, match="score"):
        X.score(docs, model)
    got = X.score(docs, model, score_col="s").collect()
    assert len(got) == 4 and set(got[0].asDict()) == {"doc_id", "text", "score", "s", "predicted"}
    assert sorted(r.predicted for r in got) == [0, 0, 1, 1]
    assert len({r.s for r in got if not r.text}) == 1
    assert X.score(docs.limit(0), model, keep=["doc_id"]).count() == 0
    shown = X.score(docs.where("doc_id is null"), model, keep=["doc_id"], patterns=True).collect()
    assert shown[0].patterns == {"insult": 1}
