"""Inner names of the operators as further columns of their input: they come through unchanged."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from loomstat.llm import ann, decontaminate, lm, mixing, neardup, packing, quality, repeats, tokens, toxicity, trie, warc
from loomstat.llm.shared import free_names, table

FOLDER = os.path.dirname(os.path.abspath(mixing.__file__))


def inner_names():
    """Every short name that the package's sources give to a column."""
    found = set()
    for name in [*(os.path.join(FOLDER, n) for n in os.listdir(FOLDER) if n.endswith(".py")), corpus_pipeline.__file__]:
        with open(name) as f:
            found |= set(re.findall(r'(?:alias|withColumn)\(f?"(\w+)"', f.read()))
    return sorted(found - {"doc_id", "text", "lang", "source", "n_chars"})


NAMES = inner_names()


@pytest.fixture(scope="module")
def crowded(spark):
    docs = table(spark, SMALL, "documents").where("doc_id < 60")
    return docs.withColumns({n: F.lit(f"own {n}") for n in NAMES})


def test_there_are_names():
    assert len(NAMES) > 60


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_that_bear_their_names(spark, crowded, stage):
    name, run = corpus_pipeline.STAGES[stage]
    more = crowded.withColumns({n: F.lit(f"own {n}") for n in ("_id", "_hash", "_kept", "_rows", "_score", "_toxic", "_epoch", "_tokens", "_taken", "_k_id", "domain")})
    out = run(spark, more, SMALL)
    assert out.columns == more.columns
    first = out.select("_id", "domain", "_score", "_taken", "_k_id").distinct().collect()
    assert [tuple(r) for r in first] == [tuple(f"own {n}" for n in ("_id", "domain", "_score", "_taken", "_k_id"))]
    plain = run(spark, crowded.select("doc_id", "text", "lang", "source", "n_chars"), SMALL)
    assert sorted(out.select("doc_id", "text").collect()) == sorted(plain.select("doc_id", "text").collect())


def test_operators_over_crowded_tables(spark, crowded, tmp_path):
    plain = crowded.select("doc_id", "text", "lang", "source", "n_chars")
    path = tokens_path()
    runs = {
        "quality": lambda d: quality.score(d.drop("score", "predicted"), quality.fit(d, table(spark, SMALL, "labels"))).select("doc_id", "score"),
        "toxicity": lambda d: toxicity.score(d.drop("score", "predicted"), toxicity.fit(d, table(spark, SMALL, "labels"))).select("doc_id", "score"),
        "neardup": lambda d: neardup.near_duplicates(d),
        "lm": lambda d: lm.score(d, lm.fit(d)).select("doc_id", "n_tokens", "n_known"),
        "repeats": lambda d: repeats.remove_repeats(d),
        "decontaminate": lambda d: decontaminate.find_items(d, table(spark, SMALL, "benchmark")),
        "packing": lambda d: packing.pack(d, path),
        "mixing": lambda d: mixing.mix(d, ["lang", "source"], share=0.5, names=("epoch of", "tokens of", "taken of")).select("doc_id", "epoch of", "taken of"),
    }
    for name, run in runs.items():
        assert sorted(map(str, run(crowded).collect())) == sorted(map(str, run(plain).collect())), name
    tokens.write_shards(crowded, str(tmp_path), path, 2)
    assert tokens.read_shards(spark, str(tmp_path)).count() == plain.count()
    pages = table(spark, SMALL, "pages").where("page_id < 20").withColumns({n: F.lit("own") for n in NAMES if n not in ("url", "page_id", "html")})
    warc.write_archives(pages, str(tmp_path / "w"))
    vectors = table(spark, SMALL, "embeddings").select("vec_id", "embedding").withColumns({n: F.lit("own") for n in NAMES if n not in ("vec_id", "embedding")})
    assert ann.search(vectors, F.col("vec_id") % 100 == 0).count() > 0
    turns = table(spark, SMALL, "conversations").where("conv_id < 20").withColumns({n: F.lit("own") for n in NAMES if n not in ("conv_id", "turn", "role", "text")})
    assert trie.trie(turns).count() > 0


def tokens_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, A_ int, b int")
    assert free_names(df, "a", "B", "c", "c") == ("a__", "B_", "c", "c_")


def test_item_ids_of_any_type(spark):
    from decimal import Decimal

    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    for kind, value in (("decimal(10,2)", Decimal("1.50")), ("double", 2.5), ("date", None), ("boolean", True)):
        items = spark.createDataFrame([(value, "two three four five")], f"item_id {kind}, text string")
        got = decontaminate.find_items(docs, items)
        assert got.schema["item_id"].dataType == items.schema["item_id"].dataType and [r.item_id for r in got.collect()] == [value]


def test_one_broadcast_at_a_time(spark, monkeypatch):
    """Of several passes each is run and stored, and its items let go, before the next one is broadcast."""
    alive, most = set(), []
    context = spark.sparkContext
    original = type(context).broadcast

    def counted(self, value):
        shared = original(self, value)
        if isinstance(value, decontaminate.Index):
            alive.add(id(shared))
            most.append(len(alive))
            destroy = shared.destroy
            shared.destroy = lambda *a: (alive.discard(id(shared)), destroy(*a))
        return shared

    monkeypatch.setattr(type(context), "broadcast", counted)
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} and more") for i in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(0, 30, 3)], "item_id long, text string")
    found = decontaminate.find_items(docs, items, pass_words=10)
    assert {r.doc_id for r in found.collect()} == set(range(0, 30, 3))
    assert {r.doc_id for r in decontaminate.clean(docs, items, pass_words=10).collect()} == set(range(30)) - set(range(0, 30, 3))
    assert len(most) >= 8 and max(most) <= 2
