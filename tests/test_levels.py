from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from loomstat.operators import features, levels


def rows(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    words = [None if i % 17 == 0 else f"w{rng.zipf(1.3) % 400:03d}" for i in range(n)]
    return spark.createDataFrame([(i, float(i % 5), w, int(rng.integers(0, 50)), [None, float("nan"), -2.5, 10.0, 9.0][i % 5]) for i, w in enumerate(words)],
                                 "k long, x double, word string, code int, num double").repartition(4)


@pytest.mark.parametrize("broadcast", [True, False])
def test_tables_of_levels_as_lists(spark, monkeypatch, broadcast):
    monkeypatch.setattr(levels, "BROADCAST_ROWS", 100_000 if broadcast else 0)
    df = rows(spark)
    cols = ["word", "code", "num"]
    few = features.fit_preprocessor(df, ["x"], cols)
    many = features.fit_preprocessor(df, ["x"], cols, listed=2)
    assert [c[2] for c in many.categorical] == [len(c[2]) for c in few.categorical]
    assert [c[:2] for c in many.categorical] == [c[:2] for c in few.categorical] and many.width == len(few.names)
    named = [(r.position, r.name, r.base) for r in many.name_table(spark).orderBy("position").collect()]
    assert named == [(i, n, few.bases[n]) for i, n in enumerate(few.names)]
    new = rows(spark, 500, 1).union(spark.createDataFrame([(9999, 1.0, "unseen", 77, 3.0)], df.schema))
    dense = [{r.k: r.v for r in p.transform(new, ["k"]).select("k", vector_to_array("features").alias("v")).collect()} for p in (few, many)]
    assert dense[0] == dense[1] and sum(dense[1][9999][1:]) == 0
    with pytest.raises(ValueError, match="word"):
        many.names


def test_save_and_load_keep_the_tables(spark, tmp_path):
    df = rows(spark)
    fitted = features.fit_preprocessor(df, ["x"], ["word", "code"], listed=60)
    assert isinstance(fitted.categorical[0][2], int) and isinstance(fitted.categorical[1][2], tuple)
    fitted.save(spark, str(tmp_path / "p"))
    again = features.Preprocessor.load(spark, str(tmp_path / "p"))
    assert (again.numeric, again.categorical) == (fitted.numeric, fitted.categorical) and again.dictionary != fitted.dictionary
    sums = [p.transform(df, ["k"]).select("k", vector_to_array("features").alias("v")).orderBy("k").collect() for p in (fitted, again)]
    assert sums[0] == sums[1]


def test_numbers_along_an_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), F.lit(1).alias("_row_like")).repartition(7)
    got = {r.v: r["index"] for r in levels.numbered(df, ["v"]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))} and len(got) == 1000
    assert levels.numbered(df.limit(0), ["v"]).count() == 0


def test_many_levels_stay_in_tables(spark, monkeypatch):
    """300 000 levels are fitted and applied; what reaches the driver is one row a column."""
    df = spark.range(300_000).select(F.concat(F.lit("level "), F.lpad(F.col("id").cast("string"), 7, "0")).alias("c"))
    seen = []
    original = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(out := original(self)) or out)
    fitted = features.fit_preprocessor(df, [], ["c"])
    monkeypatch.undo()
    assert fitted.categorical == (("c", "level 0000000", 300_000),) and max(map(len, seen)) <= 1
    assert fitted.name_table(spark).agg(F.count_distinct("position"), F.max("position")).first()[:] == (300_000, 299_999)


def test_columns_without_levels(spark):
    df = spark.createDataFrame([(None, "a"), (None, None)], "void string, c string")
    assert features.fit_preprocessor(df, [], ["void", "c"], listed=0).categorical == (("c", "a", 1),)
    assert features.fit_preprocessor(df.limit(0), [], ["c"]).categorical == ()


def test_wide_vectors_stay_sparse(spark, monkeypatch):
    """Levels in tables are encoded without naming them on the driver, and counted without a dense vector."""
    df = spark.range(300_000).select("id", (F.col("id") % 3).cast("double").alias("x"), (F.col("id") * 2).alias("wide"), (F.col("id") % 2).alias("few"))
    fitted = features.fit_preprocessor(df, ["x"], ["wide", "few"])
    monkeypatch.setattr(features, "OneHotEncoder", None)
    monkeypatch.setattr(features, "VectorAssembler", None)
    rows = fitted.transform(df, ["id"])
    assert rows.schema["features"].metadata == {"ml_attr": {"num_attrs": 300_003}}
    met = features.met_features(rows)
    found = {r.feature: r.n for r in met.where("feature = 0 or feature > 300000").collect()}
    assert found == {0: 200_000, 300_001: 150_000, 300_002: 150_000}
    assert met.agg(F.count(F.lit(1)), F.sum("n")).first()[:] == (300_003, 800_000)
    plain = spark.createDataFrame([([0.0, 2.0],), ([1.0, 0.5],)], "v array<double>").select(array_to_vector("v").alias("features"))
    assert {r.feature: r.n for r in features.met_features(plain).collect()} == {0: 1, 1: 2}
