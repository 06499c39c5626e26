from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomstat.operators import combine
from loomstat.sources.topics import TopicStore


def topics(spark, n=7):
    """Tables over overlapping keys; one row of some has no key."""
    out = {}
    for i in range(n):
        rows = [(k, float(k * 10 + i)) for k in range(i, 60 + i, i % 3 + 1)] + [(None, -1.0 * i)] * (i % 2)
        out[f"topic {i}"] = spark.createDataFrame(rows, f"seqn long, v{i} double")
    return out


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def plain_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_seven_tables_are_combined_without_an_exchange(spark, tmp_path, plain_joins):
    store = TopicStore(spark, str(tmp_path / "store"), "seqn", 4)
    parts = {n: t.where("seqn is not null") for n, t in topics(spark).items()}
    for name, t in parts.items():
        assert store.write(name, t) | {"version": 0} == store.about(name) | {"version": 0}
    first = rows(store.combine(parts))
    whole = store.combine(parts)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") >= 8
    assert rows(whole) == first == rows(combine.combine_on_key(list(parts.values()), "seqn"))


def test_missing_keys_match_each_other(spark, tmp_path):
    store = TopicStore(spark, str(tmp_path / "store"), "seqn", 3)
    parts = topics(spark)
    for name, t in parts.items():
        store.write(name, t)
    assert [store.about(n)["missing"] for n in parts] == [i % 2 == 1 for i in range(7)]
    assert rows(store.combine(parts)) == rows(combine.combine_on_key(list(parts.values()), "seqn"))


def test_repeated_keys_and_rewritten_tables(spark, tmp_path):
    store = TopicStore(spark, str(tmp_path / "store"), "k", 3)
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, a string")
    b = spark.createDataFrame([(1, 0.5), (3, 1.5)], "k int, b double")
    c = spark.createDataFrame([(3, True)], "k int, c boolean")
    for name, t in (("a", a), ("b", b), ("c", c)):
        store.write(name, t)
    assert store.about("a")["largest"] == 2
    assert rows(store.combine(["a", "b", "c"])) == rows(combine.combine_on_key([a, b, c], "k"))
    store.write("a", a.where("a != 'y'"))
    again = TopicStore(spark, store.path, "k", 3)  # as another session would
    assert rows(again.combine(["a", "b", "c"])) == rows(combine.combine_on_key([a.where("a != 'y'"), b, c], "k"))
    assert rows(again.combine(["b"])) == rows(b)


def test_odd_stores(spark, tmp_path):
    store = TopicStore(spark, str(tmp_path / "store"), "k", 2)
    empty = spark.createDataFrame([], "k int, a string")
    store.write("empty", empty)
    store.write("some", spark.createDataFrame([(1, 2)], "k int, b int"))
    store.write("same", spark.createDataFrame([(1, "q")], "k int, a string"))
    assert store.about("empty")["largest"] == 0
    assert rows(store.combine(["empty", "some"])) == ["Row(a=None, b=2, k=1)"]
    with pytest.raises(ValueError, match="more than one table"):
        store.combine(["empty", "same"])
    with pytest.raises(ValueError, match="buckets"):
        TopicStore(spark, store.path, "k", 5).read("some")
    assert store.read("some").agg(F.sum("b")).first()[0] == 2
