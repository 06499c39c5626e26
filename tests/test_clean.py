from __future__ import annotations

import math
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.fixed import SENTINEL_CODES
from loomstat.operators import clean, combine, quantiles
from loomstat.sources import tables
from loomstat.spec import classify, load_spec, numeric_columns, parse_spec

ENTRY = {"name": "a", "source": "A", "file": "T_I", "type": "numeric", "role": "target"}


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_trim_keeps_inclusive_bounds_and_drops_missing(spark):
    df = column(spark, [float(i) for i in range(1, 101)] + [None, float("nan")])
    kept = clean.fit_trim(df, ["x"]).apply(clean.nan_to_null(df))
    expected = [v for v in range(1, 101) if np.quantile(np.arange(1, 101), .05) <= v <= np.quantile(np.arange(1, 101), .95)]
    assert sorted(r.x for r in kept.collect()) == expected


@pytest.mark.parametrize("values,left", [([5.0] * 4, 4), ([3.0], 1), ([None, None], 0)])
def test_trim_of_degenerate_columns(spark, values, left):
    df = column(spark, values)
    assert clean.fit_trim(df, ["x"]).apply(df).count() == left


def test_trim_is_sequential(spark):
    rows = [(float(i), float(100 - i)) for i in range(101)]
    df = spark.createDataFrame(rows, "a double, b double")
    bounds = clean.fit_trim(df, ["a", "b"])
    a = np.array([r[0] for r in rows])
    lo, hi = np.quantile(a, [.05, .95])
    survivors = np.array([r[1] for r in rows if lo <= r[0] <= hi])
    assert bounds.limits[1][1:] == pytest.approx(tuple(np.quantile(survivors, [.05, .95])))


def test_sentinels_apply_per_column(spark):
    df = spark.createDataFrame([(7.0, 7.0), (9.0, 1.0), (None, 77.0)], "sex double, other double")
    out = clean.recode_sentinels(df, SENTINEL_CODES).collect()
    assert [(r.sex, r.other) for r in out] == [(None, 7.0), (None, 1.0), (None, 77.0)]


def test_sentinel_rows_are_counted_for_the_first_rule(spark):
    df = spark.createDataFrame([(7, 9), (7, 1), (1, 9), (None, 1), (1, 1)], "a int, b int")
    kept, removed = clean.drop_sentinel_rows(df, {"a": [7], "b": [9]})
    assert {r.rule: r.removed for r in removed.collect()} == {"a": 2, "b": 1}
    assert kept.count() == 2


def test_extreme_rows_keep_missing(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 6), (2, 7), (2, 6)], "a int, b int")
    assert sorted(map(tuple, clean.drop_extreme_rows(df, ["a", "b"]).collect()), key=str) == [(2, 6), (2, None)]


def test_maps_and_levels(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (None, None)], "c double, l string")
    mapped = clean.map_values(df, {"c": {1.0: "one"}})
    assert [r.c for r in mapped.collect()] == ["one", None, None]
    ordered = clean.order_levels(df, "l", ["y", "z"])
    assert [(r.l, r.l_rank) for r in ordered.collect()] == [(None, None), ("y", 1), (None, None)]


def test_sparse_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, 3)], "a int, b int, c int")
    kept, dropped = clean.drop_sparse_columns(df)
    assert (kept.columns, dropped) == (["a", "c"], ["b"])


def test_require(spark):
    df = column(spark, [1.0, None])
    with pytest.raises(ValueError, match="1 rows"):
        clean.require(df, {"positive": F.col("x") > 0})


@pytest.mark.parametrize("how", [{"direct_rows": 0, "bracket_rows": 10**9}, {"direct_rows": 0, "bracket_rows": 0}, {}])
def test_quantiles_agree_with_numpy(spark, how):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(400)] + [0.25] * 300 + [1e300, -1e300]
    rows = [("a" if i % 3 else "b", v) for i, v in enumerate(values)] + [("c", None), ("c", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {(r.g, r.prob): r.value for r in quantiles.quantiles(df, ["x"], probs, ["g"], intervals=16, **how).collect()}
    for g in "abc":
        mine = [v for k, v in rows if k == g and v is not None]
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(mine, p), rel=1e-12)
    whole = quantiles.quantile_values(df, ["x"], probs, **how)["x"]
    assert whole == pytest.approx([np.quantile([v for _, v in rows if v is not None], p) for p in probs])


def test_large_columns_take_counts_or_brackets(spark):
    rng = random.Random(7)
    rows = [(float(rng.randint(0, 9)), rng.random(), None) for _ in range(3000)]
    df = spark.createDataFrame(rows, "few double, many double, none double")
    probs = [0.0, 0.05, 0.333, 0.5, 1.0]
    got = quantiles.quantile_values(df, ["few", "many", "none"], probs, direct_rows=100)
    assert got["few"] == pytest.approx(list(np.quantile([r[0] for r in rows], probs)))
    assert got["many"] == pytest.approx(list(np.quantile([r[1] for r in rows], probs)), rel=1e-14)
    assert got["none"] == [None] * 5


def test_quantiles_of_missing_column(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    for direct in (0, 10):
        assert quantiles.quantile_values(df, ["x", "y"], [.5], direct) == {"x": [None], "y": [1.0]}


def keyed(spark, rows, name):
    return spark.createDataFrame(rows, f"k int, {name} int")


def test_join_strategies_agree_on_unique_keys(spark):
    parts = [keyed(spark, [(1, 10), (2, 20), (None, 5)], "a"), keyed(spark, [(2, 7), (3, 8), (None, 6)], "b"),
             keyed(spark, [(4, 1)], "c")]
    results = {s: sorted(map(tuple, combine.combine_on_key(parts, "k", s).select("k", "a", "b", "c").collect()), key=str)
               for s in ("unique", "join", "hot", "auto")}
    assert len({str(v) for v in results.values()}) == 1
    assert (None, 5, 6, None) in results["auto"]
    assert len(results["auto"]) == 5


def test_join_multiplies_repeated_keys(spark):
    left = keyed(spark, [(1, 1), (1, 2), (2, 3), (None, 4)], "a")
    right = keyed(spark, [(1, 5), (1, 6), (3, 7)], "b")
    results = [sorted(map(tuple, combine.combine_on_key([left, right], "k", s).select("k", "a", "b").collect()), key=str)
               for s in ("join", "hot", "auto")]
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == 7
    with pytest.raises(ValueError, match="more than one"):
        combine.combine_on_key([left, left], "k")


def test_auto_joins_repeated_keys_to_the_merged_rest(spark):
    parts = [keyed(spark, [(1, 10), (2, 20)], "a"), keyed(spark, [(2, 7), (2, 8), (5, 9)], "b"), keyed(spark, [(1, 3), (None, 4)], "c")]
    results = [sorted(map(tuple, combine.combine_on_key(parts, "k", s).collect()), key=str) for s in ("join", "auto", "hot")]
    assert results[0] == results[1] == results[2]
    assert combine.combine_on_key(parts, "k").columns == ["k", "a", "b", "c"]


def test_infinite_values_end_the_narrowing(spark):
    inf = float("inf")
    values = spark.createDataFrame([(0, x) for x in (1.0, 2.0, 3.0, inf, -inf)], "g int, x double")
    wanted = spark.createDataFrame([(0, r) for r in range(5)], "g int, rank long")
    got = quantiles.order_statistics(values, ["g"], wanted, 2)
    assert {r["rank"]: r.x for r in got.collect()} == {0: -inf, 1: 1.0, 2: 2.0, 3: 3.0, 4: inf}


def test_reshaping(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0)], "Model string, `R2 - t` double, `RMSE - t` double")
    assert combine.columns_like(df, "R2", ["Model"]).columns == ["Model", "R2 - t"]
    long = combine.melt(df, ["Model"], df.columns[1:])
    assert combine.spread(long, ["Model"], "variable", "value", df.columns[1:]).collect() == df.collect()
    tagged = combine.concat_rows([df, df], "stage", ["a", "b"])
    assert [r.stage for r in combine.distinct_values([tagged], "stage").collect()] == ["a", "b"]
    assert combine.difference(tagged.select("stage"), tagged.filter("stage = 'a'").select("stage")).count() == 1


def test_spec_rules(tmp_path):
    path = tmp_path / "spec.yaml"
    path.write_text("features:\n  - {name: a, source: A, file: T_I, type: numerical, role: target, log_transform: true}\n"
                    "  - {name: b, source: B, file: S_I, type: categorical, role: feature, unit: cm}\n")
    spec = load_spec(str(path))
    assert (spec.targets, spec.log_targets, spec.categorical, spec.files) == (["a"], ["a"], ["b"], ["S_I", "T_I"])
    assert tables.topic_paths(spec, "/d", "H") == {"S_I": "/d/S_H.xpt.txt", "T_I": "/d/T_H.xpt.txt"}
    with pytest.warns(UserWarning, match="drop_extreme"):
        parse_spec([{**ENTRY, "drop_extreme": True}])
    for broken in ([{**ENTRY, "drop_extreme": True}], [ENTRY, ENTRY], [{**ENTRY, "type": "word"}],
                   [{**ENTRY, "role": "feature"}], [{**ENTRY, "type": "categorical"}], [{**ENTRY, "role": "key"}]):
        with pytest.raises(ValueError):
            parse_spec(broken, strict=True)


def test_classification(spark):
    df = spark.createDataFrame([(1, 1.0, "x", 2.0, "w")], "k int, n double, c string, t double, w string")
    found = classify(df, ["c"], ["t"], "k")
    assert (found.numeric, found.categorical, found.unclassified) == (["n"], ["c"], ["w"])
    with pytest.raises(ValueError, match="unclassified"):
        found.check()
    assert numeric_columns(df, ["n", "w", "absent"]) == ["n"]


def test_missing_topics_are_reported(spark, tmp_path):
    (tmp_path / "here.csv").write_text("a\n1\n")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        found = tables.existing_topics(spark, {"a": str(tmp_path / "here.csv"), "b": str(tmp_path / "gone.csv")})
    assert list(found) == ["a"]
    assert "gone.csv" in str(seen[-1].message)


def test_metadata_round_trip(spark, tmp_path):
    values = {"names": ["a", "ü"], "n": 3}
    tables.save_metadata(spark, values, str(tmp_path / "m"))
    assert tables.load_metadata(spark, str(tmp_path / "m")) == values
    assert math.isclose(values["n"], 3)
