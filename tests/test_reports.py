from __future__ import annotations

import threading

from loomstat.operators import evaluate


def test_families_are_fitted_side_by_side(spark, monkeypatch):
    """Two fits wait for each other; every family is reported once, with its own parameters."""
    met = threading.Barrier(2, timeout=30)

    def fit(family, rows, targets, params, key):
        met.wait()
        return family, params["n"]

    monkeypatch.setattr(evaluate, "fit", fit)
    monkeypatch.setattr(evaluate, "report", lambda fitted, *_: spark.createDataFrame([fitted], "Model string, n int"))
    families = {"ridge": {"n": 1}, "linear": {"n": 2}, "svr": {"n": 3}, "knn": {"n": 4}}
    got = evaluate.fit_reports(families, None, ["net"], None, ["id"], workers=2).collect()
    assert [tuple(r) for r in got] == [("ridge", 1), ("linear", 2), ("svr", 3), ("knn", 4)]
