"""Whole runs over transport files, and streaming."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from xport_files import write_xport

from loomstat.operators import clean, features, models
from loomstat.plans import runs
from loomstat.spec import parse_spec
from loomstat.streaming import scoring

SPEC = parse_spec([
    {"name": "age", "source": "AGE", "file": "DEMO_I", "type": "numeric", "role": "feature"},
    {"name": "sex", "source": "SEX", "file": "DEMO_I", "type": "categorical", "role": "feature"},
    {"name": "weight", "source": "WGT", "file": "BODY_I", "type": "numeric", "role": "feature", "drop_extrema": True},
    {"name": "level", "source": "LVL", "file": "LAB_I", "type": "numerical", "role": "target", "log_transform": True},
    {"name": "absent", "source": "ABS", "file": "GONE_I", "type": "numeric", "role": "feature"},
], key="SEQN", sentinels={"sex": [7, 9]})


def write_cycle(folder, cycle, seed):
    rng = random.Random(seed)
    people = [(float(i), rng.uniform(20, 80), rng.choice([1.0, 2.0, 7.0]), rng.uniform(50, 100)) for i in range(300)]
    write_xport(f"{folder}/DEMO_{cycle}.xpt.txt", [("SEQN", "num", 8), ("AGE", "num", 8), ("SEX", "num", 8), ("NOT", "num", 8)],
                [(k, a, s, 0.0) for k, a, s, _ in people])
    write_xport(f"{folder}/BODY_{cycle}.xpt.txt", [("SEQN", "num", 8), ("WGT", "num", 8)],
                [(k, w if k % 9 else None) for k, _, _, w in people if k % 5])
    write_xport(f"{folder}/LAB_{cycle}.xpt.txt", [("SEQN", "num", 8), ("LVL", "num", 8)],
                [(k, 50 + 2 * a + w / 10) for k, a, _, w in people if k % 4])


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    data, out = str(tmp_path_factory.mktemp("data")), str(tmp_path_factory.mktemp("out"))
    write_cycle(data, "I", 1)
    write_cycle(data, "H", 2)
    with pytest.warns(UserWarning, match="GONE_I"):
        results = runs.run_training(
            spark, SPEC, data, out, families=["linear", "random_forest", "knn"], how="study", trials=2,
            params={"random_forest": {"n_estimators": 5, "max_depth": 4}}, cv_folds=[3])
    return data, out, results


def test_training_run(trained):
    _, _, results = trained
    test = {r.Model: r.R2 for r in results["test_metrics"].collect()}
    assert set(test) == {"Linear Regression", "Random Forest", "KNN"}
    assert test["Linear Regression"] > 0.8
    assert results["comparison"].filter("Target = 'Mean'").count() == 6
    assert results["cv"].count() == 3
    top = results["importances"].orderBy(F.desc("Importance")).first()
    assert top.Feature == "age"
    sums = results["importances"].groupBy("Model", "Target").agg(F.sum("Importance").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)


def test_clean_table(spark, trained):
    _, out, _ = trained
    df = spark.read.parquet(f"{out}/clean")
    assert df.columns == ["SEQN", "weight", "age", "sex", "level"]
    assert df.filter("level is null").count() == 0
    # The trim removes a person from one topic only; the join brings the person back without its values.
    without = df.filter("weight is null")
    assert df.count() == 225
    assert without.count() > without.filter("SEQN % 5 = 0 or SEQN % 9 = 0").count()
    assert df.filter("sex = 7").count() == 0


@pytest.mark.parametrize("bounds", ["refit", "train"])
def test_scoring_run(spark, trained, bounds):
    data, out, _ = trained
    with pytest.warns(UserWarning, match="GONE_H"):
        results = runs.run_scoring(spark, SPEC, data, out, "H", bounds=bounds)
    assert {r.status for r in results["status"].collect()} == {"scored"}
    got = {r.Model: r.R2 for r in results["metrics"].collect()}
    assert got["Linear Regression"] > 0.8
    assert "Linear Regression" in runs.describe_run(results)


def test_streamed_rows_are_cleaned_and_scored_like_batches(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").cast("double").alias("SEQN"), (F.col("id") % 50).cast("double").alias("AGE"),
                                   (F.col("id") * 2.0 + 1).alias("LVL"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    part = [SPEC.features[0], SPEC.features[3]]
    table, bounds = clean.clean_topic(rows, part, "SEQN", {})
    ready = features.prepare(table, ["SEQN"], ["age"], [], {"level": "log1p"})
    fitted = models.fit("linear", ready.train, ["level"])
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    scored = scoring.score_stream(scoring.clean_stream(stream, part, "SEQN", {}, bounds), ready.preprocessor, fitted,
                                  ready.targets, ["SEQN"])
    query = scoring.append_to_table(scored, str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == table.count()
    assert sorted(got.columns) == ["Model", "Predicted", "Residual", "SEQN", "Target", "True"]
