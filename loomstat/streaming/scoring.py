"""Cleaning and scoring of a stream of rows.

With fitted bounds, a fitted preprocessor and fitted models every step is a projection or
a filter, so a streaming table takes the batch functions as they are and needs no state.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import Bounds, clean_topic
from ..operators.evaluate import residuals
from ..operators.features import Preprocessor, TargetTransform
from ..operators.models import Fitted
from ..spec import Feature


def clean_stream(stream: DataFrame, features: Sequence[Feature], key: str, sentinels: Mapping[str, Sequence[Any]],
                 bounds: Bounds) -> DataFrame:
    """One topic's cleaning with bounds fitted before."""
    return clean_topic(stream, features, key, sentinels, bounds)[0]


def score_stream(stream: DataFrame, preprocessor: Preprocessor, model: Fitted, transform: TargetTransform,
                 keep: Sequence[str]) -> DataFrame:
    """Residuals of the streamed rows, which carry features and targets."""
    if model.family == "knn":
        raise ValueError("nearest neighbours need a shuffle over all rows and are scored in batches")
    vectors = preprocessor.transform(transform.transform(stream), [*keep, *[f"label_{t}" for t in transform.names]])
    return residuals(model.predict(vectors), model.name, transform, keep)


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet until the available input is used up; the checkpoint makes a restart go on."""
    return (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start(path))
