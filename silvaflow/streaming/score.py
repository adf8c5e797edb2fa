"""Scoring streams: predictions need one row at a time, so that a stream of rows is scored as a table is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.descend import open_model
from ..operators.predict import predict_classifier, predict_regressor
from ..operators.score import fits
from ..plans.prepare import ForestError


def score_stream(model, stream: DataFrame, na_action: str = "null", n_trees: int | None = None) -> DataFrame:
    """stream with the model's predictions, for writeStream. The model must be small enough to be sent to the workers."""
    m = open_model(model, "score_stream")
    if not fits(m):
        raise ForestError("score_stream: the model has too many nodes to score a stream")
    predict = predict_regressor if m.meta.family == "regression" else predict_classifier
    return predict(m.nodes, stream, na_action, n_trees)


def write_scores(model, stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **options) -> StreamingQuery:
    """Starts writing the scored stream to files at path."""
    return score_stream(model, stream, **options).writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
