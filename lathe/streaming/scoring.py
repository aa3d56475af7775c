"""Scores a stream of rows with a saved model (an extension: the rest of the library works on tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lathe.plans.analysis import SavedModel


def score_stream(rows: DataFrame, model: SavedModel, keep: list[str]) -> DataFrame:
    """keep's columns with `prediction`. Stateless: dates, imputation, scaling and encoding are projections,
    and frequencies are static tables that each batch is joined with."""
    if not rows.isStreaming:
        raise ValueError("not a stream; use SavedModel.score")
    return model.score(rows, keep)


def write_scores(scores: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends scores to Parquet files, each row once, and stops when what is there has been scored."""
    return scores.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
