"""Scoring of streams: the compiled model is an expression, so it needs no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame


def score_stream(booster, stream: DataFrame, **kwargs) -> DataFrame:
    """A streaming DataFrame with a prediction column."""
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return booster.predict(stream, **kwargs)


def write_scores(booster, stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **kwargs):
    """Starts a query that appends the scored rows to Parquet files."""
    return score_stream(booster, stream, **kwargs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
