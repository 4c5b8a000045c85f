"""Scores of predictions that arrive as a stream: the score table is made of sums, so it updates as rows come."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridloom.operators.aggregates import score_table


def score_stream(predictions: DataFrame, by: list[str]) -> DataFrame:
    """The score table of a streaming table (by, mean, sd, truth); write it in complete or update mode."""
    if not predictions.isStreaming:
        raise ValueError("predictions is no stream")
    return score_table(predictions, by)
