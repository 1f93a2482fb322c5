"""Compiled pipelines over streams: joins with static tables and projections hold no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Pipeline


def over_stream(pipeline: Pipeline, lines: DataFrame) -> DataFrame:
    """A stream of JSON lines in a column value as a stream of enriched records; JDBC lookups join anew each batch."""
    if not lines.isStreaming:
        raise ValueError("lines are not a stream")
    return pipeline.over_json(lines.filter(F.trim("value") != ""))
