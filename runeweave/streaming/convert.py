"""Conversion of streams.  Every row is converted by itself, so append mode needs no watermark or state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.columns import Engine


def converted(stream: DataFrame, engine: Engine, markup: str = "value") -> DataFrame:
    """The stream with `converted`: struct(text, warnings, error)."""
    return stream.withColumn("converted", engine.convert(stream[markup]))


def drain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what the source has now as Parquet, exactly once, and stop."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
