"""Frames over Structured Streaming sources.

The verbs are plain DataFrame transformations, so a frame over ``readStream`` takes select, filter,
mutate, grouped summaries and stream-static joins as a batch frame does; the sink decides the output
mode.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..frame import Frame


def stream_parquet(spark: SparkSession, path: str, schema: object, max_files: int | None = None) -> Frame:
    r = spark.readStream.schema(schema)
    return Frame((r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path))


def run_available(frame: Frame, name: str, mode: str = "complete") -> StreamingQuery:
    """Process what is there into an in-memory table, then stop."""
    q = frame.df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
