"""Unbounded flows: per-item pipes over Structured Streaming, and windowed aggregates with watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..flow import Flow, Pipe


def source(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 8) -> Flow:
    """Files that arrive in a folder, as a flow without order."""
    return Flow(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def through(flow: Flow, pipe: Pipe) -> Flow:
    """Apply a pipe of per-item nodes; a node that needs positions raises."""
    return pipe(flow)


def windowed(flow: Flow, time: str, width: str, late: str, keys: list[str], *aggregates: Column, slide: str | None = None) -> DataFrame:
    """Aggregates of tumbling or sliding windows; items later than the watermark go. Times without a zone are the session's."""
    df = flow.df.withColumn(time, F.col(time).cast("timestamp"))
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.withWatermark(time, late).groupBy(w, *keys).agg(*aggregates)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there, exactly once over restarts, and stop."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
