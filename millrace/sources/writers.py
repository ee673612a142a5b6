"""Sinks: ends of pipelines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row
from pyspark.sql import functions as F

from ..flow import Flow, Pipe, end


def output(path: str, mode: str = "append", codec: str = "snappy") -> Pipe:
    """Write the items to a table, as they are dealt."""
    return end(lambda flow: flow.df.write.mode(mode).option("compression", codec).parquet(path), f"output {path}")


def write_sorted(path: str, mode: str = "overwrite", parts: int | None = None) -> Pipe:
    """Write the items in order: files are ranges, sorted within."""

    def run(flow: Flow) -> None:
        flow.need_order()
        keys = flow.sort_columns()
        n = parts or int(flow.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        flow.df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode(mode).parquet(path)

    return end(run, f"output {path}")


def to_vector() -> Pipe:
    """All items in a list on the driver; for results known to be small."""
    return end(lambda flow: flow.df.orderBy(*flow.sort_columns()).collect() if flow.order else flow.df.collect(), "output_vector")


def to_iterator() -> Pipe:
    """Items in order, a partition at a time on the driver."""

    def run(flow: Flow) -> Iterator[Row]:
        return (flow.df.orderBy(*flow.sort_columns()) if flow.order else flow.df).toLocalIterator()

    return end(run, "output_iterator")


def print_ints(path: str, column: str) -> Pipe:
    """A number a line, in order."""

    def run(flow: Flow) -> None:
        df = flow.df.orderBy(*flow.sort_columns()) if flow.order else flow.df
        df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)

    return end(run, "printf_ints")


def noop() -> Pipe:
    """Compute and discard."""
    return end(lambda flow: flow.df.write.format("noop").mode("overwrite").save(), "null_sink")


def foreach(f: Callable[[Row], None]) -> Pipe:
    """Call f for each item, on the executors."""
    return end(lambda flow: flow.df.foreach(f), "map_sink")
