"""Per-item operators: Column expressions, inside whole-stage code generation. They accept streams too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..flow import Flow, Pipe, middle


def map_items(**columns: Column) -> Pipe:
    """Items with these columns added or replaced."""
    return middle(lambda flow: flow.with_df(flow.df.withColumns(columns)), "map")


def project(*columns: str | Column) -> Pipe:
    """Items of just these columns. Order columns that are gone leave the flow without order."""

    def run(flow: Flow) -> Flow:
        df = flow.df.select(*columns)
        kept = all(c.lstrip("-") in df.columns for c in flow.order)
        return flow.with_df(df, flow.order if kept else ())

    return middle(run, "project")


def filter_items(condition: Column | str) -> Pipe:
    """Items for which the condition is true; null is not true."""
    return middle(lambda flow: flow.with_df(flow.df.filter(condition)), "filter")


def exclude(value: Column, keep: Column, name: str = "value") -> Pipe:
    """Map and filter in one: the value of the items that are kept."""
    return middle(lambda flow: flow.with_df(flow.df.filter(keep).withColumn(name, value)), "exclude_lambda")


def linear(column: str, factor: float, term: float, name: str | None = None) -> Pipe:
    """column * factor + term."""
    return middle(lambda flow: flow.with_df(flow.df.withColumn(name or column, F.col(column) * factor + term)), "linear")


def visit(name: str | Observation, *metrics: Column) -> Pipe:
    """Identity that observes metrics of the items that pass."""
    return middle(lambda flow: flow.with_df(flow.df.observe(name, *metrics)), "visit")


def log_items(name: str = "log", log: Callable[[str], None] = print) -> Pipe:
    """Identity that logs the schema and the order when the plan is made."""

    def run(flow: Flow) -> Flow:
        log(f"{name}: {flow.df.schema.simpleString()} by {', '.join(flow.order) or 'no order'}")
        return flow

    return middle(run, "logger")


def item_type(schema: StructType) -> Pipe:
    """Identity that demands a schema; a flow of another one raises when the plan is made."""

    def run(flow: Flow) -> Flow:
        have, want = {f.name: f.dataType for f in flow.df.schema}, {f.name: f.dataType for f in schema}
        if have != want:
            raise TypeError(f"items are {flow.df.schema.simpleString()}, not {schema.simpleString()}")
        return flow

    return middle(run, "item_type")


def extract_first(column: str, name: str | None = None) -> Pipe:
    """The first field of a struct column."""

    def run(flow: Flow) -> Flow:
        first = flow.df.schema[column].dataType.fieldNames()[0]
        return flow.with_df(flow.df.withColumn(name or column, F.col(column)[first]))

    return middle(run, "extract_first")


def square(column: str) -> Pipe:
    return middle(lambda flow: flow.with_df(flow.df.withColumn(column, F.col(column) * F.col(column))), "square")
