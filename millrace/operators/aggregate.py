"""Runs of equal items, distinct items, chunks, folds, and pipelines within groups."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..flow import Flow, Pipe, middle
from .ranges import Ranges, positioned


def _runs(flow: Flow, columns: list[str]) -> Ranges:
    """The flow by ranges, with __new where an item differs from the one before (nulls are equal)."""
    r = Ranges(flow).neighbour(columns, -1)
    same = F.lit(True)
    for c in columns:
        same &= F.col(c).eqNullSafe(F.col("__near")[c])
    r.df = r.df.withColumn("__new", F.when(F.col("__edge"), 1).otherwise((~same).cast("int"))).drop("__near", "__edge")
    return r


def unique(columns: list[str], position: str | None = None) -> Pipe:
    """Drop items equal to the one before; the first of each run stays. With `position`, add its position in the flow."""

    def run(flow: Flow) -> Flow:
        r = _runs(flow, columns)
        if position:
            r.position(position)
        return r.flow_of(r.df.filter("__new = 1").drop("__new"))

    return middle(run, "unique")


def count_consecutive(columns: list[str], name: str = "count") -> Pipe:
    """Run lengths: one item a run of equal items, with their number; `run` numbers the runs from 1."""

    def run(flow: Flow) -> Flow:
        r = _runs(flow, columns).running("run", F.col("__new"), before=False).lengths(name, "__new")
        return flow.with_df(r.df.select("run", *columns, name), ("run",))

    return middle(run, "count_consecutive")


def distinct_first(columns: list[str], position: str = "pos") -> Pipe:
    """Distinct values in the order of their first occurrences, with its position."""

    def run(flow: Flow) -> Flow:
        p = positioned(flow, position)
        return flow.with_df(p.df.groupBy(*columns).agg(F.min(position).alias(position)), (position,))

    return middle(run, "distinct_first")


def chunker(n: int, column: str, name: str = "items") -> Pipe:
    """Consecutive items in arrays of n, the last possibly shorter; `chunk` numbers them from 0. No array is longer than n."""

    def run(flow: Flow) -> Flow:
        p = positioned(flow)
        item = F.struct("pos", F.col(column).alias("v"))
        df = p.df.groupBy(F.floor(F.col("pos") / n).alias("chunk")).agg(F.sort_array(F.collect_list(item)).alias("x"))
        return Flow(df.select("chunk", F.transform("x", lambda x: x["v"]).alias(name)), ("chunk",))

    return middle(run, "chunker")


def fold(*aggregates: Column, by: list[str] | None = None) -> Callable[[Flow], DataFrame]:
    """Aggregates of all items, or of each group of them."""
    return lambda flow: flow.df.groupBy(*(by or [])).agg(*aggregates)


def ranked_within(group: list[str], order: list[Column], name: str = "nth") -> Pipe:
    """A sort within each group: the place of each item in its group, from 0. Groups of any size spill; none is held in memory."""
    return middle(lambda flow: flow.with_df(flow.df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1), (*group, name)), "subpipeline")


def grouped(group: list[str], inner: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Pipe:
    """An imperative node run for each group in pandas; a group must fit into a task."""
    return middle(lambda flow: flow.with_df(flow.df.groupBy(*group).applyInPandas(inner, schema), ()), "subpipeline")


def top_difference(value: str, k: int = 20, name: str = "diff") -> Pipe:
    """For each item, the sum over the k largest of (largest - item); the k largest are one row, which is broadcast."""

    def run(flow: Flow) -> Flow:
        best = flow.df.select(value).orderBy(F.col(value).desc()).limit(k).agg(F.sum(value).alias("__s"), F.count(value).alias("__k"))
        return flow.with_df(flow.df.crossJoin(F.broadcast(best)).withColumn(name, F.col("__s") - F.col("__k") * F.col(value)).drop("__s", "__k"))

    return middle(run, "top_difference")


def rollup(keys: list[str], *aggregates: Column) -> Pipe:
    return middle(lambda flow: flow.with_df(flow.df.rollup(*keys).agg(*aggregates), ()), "rollup")


def cube(keys: list[str], *aggregates: Column) -> Pipe:
    return middle(lambda flow: flow.with_df(flow.df.cube(*keys).agg(*aggregates), ()), "cube")


def grouping_sets(sets: list[list[str]], *aggregates: Column) -> Pipe:
    """Aggregates by each set of keys, in one pass; a key that isn't of the set is null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return middle(lambda flow: flow.with_df(flow.df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(*aggregates), ()), "grouping sets")


def approx_distinct(keys: list[str], column: str, name: str = "distinct", rsd: float = 0.05) -> Pipe:
    """About how many distinct values of a column each group has, by a sketch of fixed size."""
    return middle(lambda flow: flow.with_df(flow.df.groupBy(*keys).agg(F.approx_count_distinct(column, rsd).alias(name)), ()), "approximate distinct")
