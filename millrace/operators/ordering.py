"""Sorting, reversing, buffering, looking ahead, and taking parts of a sequence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..flow import Flow, Pipe, inverted, middle
from ..session import stored
from .ranges import Ranges, positioned


def sort(*order: str) -> Pipe:
    """Order the flow by these columns ('-' for descending). A sorted flow is a plan: rows move when an operator or a sink needs the order."""
    return middle(lambda flow: flow.with_df(flow.df, order), "sort")


def sort_by(**keys: Column) -> Pipe:
    """Order the flow by keys that expressions extract from the items, in the order given; the keys stay as columns of these names.

    What a comparator says of two items, keys say of one: a Column for each criterion, negated or inverted for the opposite order.
    """
    return middle(lambda flow: flow.with_df(flow.df.withColumns(keys), tuple(keys)), "sort by")


def sorted_rows(flow: Flow) -> DataFrame:
    """The rows, sorted by range."""
    flow.need_order()
    return flow.df.orderBy(*flow.sort_columns())


def sorted_within(*keys: str) -> Pipe:
    """Sort each partition only."""
    return middle(lambda flow: flow.with_df(flow.df.sortWithinPartitions(*keys)), "internal sort")


def reverse() -> Pipe:
    """The items in opposite order: a change of the order only, no data moves."""

    def run(flow: Flow) -> Flow:
        flow.need_order()
        return flow.with_df(flow.df, inverted(flow.order))

    return middle(run, "reverser")


def buffer() -> Pipe:
    """Identity that writes the items out and reads them again: a boundary between phases, first in first out."""
    return middle(lambda flow: flow.with_df(stored(flow.df, "buffer")), "buffer")


def bounded_buffer(size: int) -> Pipe:
    """A buffer of at most so many items; more raise. Items are written out, so that the bound is one of use, not of memory."""

    def run(flow: Flow) -> Flow:
        held = flow.with_df(stored(flow.df, "buffer"))
        if (n := held.df.count()) > size:
            raise ValueError(f"{n} items don't fit a buffer of {size}")
        return held

    return middle(run, "bounded buffer")


class PassiveBuffer:
    """A buffer with an input that takes a flow and an output that gives it, each once, first in first out."""

    def __init__(self, size: int | None = None):
        self.size, self._flow, self._given = size, None, False

    def input(self, flow: Flow) -> None:
        if self._flow is not None:
            raise RuntimeError("input was called before")
        self._flow = (buffer() if self.size is None else bounded_buffer(self.size))(flow)

    def output(self) -> Flow:
        if self._flow is None or self._given:
            raise RuntimeError("output comes once, after input")
        self._given = True
        return self._flow


class PassiveSorter:
    """A sorter with an input that takes a flow and an output that gives it sorted, each once."""

    def __init__(self, *order: str):
        self.order, self._flow, self._given = order, None, False

    def input(self, flow: Flow) -> None:
        if self._flow is not None:
            raise RuntimeError("input was called before")
        self._flow = flow

    def output(self) -> Flow:
        if self._flow is None or self._given:
            raise RuntimeError("output comes once, after input")
        self._given = True
        return self._flow.with_df(self._flow.df, self.order)


class PassiveReverser(PassiveSorter):
    def __init__(self) -> None:
        super().__init__()

    def output(self) -> Flow:
        self.order = inverted(self._flow.order) if self._flow else ()
        return super().output()


def merge_sorted(flows: list[Flow], *order: str) -> Flow:
    """Several runs as one sorted flow."""
    return Flow(reduce(lambda a, b: a.unionByName(b), [f.df for f in flows]), order)


def top(k: int, *order: str) -> Pipe:
    """The first k items in an order: kept per partition, then merged; never a full sort."""

    def run(flow: Flow) -> Flow:
        keys = flow.with_df(flow.df, order).sort_columns()
        return flow.with_df(flow.df.orderBy(*keys).limit(k), order)

    return middle(run, "top")


def peek(columns: list[str], name: str = "next") -> Pipe:
    """Each item with a struct of the next one's columns; null for the last."""

    def run(flow: Flow) -> Flow:
        r = Ranges(flow).neighbour(columns, 1)
        return r.flow_of(r.df.withColumnRenamed("__near", name).drop("__edge"))

    return middle(run, "peek")


def seek(start: int) -> Pipe:
    """From position start on."""
    return middle(lambda flow: (p := positioned(flow)).with_df(p.df.filter(F.col("pos") >= start)), "seek")


#: Items up to which the first ones are kept per task and merged; more are cut off by position.
MOST_MERGED = 100_000


def truncate(size: int) -> Pipe:
    """The first `size` items."""

    def run(flow: Flow) -> Flow:
        flow.need_order()
        if size <= MOST_MERGED:
            return flow.with_df(flow.df.orderBy(*flow.sort_columns()).limit(size))
        p = positioned(flow, "__pos")
        return flow.with_df(p.df.filter(F.col("__pos") < size).drop("__pos"))

    return middle(run, "truncate")


def insert_before(position: int, items: Flow) -> Pipe:
    """The flow with other items, in their own order, before the one at a position; `pos` orders the result."""

    def run(flow: Flow) -> Flow:
        held, more = positioned(flow), positioned(items)
        n = more.fetch("items")
        moved = held.df.withColumn("pos", F.col("pos") + F.when(F.col("pos") >= position, n).otherwise(0))
        at = min(position, held.fetch("items"))
        return Flow(moved.unionByName(more.df.withColumn("pos", F.col("pos") + at)), ("pos",))

    return middle(run, "insert before")
