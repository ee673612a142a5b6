"""Queues, stacks and priority queues as replays of push and pop events, per key in arrival order."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _heights(events: DataFrame, key: list[str], order: list[str], push: Column) -> DataFrame:
    """Add __size, the items held before each event; pops of an empty container do nothing."""
    w = Window.partitionBy(*key).orderBy(*order)
    df = events.withColumn("__push", push).withColumn("__sum", F.sum(F.when(F.col("__push"), 1).otherwise(-1)).over(w))
    low = F.least(F.lit(0), F.min("__sum").over(w))
    df = df.withColumn("__after", F.col("__sum") - low)
    return df.withColumn("__size", F.coalesce(F.lag("__after").over(w), F.lit(0)))


def fifo_replay(events: DataFrame, key: list[str], order: list[str], push: Column, value: str) -> DataFrame:
    """Each pop with the value it takes from a first-in first-out queue, in column popped; null from an empty queue.

    The i-th pop that finds an item takes the i-th item pushed: a join on the count, no replay item by item.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    df = _heights(events, key, order, push)
    took = ~F.col("__push") & (F.col("__size") > 0)
    df = df.withColumns({"__in": F.sum(F.col("__push").cast("int")).over(w), "__out": F.sum(took.cast("int")).over(w), "__took": took})
    pushed = df.filter("__push").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col("__in").alias("__nth"), F.col(value).alias("popped"))
    match = F.col("__took") & (F.col("__out") == F.col("__nth"))
    for i, k in enumerate(key):
        match &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    pops = df.filter("not __push").join(pushed, match, "left")
    return pops.select(*events.columns, "popped")


def lifo_replay(events: DataFrame, key: list[str], order: list[str], push: Column, value: str) -> DataFrame:
    """Each pop with the value it takes from a stack, in column popped; null from an empty stack.

    A pop takes what the last push to its height put there: a window over key and height.
    """
    df = _heights(events, key, order, push).withColumn("__level", F.when(F.col("__push"), F.col("__size") + 1).otherwise(F.col("__size")))
    w = Window.partitionBy(*key, "__level").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("__push"), F.struct(value)), ignorenulls=True).over(w)
    return df.withColumn("__top", last).filter("not __push").select(*events.columns, F.when(F.col("__size") > 0, F.col("__top")[value]).alias("popped"))


def priority_replay(events: DataFrame, key: list[str], order: list[str], push: str, value: str, schema: str) -> DataFrame:
    """Each pop with the least value held, in column popped; null from an empty queue.

    What a pop takes depends on all pops before it, so a key's events are replayed in order by one task. They stream through it sorted; it
    holds one heap, as large as the key's queue gets. Bulk drains, which need no replay, are sorts, and least values by group are
    aggregates. Columns named `push` and `value` drive it; a null value is pushed and popped as the greatest.
    """
    names = [f.split()[0] for f in schema.split(",")][:-1]
    at = {c: i for i, c in enumerate(names)}

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list = []
        now = None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            popped, kept = [], []
            for i, (group, pushes, v) in enumerate(zip(zip(*(columns[at[k]] for k in key)), columns[at[push]], columns[at[value]])):
                if group != now:
                    heap, now = [], group
                if pushes:
                    heapq.heappush(heap, (v is None, v))
                else:
                    kept.append(i)
                    popped.append(heapq.heappop(heap)[1] if heap else None)
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(popped, batch.schema.field(at[value]).type)], names=[*names, "popped"])

    sorted_events = events.select(*names).repartition(*key).sortWithinPartitions(*key, *order)
    return sorted_events.mapInArrow(replay, schema)


def drained(items: DataFrame, *order: Column) -> DataFrame:
    """All items of a priority queue as pops give them."""
    return items.orderBy(*order)


def pop_top(items: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The items that tie at the top, which pop together, and those that stay. The top is one row, which is broadcast."""
    top = items.agg(F.min(F.struct(*key)).alias("__top"))
    marked = items.join(F.broadcast(top), F.lit(True), "left")
    is_top = F.struct(*key).eqNullSafe(F.col("__top"))
    return marked.filter(is_top).drop("__top"), marked.filter(~is_top).drop("__top")


def pop_and_push(items: DataFrame, pushed: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """The first item of a queue, and the queue with the items pushed in its place. `order` tells all items apart."""
    first = items.orderBy(*order).limit(1)
    same = F.lit(True)
    for c in order:
        same &= items[c].eqNullSafe(first[c])
    return first, items.join(F.broadcast(first), same, "left_anti").unionByName(pushed)


def pop_equals(items: DataFrame, key: list[str], *aggregates: Column) -> DataFrame:
    """Items that tie at the top pop together: an aggregate for each distinct key, in order."""
    return items.groupBy(*key).agg(*aggregates).orderBy(*key)
