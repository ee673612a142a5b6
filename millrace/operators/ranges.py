"""Positions, neighbours and running sums of a flow without gathering it in one task.

A global window plans a single partition. Instead the flow is sorted into ranges of its order, written once (so that the ranges
stay the same) with each row's place in its range, and each range is scanned by a task of its own; what a range needs to know
of those before it is one row a range, which the driver carries on: counts, sums, the last item. Positions need no scan at all.
Large flows have more ranges, so that a task's rows don't grow with the flow.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..flow import Flow
from ..session import partitions, stored

#: Columns that a flow has while it is in ranges: the range, and the row's place in it.
PART, PLACE = "__part", "__place"
_BITS = 33  # of monotonically_increasing_id() that count rows within a partition
#: About how many rows a range holds at most.
ROWS = 1 << 20


class Ranges:
    """A flow sorted into ranges. Methods add a column to `df` and return the ranges."""

    def __init__(self, flow: Flow, parts: int | None = None):
        flow.need_order()
        self.flow, self.spark = flow, flow.df.sparkSession
        keys = flow.sort_columns()
        self.parts = parts or max(partitions(self.spark), -(-flow.df.count() // ROWS))
        ranged = flow.df.repartitionByRange(self.parts, *keys).sortWithinPartitions(*keys)
        numbered = ranged.withColumn(PLACE, F.monotonically_increasing_id())
        self.df = stored(numbered.withColumns({PART: F.shiftright(PLACE, _BITS).cast("int"), PLACE: F.col(PLACE).bitwiseAND(F.lit((1 << _BITS) - 1))}), "ranges")
        self.local = Window.partitionBy(PART).orderBy(PLACE)
        self.kept, self.apart = self.df, False

    def _each(self) -> DataFrame:
        """The rows with each range in a task of its own: ranges dealt by a hash would meet in one."""
        if not self.apart:
            self.df, self.apart = self.df.repartitionById(self.parts, F.col(PART)), True
        return self.df

    def _last(self, df: DataFrame, value: Column, first: bool = False) -> dict[int, object]:
        """A value of each range's last (or first) row: places are found first, so that no task sorts or holds its rows."""
        at = df.groupBy(PART).agg((F.min if first else F.max)(PLACE).alias(PLACE))
        return {r[0]: r[1] for r in df.join(F.broadcast(at), [PART, PLACE]).select(PART, value).collect()}

    @cached_property
    def counts(self) -> dict[int, int]:
        return {r[0]: r[1] for r in self.kept.groupBy(PART).agg(F.max(PLACE) + 1).collect()}

    def total(self) -> int:
        return sum(self.counts.values())

    def flow_of(self, df: DataFrame, *order: str) -> Flow:
        return self.flow.with_df(df.drop(PART, PLACE), order or None)

    def _carried(self, table: dict[int, object], name: str, kind: str) -> DataFrame:
        """The rows with a value of their range: a table of a row a range, broadcast."""
        return self.df.join(F.broadcast(self.spark.createDataFrame(sorted(table.items()), f"{PART} int, {name} {kind}")), PART, "left")

    def position(self, name: str) -> Ranges:
        """Dense positions from 0."""
        start, at = {}, 0
        for k in sorted(self.counts):
            start[k] = at
            at += self.counts[k]
        self.df = self._carried(start, "__start", "long").withColumn(name, F.col(PLACE) + F.col("__start")).drop("__start")
        return self

    def running(self, name: str, value: Column, before: bool = True) -> Ranges:
        """Sum of the values up to each item, the item's own left out if `before`; 0 where there is none."""
        sums = self.df.groupBy(PART).agg(F.sum(value).alias("s"))
        kind = dict(sums.dtypes)["s"]
        start, at = {}, None
        for k, v in sorted((r[0], r[1]) for r in sums.collect()):
            start[k] = at
            at = v if at is None else at if v is None else at + v
        rows = self.local.rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
        zero = F.lit(0).cast(kind)
        self._each()
        self.df = self._carried(start, "__start", kind).withColumn(name, F.coalesce(F.sum(value).over(rows), zero) + F.coalesce("__start", zero)).drop("__start")
        return self

    def neighbour(self, columns: list[str], step: int = -1) -> Ranges:
        """Add `__near` (a struct of the columns of the item before, or after for step 1) and `__edge` (true where there is none)."""
        item = F.struct(*columns)
        ends = self._last(self.df, item, step > 0)
        keys = sorted(ends)
        near = {k: ends[j] for j, k in zip(keys, keys[1:])} if step < 0 else {k: ends[j] for k, j in zip(keys, keys[1:])}
        inner = (F.lag if step < 0 else F.lead)(item).over(self.local)
        kind = self.df.select(item.alias("x")).schema["x"].dataType.simpleString()
        self._each()
        df = self._carried(near, "__over", kind).withColumn("__in", inner)
        self.df = df.withColumn("__near", F.coalesce("__in", "__over")).withColumn("__edge", F.col("__near").isNull()).drop("__in", "__over")
        return self

    def lengths(self, name: str, first: str) -> Ranges:
        """Only the rows whose column `first` is 1, each with the number of rows up to the next such row."""
        starts = self.df.filter(F.col(first) == 1)
        lead = {r[0]: r[1] for r in starts.groupBy(PART).agg(F.min(PLACE)).collect()}
        after, more = {}, 0
        for k in sorted(self.counts, reverse=True):  # rows of the next ranges that belong to the last run of range k
            after[k] = more + self.counts[k]
            more = lead[k] if k in lead else more + self.counts[k]
        self._each()
        df = self._carried(after, "__after", "long").filter(F.col(first) == 1)
        self.df = df.withColumn(name, F.coalesce(F.lead(PLACE).over(self.local), F.col("__after")) - F.col(PLACE)).drop("__after")
        return self

    def filled(self, name: str, column: str) -> Ranges:
        """The column's last value that isn't null, up to each item."""
        some = self.df.filter(F.col(column).isNotNull())
        ends = self._last(some, F.col(column))
        carry, last = {}, None
        for k in range(max(self.counts, default=-1) + 1):
            carry[k] = last
            last = ends.get(k, last)
        rows = self.local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        kind = self.df.schema[column].dataType.simpleString()
        self._each()
        df = self._carried(carry, "__carry", kind).withColumn("__own", F.last(column, ignorenulls=True).over(rows))
        self.df = df.withColumn(name, F.coalesce("__own", "__carry")).drop("__own", "__carry")
        return self


def positioned(flow: Flow, name: str = "pos", parts: int | None = None) -> Flow:
    """The flow with dense positions from 0, which become its order."""
    r = Ranges(flow, parts).position(name)
    return r.flow_of(r.df, name).forward("items", r.total())
