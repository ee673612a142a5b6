"""Fan-in, fan-out and positional joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..flow import Flow, Pipe, middle
from ..session import hinted, stored
from .ranges import positioned


def union(*flows: Flow) -> Flow:
    """All items of all flows; there is no order between flows."""
    return Flow(reduce(lambda a, b: a.unionByName(b), [f.df for f in flows]))


def split(flow: Flow, branches: int) -> list[Flow]:
    """Every item to every branch; written once, so that the branches don't compute it anew."""
    held = flow.with_df(stored(flow.df, "split"))
    return [held] * branches


def fork(side: Pipe) -> Pipe:
    """The flow goes on, and into a side pipe as well."""

    def run(flow: Flow) -> Flow:
        side(flow)
        return flow

    return middle(run, "fork")


def tee(path: str) -> Pipe:
    """Write the items to a path and go on with what was written."""

    def run(flow: Flow) -> Flow:
        flow.df.write.mode("overwrite").parquet(path)
        return flow.with_df(flow.df.sparkSession.read.schema(flow.df.schema).parquet(path))

    return middle(run, "tee")


def _numbered(flow: Flow, name: str) -> Flow:
    return positioned(flow, name)


def zipped(left: Flow, right: Flow, check: bool = True) -> Flow:
    """Pairs of items at equal positions, as many as the left has. A right flow that is too short raises, surplus items of it go."""
    a, b = _numbered(left, "pos"), _numbered(right, "__pos")
    if check and b.fetch("items") < a.fetch("items"):
        raise ValueError(f"the flow to zip with has {b.fetch('items')} items, {a.fetch('items')} are needed")
    df = a.df.join(b.df, a.df["pos"] == b.df["__pos"]).drop("__pos")
    return Flow(df, ("pos",), {**left.meta, "items": a.fetch("items")})


def unzipped(flow: Flow, first: list[str], second: list[str]) -> tuple[Flow, Flow]:
    """Two flows of the two halves' columns, both in the flow's order."""
    keys = [c.lstrip("-") for c in flow.order]
    pick = lambda cols: flow.with_df(flow.df.select(*dict.fromkeys([*keys, *cols])))
    return pick(first), pick(second)


def interleaved(left: Flow, right: Flow, check: bool = True) -> Flow:
    """a0, b0, a1, b1, ... for as many items as the left has; both of the same columns."""
    a, b = _numbered(left, "pos"), _numbered(right, "pos")
    if check and b.fetch("items") < a.fetch("items"):
        raise ValueError("the flow to merge with is shorter")
    n = a.fetch("items")
    df = a.df.withColumn("pos", F.col("pos") * 2).unionByName(b.df.filter(F.col("pos") < n).withColumn("pos", F.col("pos") * 2 + 1))
    return Flow(df, ("pos",))


def ordered_merge(left: Flow, right: Flow, *order: str) -> Flow:
    """Two flows sorted by `order` as one; of equal items the left's come first, each side in its own order."""
    a, b = _numbered(left, "__nth"), _numbered(right, "__nth")
    df = a.df.withColumn("side", F.lit(0)).unionByName(b.df.withColumn("side", F.lit(1)))
    return Flow(df, (*order, "side", "__nth"))


def pairwise(value: Column, name: str = "value", check: bool = True) -> Pipe:
    """Consume items two by two and give the sum of each pair; an odd count raises."""

    def run(flow: Flow) -> Flow:
        p = positioned(flow)
        if check and p.fetch("items") % 2:
            raise ValueError("an odd number of items")
        return Flow(p.df.groupBy(F.floor(F.col("pos") / 2).alias("pos")).agg(F.sum(value).alias(name)), ("pos",))

    return middle(run, "pairwise")


def arithmetic(left: Flow, right: Flow, a: str, b: str, op: str, name: str = "value") -> Flow:
    """Element-wise +, -, * or / of a column of either flow."""
    z = zipped(left, right)
    x, y = F.col(a), F.col(b)
    made = {"+": x + y, "-": x - y, "*": x * y, "/": x / y}[op]
    return z.with_df(z.df.withColumn(name, made))


def differences(left: Flow, right: Flow, a: str, b: str) -> Flow:
    """(pos, first, second) where two flows differ, nulls compared as values; the longer flow's rest differs from null."""
    x, y = _numbered(left, "pos"), _numbered(right, "pos")
    first = x.df.select("pos", F.col(a).alias("first"))
    second = y.df.select("pos", F.col(b).alias("second"))
    return Flow(first.join(second, "pos", "full").filter(~F.col("first").eqNullSafe(F.col("second"))), ("pos",))


def dealt(flow: Flow, *conditions: Column) -> list[Flow]:
    """A scan with several outputs: a flow for each condition, of the items for which it is the first that holds, and one of the rest.

    The items are written once and each output filters them.
    """
    which = F.coalesce(*[F.when(c, i) for i, c in enumerate(conditions)], F.lit(len(conditions)))
    held = stored(flow.df.withColumn("__output", which), "dealt")
    return [flow.with_df(held.filter(F.col("__output") == i).drop("__output")) for i in range(len(conditions) + 1)]


def lookup(table: DataFrame, key: str, most: int = 100_000) -> Pipe:
    """Items with the columns of a small map's row of their key, null where there is none. Keys are unique in the map, or else items repeat."""
    return middle(lambda flow: flow.with_df(flow.df.join(hinted(table, most), key, "left")), "lookup")


def contained(table: DataFrame, key: str, most: int = 100_000) -> Pipe:
    """Items whose key is in a set."""
    return middle(lambda flow: flow.with_df(flow.df.join(hinted(table.select(key), most), key, "left_semi")), "contained")
