"""Scans over several flows at once, and layered indexes that grow by merging."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..flow import Flow, Pipe, middle
from ..session import stored
from .aggregate import _runs
from .combine import zipped
from .index import SortedIndex
from .ranges import positioned


def scan(flows: list[Flow], **outputs: Column) -> Flow:
    """Read flows in step, an item of each at a time, and give these expressions; the first flow's length decides. Column names must differ."""
    both = reduce(lambda a, b: zipped(a, b), flows[1:], positioned(flows[0]))
    return Flow(both.df.select("pos", *[c.alias(n) for n, c in outputs.items()]), ("pos",))


def scan_by(flows: list[Flow], key: str, order: list[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Read flows out of step: items of all flows, tagged `input`, go by key and order through an imperative node.

    The node sees one key's items as a frame and decides what to consume and emit; a key's items must fit into a task.
    """
    tagged = [f.df.withColumn("input", F.lit(i)) for i, f in enumerate(flows)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return both.groupBy(key).applyInPandas(lambda pdf: step(pdf.sort_values([*order, "input"])), schema)


def interleave(flows: list[Flow]) -> Flow:
    """Round robin over k flows of the same columns: the i-th item of flow s is at i * k + s. Shorter flows leave gaps."""
    k = len(flows)
    parts = [(p := positioned(f)).df.withColumn("pos", F.col("pos") * k + s) for s, f in enumerate(flows)]
    return Flow(reduce(lambda a, b: a.unionByName(b), parts), ("pos",))


def consecutive_groups(columns: list[str], name: str = "group") -> Pipe:
    """Number the runs of equal items from 1, as groups for a pipeline of their own; groups are consecutive, not all equal items."""

    def run(flow: Flow) -> Flow:
        r = _runs(flow, columns).running(name, F.col("__new"), before=False)
        return r.flow_of(r.df.drop("__new"), name, *flow.order)

    return middle(run, "subpipeline groups")


class LayeredIndex:
    """A static index made dynamic: batches are layers of growing size; layers are merged when one outgrows the next.

    Every lookup asks the union of all layers, whose number grows as the logarithm of the rows.
    """

    def __init__(self, key: str, factor: int = 4):
        self.key, self.factor = key, factor
        self.layers: list[tuple[int, DataFrame]] = []

    def insert(self, rows: DataFrame) -> LayeredIndex:
        rows = stored(rows, "layer")
        n = rows.count()
        while self.layers and self.layers[-1][0] < self.factor * n:
            m, old = self.layers.pop()
            rows, n = stored(old.unionByName(rows), "layer"), n + m
        self.layers.append((n, rows))
        return self

    def index(self) -> SortedIndex:
        if not self.layers:
            raise ValueError("nothing was inserted")
        return SortedIndex(reduce(lambda a, b: a.unionByName(b), [df for _, df in self.layers]), self.key)
