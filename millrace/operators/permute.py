"""Permutations of a sequence: by a function of the position, by a matrix over bits, at random."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..flow import Flow, Pipe, middle
from ..functions import bit_matrix_apply
from .ranges import positioned


def general_permute(destination: Callable[[Column, int], Column], name: str = "dest") -> Pipe:
    """Move the item at each position to destination(position, items), which must be a permutation; `name` is the new order."""

    def run(flow: Flow) -> Flow:
        p = positioned(flow)
        n = p.fetch("items")
        return p.with_df(p.df.withColumn(name, destination(F.col("pos"), n).cast("long")), (name,))

    return middle(run, "permute")


def bit_permute(rows: list[int], shift: int = 0, name: str = "dest") -> Pipe:
    """Destination A pos + c over bits; row i of the matrix is a mask for bit i."""
    return general_permute(lambda pos, _: bit_matrix_apply(pos, rows, shift), name)


def shuffled(seed: int) -> Pipe:
    """A random order: by a hash of the order columns, or of all, so that it doesn't depend on how rows are dealt."""

    def run(flow: Flow) -> Flow:
        keys = [c.lstrip("-") for c in flow.order] or flow.df.columns
        return flow.with_df(flow.df.withColumn("__rand", F.xxhash64(F.lit(seed), *keys)), ("__rand", *keys))

    return middle(run, "random merge")
