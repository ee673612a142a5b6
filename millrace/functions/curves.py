"""The Hilbert value of a point of a grid, as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hilbert(x: Column, y: Column, side: int) -> Column:
    """The place of (x, y) along the curve over a side x side grid; side is a power of two, 0 <= x, y < side (null otherwise).

    The curve visits the quarters of a square in Gray-code order: (0, 0), (0, 1), (1, 1), (1, 0). It runs through the middle two as through
    the whole; through the first with the axes exchanged, and through the last with the axes exchanged and both mirrored. So a bit of either
    coordinate, from the highest, gives two bits of the value, once what the quarters around it exchanged and mirrored is undone.
    """
    bits = side.bit_length() - 1
    if side != 1 << bits:
        raise ValueError("the side must be a power of two")
    if not bits:
        return F.lit(0).cast("long")
    x, y = x.cast("long"), y.cast("long")

    def inward(state: Column, k: Column) -> Column:
        bit = lambda c: F.call_function("shiftright", c, k).bitwiseAND(F.lit(1).cast("long"))
        across = F.when(state["exchanged"], bit(y)).otherwise(bit(x)).bitwiseXOR(state["mirrored"])
        along = F.when(state["exchanged"], bit(x)).otherwise(bit(y)).bitwiseXOR(state["mirrored"])
        outer = along == 0  # the first quarter or the last
        value = state["value"] * 4 + across * 2 + across.bitwiseXOR(along)
        return F.struct(value.alias("value"), (state["exchanged"] != outer).alias("exchanged"), F.when(outer, state["mirrored"].bitwiseXOR(across)).otherwise(state["mirrored"]).alias("mirrored"))

    start = F.struct(F.lit(0).cast("long").alias("value"), F.lit(False).alias("exchanged"), F.lit(0).cast("long").alias("mirrored"))
    value = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, inward)["value"]
    return F.when((x >= 0) & (x < side) & (y >= 0) & (y < side), value)
