"""Bit operations: parity, linear maps over bits, packed small integers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def parity(x: Column) -> Column:
    return F.bit_count(x) % 2


def bit_matrix_apply(x: Column, rows: list[int], shift: int = 0) -> Column:
    """A x + c over bits: output bit i is the parity of x and row i; then xor with the shift."""
    bits = [F.shiftleft(parity(x.bitwiseAND(F.lit(r))).cast("long"), i) for i, r in enumerate(rows)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).bitwiseXOR(F.lit(shift).cast("long"))


def packed(values: Column, bits: int) -> Column:
    """An array of small integers in one long, the first in the lowest bits; 64 / bits of them at most."""
    at = F.transform(values, lambda v, i: F.call_function("shiftleft", v.cast("long"), (i * bits).cast("int")))
    return F.aggregate(at, F.lit(0).cast("long"), lambda a, v: a.bitwiseOR(v))


def get_bits(word: Column, index: Column, bits: int) -> Column:
    return F.call_function("shiftrightunsigned", word, (index * bits).cast("int")).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
