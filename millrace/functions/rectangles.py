"""Predicates and measures of closed rectangles, given as structs or prefixes of (xlo, ylo, xhi, yhi), and of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Column


def x_overlaps(a: Box, b: Box) -> Column:
    return (a["xlo"] <= b["xhi"]) & (b["xlo"] <= a["xhi"])


def y_overlaps(a: Box, b: Box) -> Column:
    return (a["ylo"] <= b["yhi"]) & (b["ylo"] <= a["yhi"])


def intersects(a: Box, b: Box) -> Column:
    """Touching counts."""
    return x_overlaps(a, b) & y_overlaps(a, b)


def width(a: Box) -> Column:
    return a["xhi"] - a["xlo"]


def height(a: Box) -> Column:
    return a["yhi"] - a["ylo"]


def area(a: Box) -> Column:
    return width(a) * height(a)


def extended_area(a: Box, b: Box) -> Column:
    """The area of the least rectangle around both."""
    return (F.greatest(a["xhi"], b["xhi"]) - F.least(a["xlo"], b["xlo"])) * (F.greatest(a["yhi"], b["yhi"]) - F.least(a["ylo"], b["ylo"]))


def overlap_area(a: Box, b: Box) -> Column:
    x = F.least(a["xhi"], b["xhi"]) - F.greatest(a["xlo"], b["xlo"])
    y = F.least(a["yhi"], b["yhi"]) - F.greatest(a["ylo"], b["ylo"])
    return F.when((x > 0) & (y > 0), x * y).otherwise(F.lit(0) * x)


def ccw(p: Column, q: Column, r: Column) -> Column:
    """Whether p, q, r turn left."""
    return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]) > 0


def cw(p: Column, q: Column, r: Column) -> Column:
    return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]) < 0
