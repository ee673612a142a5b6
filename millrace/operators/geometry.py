"""Convex hulls, and tables of geometries with typed fields."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import partitions, stored

#: Points below which one task makes the last hull.
SMALL = 50_000


def hull_of(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of rows (x, y), counter-clockwise from the leftmost; no corner lies on a line between others."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p
    rows = p.tolist()

    def half(seq: list) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    low, high = half(rows), half(rows[::-1])
    return np.array(low[:-1] + high[:-1], dtype=points.dtype)


def convex_hull(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(x, y, pos) of the hull's corners, counter-clockwise from the leftmost (of those the lowest). Rows with a null don't count.

    The hull of a union is the hull of the hulls' union: every partition gives its hull, these are dealt to fewer tasks until few
    points are left, and one task makes the last.
    """
    df = points.select(F.col(x).alias("x"), F.col(y).alias("y")).filter("x is not null and y is not null")
    schema = df.schema

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            pts = b[["x", "y"]].to_numpy()
            held = hull_of(pts if held is None else np.concatenate([held, pts]))
        if held is not None and len(held):
            yield pd.DataFrame(held, columns=["x", "y"])

    hulls = stored(df.mapInPandas(local, schema), "hulls")
    parts, n = partitions(df.sparkSession), hulls.count()
    while n > SMALL and parts > 1:
        parts = max(1, parts // 4)
        again = stored(hulls.repartition(parts).mapInPandas(local, schema), "hulls")
        if (m := again.count()) > n // 2 and parts == 1:
            hulls = again
            break
        hulls, n = again, m

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull_of(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame(h, columns=["x", "y"]).assign(pos=np.arange(len(h)))

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return hulls.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(last, f"{kind}, pos long")


#: A table of geometries: the kind, typed fields (one arm of each is set), and parts of rings of points.
GEOMETRY = "kind int, fields array<struct<type:string,int:int,float:float,double:double,string:string,long:long>>, coords array<array<array<struct<x:double,y:double,z:float>>>>"


def kinds(geometries: DataFrame) -> DataFrame:
    """How many geometries of each kind."""
    return geometries.groupBy("kind").agg(F.count("*").alias("count"))


def geometry_mbr(geometries: DataFrame) -> DataFrame:
    """The least rectangle around all points of all geometries."""
    p = geometries.select(F.explode(F.flatten(F.flatten("coords"))).alias("p"))
    return p.agg(F.min("p.x").alias("xlo"), F.min("p.y").alias("ylo"), F.max("p.x").alias("xhi"), F.max("p.y").alias("yhi"))


def field_values(geometries: DataFrame) -> DataFrame:
    """Every field as text, with its geometry's kind, its place and its type."""
    f = geometries.select("kind", F.posexplode("fields").alias("place", "f"))
    return f.select("kind", "place", F.col("f.type").alias("type"), F.coalesce(*[F.col(f"f.{c}").cast("string") for c in ("int", "long", "float", "double", "string")]).alias("value"))
