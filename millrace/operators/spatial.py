"""Spatial joins and queries over closed rectangles (columns xlo, ylo, xhi, yhi) and points (x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..flow import Flow
from ..functions import hilbert
from ..session import hinted, partitions, stored
from .ranges import PART, PLACE, Ranges

CORNERS = ("xlo", "ylo", "xhi", "yhi")


def mbr(rects: DataFrame) -> DataFrame:
    """The least rectangle around all."""
    return rects.agg(F.min("xlo").alias("xlo"), F.min("ylo").alias("ylo"), F.max("xhi").alias("xhi"), F.max("yhi").alias("yhi"))


def point_mbr(points: DataFrame) -> DataFrame:
    return points.agg(F.min("x").alias("xlo"), F.min("y").alias("ylo"), F.max("x").alias("xhi"), F.max("y").alias("yhi"))


#: About how many ids of equal rectangles stand in one row at most, and how many rows of rectangles with more are broadcast.
LIST, FEW = 1024, 200_000
#: From so many ids a row on, pairs of rows are dealt anew before they are expanded.
LONG = 4


def _lists(df: DataFrame, id_col: str) -> DataFrame:
    """Equal rectangles as one row with all their ids; where more than LIST are equal, as several rows, dealt by a hash of the id."""
    valid = (F.col("xlo") <= F.col("xhi")) & (F.col("ylo") <= F.col("yhi"))
    rects = df.filter(valid).select(F.col(id_col).alias("id"), *CORNERS)
    many = stored(rects.groupBy(*CORNERS).agg(F.ceil(F.count("*") / LIST).cast("long").alias("lists")).filter("lists > 1"), "many")
    n, part = many.count(), F.lit(0).cast("long")
    if n:
        rects, part = rects.join(hinted(many, FEW, n), list(CORNERS), "left"), F.coalesce(F.pmod(F.xxhash64("id"), "lists"), F.lit(0))
    none = F.array_repeat(F.lit(None).cast(df.schema[id_col].dataType), F.count_if(F.col("id").isNull()).cast("int"))
    dealt = rects.withColumn("list", part).repartition(partitions(df.sparkSession), *CORNERS, "list")
    return stored(dealt.groupBy(*CORNERS, "list").agg(F.concat(F.collect_list("id"), none).alias("ids")), "lists")


def _cell_sizes(a: DataFrame, b: DataFrame) -> tuple[float, float, bool, bool]:
    """Sides of the least grid cells, which hold few of evenly spread rectangles and cover the mean of them, whether they cover all, and whether lists of ids are long."""
    both = a.select(*CORNERS, F.size("ids").alias("ids")).union(b.select(*CORNERS, F.size("ids")))
    w, h = F.col("xhi") - F.col("xlo"), F.col("yhi") - F.col("ylo")
    s = both.agg(F.count("*").alias("n"), F.min("xlo").alias("x0"), F.max("xhi").alias("x1"), F.min("ylo").alias("y0"), F.max("yhi").alias("y1"), F.avg(w).alias("w"), F.avg(h).alias("h"), F.max(w).alias("widest"), F.max(h).alias("highest"), F.sum("ids").alias("ids")).collect()[0]
    if not s.n or None in s:
        return 1.0, 1.0, False, False
    flat = s.x0 == s.x1 or s.y0 == s.y1  # on a line all cells lie along it
    fine = max(1.0, s.n / 8 if flat else (s.n / 8) ** 0.5)
    side = lambda low, high, mean: max(2 * float(mean), (float(high) - float(low)) / fine) or 1.0
    cx, cy = side(s.x0, s.x1, s.w), side(s.y0, s.y1, s.h)
    return cx, cy, float(s.widest) <= cx and float(s.highest) <= cy, s.ids >= LONG * s.n


def overlap_join(red: DataFrame, blue: DataFrame, red_id: str, blue_id: str, names: tuple[str, str] = ("red", "blue"), cell: tuple[float, float] | None = None) -> DataFrame:
    """Pairs of ids of rectangles that meet, touching included, each pair once.

    Grids of doubling cells are laid over the plane. A rectangle has the level of the least cells that are no smaller than itself, so that it covers
    four of them at most, and stands in the cells of its own level and of the coarser ones that occur: a few rows, however large it
    is. Rectangles are joined by level and cell (a hash or merge join, whose skewed cells Spark splits, instead of a nested loop). A
    pair meets at the coarser of its two levels, in the one cell that holds the lower left corner of the intersection.

    Equal rectangles are joined as one, with lists of their ids; where lists are long, pairs of them are dealt to all tasks before they are
    expanded, so that no task makes more than its share of the pairs of ids and a shuffle holds the ids of two lists instead of all pairs.
    """
    kind = blue.schema[blue_id].dataType
    one = red is blue and red_id == blue_id
    red = _lists(red, red_id)
    blue = red if one else _lists(blue, blue_id)
    cx, cy, even, long = _cell_sizes(red, blue)
    if cell:
        (cx, cy), even = cell, False
    ratio = F.greatest((F.col("xhi") - F.col("xlo")) / F.lit(float(cx)), (F.col("yhi") - F.col("ylo")) / F.lit(float(cy)))
    level = F.when(ratio > 1, F.ceil(F.log2(ratio)).cast("int")).otherwise(0)
    marked = [df.withColumn("__level", level) for df in (red, blue)]
    levels = [0] if even else sorted({r[0] for r in marked[0].select("__level").union(marked[1].select("__level")).distinct().collect()})  # one row a power of two
    at = lambda v, size, n: F.floor(v / (F.lit(float(size)) * F.pow(F.lit(2.0), n)))

    def covered(df: DataFrame, tag: str) -> DataFrame:
        up = F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: n >= F.col("__level"))
        span = lambda n, low, high, size: F.sequence(at(F.col(low), size, n), at(F.col(high), size, n))
        cells = F.flatten(F.transform(up, lambda n: F.flatten(F.transform(span(n, "xlo", "xhi", cx), lambda x: F.transform(span(n, "ylo", "yhi", cy), lambda y: F.struct(n.alias("n"), x.alias("cx"), y.alias("cy")))))))
        boxed = df.select(*[F.col(c).alias(f"{tag}_{c}") for c in ("ids", "list", *CORNERS)], F.col("__level").alias(f"{tag}_level"), F.explode(cells).alias("cell"))
        return boxed.select("*", "cell.n", "cell.cx", "cell.cy").drop("cell")

    if not levels:
        return red.filter(F.lit(False)).select(F.col("ids")[0].alias(names[0]), F.lit(None).cast(kind).alias(names[1]))
    r, b = covered(marked[0], "r"), covered(marked[1], "b")
    meet = (F.col("r_xlo") <= F.col("b_xhi")) & (F.col("b_xlo") <= F.col("r_xhi")) & (F.col("r_ylo") <= F.col("b_yhi")) & (F.col("b_ylo") <= F.col("r_yhi"))
    here = (at(F.greatest("r_xlo", "b_xlo"), cx, F.col("n")) == F.col("cx")) & (at(F.greatest("r_ylo", "b_ylo"), cy, F.col("n")) == F.col("cy"))
    met = r.join(b, ["n", "cx", "cy"]).filter((F.greatest("r_level", "b_level") == F.col("n")) & meet & here)
    lists = [f"{tag}_{c}" for tag in "rb" for c in ("list", *CORNERS)]
    met = met.select("r_ids", "b_ids", *lists)
    if long:
        met = met.repartition(partitions(met.sparkSession), *lists)
    return met.select(F.explode("r_ids").alias(names[0]), "b_ids").select(names[0], F.explode("b_ids").alias(names[1]))


def interval_join(a: DataFrame, b: DataFrame, a_id: str, b_id: str, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Pairs of closed intervals (lo, hi) that meet: the same on a line."""
    flat = lambda df: df.withColumns({"xlo": F.col("lo"), "xhi": F.col("hi"), "ylo": F.lit(0), "yhi": F.lit(0)})
    x = flat(a)
    return overlap_join(x, x if a is b else flat(b), a_id, b_id, names)


def window_query(points: DataFrame, x: tuple, y: tuple) -> DataFrame:
    """Points within a closed box; bounds in the wrong order are swapped."""
    return points.filter(F.col("x").between(min(x), max(x)) & F.col("y").between(min(y), max(y)))


def three_sided_query(points: DataFrame, x: tuple, y_top) -> DataFrame:
    return points.filter(F.col("x").between(min(x), max(x)) & (F.col("y") <= y_top))


def rect_query(rects: DataFrame, box: tuple) -> DataFrame:
    """Rectangles that meet a query rectangle (xlo, ylo, xhi, yhi)."""
    xlo, ylo, xhi, yhi = box
    return rects.filter((F.col("xlo") <= xhi) & (F.col("xhi") >= xlo) & (F.col("ylo") <= yhi) & (F.col("yhi") >= ylo))


def batch_window_query(points: DataFrame, boxes: DataFrame, point_id: str, box_id: str) -> DataFrame:
    """Pairs (box, point) of a table of boxes; points are rectangles without extent."""
    dots = points.withColumns({"xlo": F.col("x"), "xhi": F.col("x"), "ylo": F.col("y"), "yhi": F.col("y")})
    return overlap_join(boxes, dots, box_id, point_id, ("box", "point"))


def nearest_points(points: DataFrame, x, y, k: int) -> DataFrame:
    """The k points nearest to (x, y)."""
    d = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return points.withColumn("distance2", d).orderBy("distance2", *[c for c in points.columns if c not in ("x", "y")]).limit(k)


def pack(rects: DataFrame, id_col: str, fanout: int, side: int = 1 << 15) -> tuple[DataFrame, list[DataFrame]]:
    """Hilbert packing of an R-tree: the leaves' rectangles with pos and node, and for each level (node, count, bounding rectangle).

    Centres are scaled to a side x side grid; the order is by Hilbert value, then id.
    """
    b = mbr(rects).collect()[0]
    if b.xlo is None:
        return rects.withColumns({"hilbert": F.lit(None).cast("long"), "pos": F.lit(None).cast("long"), "node": F.lit(None).cast("long")}), []
    grid = lambda lo, hi, low, high: F.floor(((F.col(lo) + F.col(hi)) / 2 - float(low)) * ((side - 1) / max(float(high) - float(low), 1e-300)))
    df = rects.withColumn("hilbert", hilbert(grid("xlo", "xhi", b.xlo, b.xhi), grid("ylo", "yhi", b.ylo, b.yhi), side))
    r = Ranges(Flow(df, ("hilbert", id_col))).position("pos")
    leaves = r.df.withColumn("node", F.floor(F.col("pos") / fanout)).drop(PART, PLACE)
    levels, level, n = [], leaves, r.total()
    while True:
        level = level.groupBy("node").agg(F.count("*").alias("count"), F.min("xlo").alias("xlo"), F.min("ylo").alias("ylo"), F.max("xhi").alias("xhi"), F.max("yhi").alias("yhi"))
        levels.append(level)
        n = -(-n // fanout)
        if n <= 1:
            return leaves, levels
        level = level.withColumn("node", F.floor(F.col("node") / fanout))


def tree_stats(levels: list[DataFrame]) -> DataFrame:
    """Per level of a packed tree: nodes, entries, and the area covered."""
    out = None
    for i, level in enumerate(levels):
        row = level.agg(F.lit(i).alias("level"), F.count("*").alias("nodes"), F.sum("count").alias("entries"), F.sum((F.col("xhi") - F.col("xlo")) * (F.col("yhi") - F.col("ylo"))).alias("area"))
        out = row if out is None else out.union(row)
    return out


def z_layout(points: DataFrame, path: str, parts: int, side: int = 1 << 15) -> DataFrame:
    """Write points so that files are compact in space (ranges of Hilbert values): box queries then skip files by statistics."""
    b = point_mbr(points).collect()[0]
    grid = lambda c, low, high: F.floor((F.col(c) - float(low)) * ((side - 1) / max(float(high) - float(low), 1e-300)))
    key: Column = hilbert(grid("x", b.xlo, b.xhi), grid("y", b.ylo, b.yhi), side)
    points.repartitionByRange(parts, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return points.sparkSession.read.schema(points.schema).parquet(path)
