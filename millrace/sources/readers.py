"""Sources: tables, ranges, items in memory, and text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..flow import Flow, Pipe, begin


def parquet(spark: SparkSession, path: str, *order: str, schema: StructType | str | None = None, start: tuple[str, object] | None = None, reverse: bool = False) -> Pipe:
    """A table. With `start` (column, value), from that place on; with `reverse`, back to front."""

    def make() -> Flow:
        df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
        if start:
            df = df.filter(F.col(start[0]) <= F.lit(start[1]) if reverse else F.col(start[0]) >= F.lit(start[1]))
        flow = Flow(df, order)
        return flow.with_df(df, tuple(c[1:] if c.startswith("-") else f"-{c}" for c in order)) if reverse else flow

    return begin(make, f"input {path}")


#: Items of any length and nesting are stored alike.
serialized = parquet


def from_items(spark: SparkSession, items: Iterable, schema: str = "v long") -> Pipe:
    """Items of a Python iterable in their order; the number of items is forwarded."""

    def make() -> Flow:
        rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(items)]
        return Flow(spark.createDataFrame(rows, f"pos long, {schema}"), ("pos",)).forward("items", len(rows))

    return begin(make, "input_vector")


def zero(spark: SparkSession, schema: str) -> Pipe:
    """No items."""
    return begin(lambda: Flow(spark.createDataFrame([], schema), tuple(StructType.fromDDL(schema).names[:1])).forward("items", 0), "zero_source")


def integer_range(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "i") -> Pipe:
    """start, start + step, ... below stop; empty where start >= stop. The step must be positive."""
    if step <= 0:
        raise ValueError("the step must be positive")
    return begin(lambda: Flow(spark.range(start, max(start, stop), step).withColumnRenamed("id", name), (name,)).forward("items", max(0, -(-(stop - start) // step))), "range")


def text_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of text files with their place (file, nth): places grow along a file but have gaps between splits."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("line"))


def scan_ints(spark: SparkSession, path: str) -> Flow:
    """Integers of a text, separated by white space, up to the first token that is none."""
    token = text_lines(spark, path).select("file", "nth", F.posexplode(F.split("line", r"\s+")).alias("at", "token")).filter("token <> ''")
    df = token.withColumn("v", F.expr("try_cast(token as bigint)"))
    bad = df.filter("v is null").orderBy("nth", "at").limit(1).select(F.col("nth").alias("__n"), F.col("at").alias("__a")).collect()
    if bad:
        df = df.filter(F.struct("nth", "at") < F.struct(F.lit(bad[0][0]).alias("nth"), F.lit(bad[0][1]).alias("at")))
    return Flow(df.select("nth", "at", "v"), ("nth", "at"))


def _columns(spark: SparkSession, path: str, names: list[str], kind: str) -> DataFrame:
    parts = F.split(F.trim("line"), r"\s+")
    return text_lines(spark, path).filter(F.trim("line") != "").select("nth", *[F.get(parts, i).cast(kind).alias(n) for i, n in enumerate(names)])


def points_text(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """Lines 'x y'."""
    return _columns(spark, path, ["x", "y"], kind)


def rectangles_text(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """Lines 'id x1 y1 x2 y2'; corners are put in order."""
    df = _columns(spark, path, ["id", "x1", "y1", "x2", "y2"], kind)
    return df.select(F.col("id").cast("long").alias("id"), F.least("x1", "x2").alias("xlo"), F.least("y1", "y2").alias("ylo"), F.greatest("x1", "x2").alias("xhi"), F.greatest("y1", "y2").alias("yhi"))


def random_points(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    return spark.range(n).select("id", F.rand(seed).alias("x"), F.rand(seed + 1).alias("y"))


def random_ints(spark: SparkSession, n: int, below: int, seed: int = 42) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.floor(F.rand(seed) * below).alias("v"))


# Fixed values of the linked-list generator: head, step and modulus (a power of two).
LIST_HEAD, LIST_STEP, LIST_BITS = 17, 903584919, 30


def linked_list(spark: SparkSession, n: int, head: int = LIST_HEAD, step: int = LIST_STEP, bits: int = LIST_BITS) -> DataFrame:
    """A pseudo-random linked list of n edges of weight 1: the i-th node is (head + i * step) modulo 2**bits."""
    node = lambda i: F.pmod(F.lit(head) + (i * (step % (1 << bits))), F.lit(1 << bits))
    i = F.col("id") % (1 << bits)
    return spark.range(n).select(node(i).alias("src"), node(i + 1).alias("dst"), F.lit(1).cast("long").alias("weight"))
