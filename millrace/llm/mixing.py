"""Mixing sources to target weights by a time-varying curriculum.

Each source has a share of all words and a weight schedule over training time 0 to 1. The integral of the schedule, scaled
to the source's target, is its cumulative token demand; a document that begins after c words of its source's stream is
read when the demand reaches c: at the inverse of the integral. Streams are the source's documents in the order of a hash
of their ids, repeated while demand lasts. Sorting all copies by position, by range, gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, stored, words

#: Times a source, and so a document, is repeated at most.
MOST_REPEATS = 3
#: Rows a bucket of a source's stream has about; a bucket is ordered in one task.
BUCKET_ROWS = 20_000
#: Rows of the table of sources or buckets up to which it is broadcast.
MOST_BROADCAST = 100_000
#: Relative demand at the start and the end of training, falling or rising evenly, by place in the cycle of weights.
SLOPES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) with weight, target and place added; a row a source.

    Sources in code-point order, null last, weigh in a repeating cycle and share the sum of all sizes. A target stops at `most` times its
    source's size, what is over is shared anew by weight: the level L at which the sum of min(most * size, L * weight) is the total.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    df = sizes.withColumn("place", F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int"))
    df = df.withColumns({"weight": F.get(cycle, F.col("place")).cast("double"), "cap": (most * F.col("source_size")).cast("double")})
    filled = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    upto = filled.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"total": F.sum("source_size").over(every), "capped": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)), "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))})
    # the level if exactly the sources before this one are capped; right is the first that doesn't exceed its own cap, and the greatest of those
    df = df.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    df = df.withColumn("right", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every))
    return df.select("source", "source_size", "place", F.least("cap", F.coalesce("right", F.lit(0.0)) * F.col("weight")).alias("target"))


def _position(share: Column, place: Column) -> Column:
    """Training time at which a source's demand reaches a share of its target: the inverse of the integral of a linear schedule.

    With demand a at the start and b at the end (mean 1), the integral to t is a t + (b - a) t^2 / 2.
    """
    a = F.get(F.array(*[F.lit(x) for x, _ in SLOPES]), place)
    b = F.get(F.array(*[F.lit(y) for _, y in SLOPES]), place)
    root = F.sqrt(F.greatest(a * a + 2 * (b - a) * share, F.lit(0.0)))
    return 2 * share / (a + root)  # the root that also holds where b = a


def plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = MOST_REPEATS, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and position (of its first copy; null if not taken), plus `keep`.

    size is the words of the whole text; taken the words the mix takes: whole copies, and of one document a source the part up
    to the target. Offsets in a stream are exact prefix sums: buckets of the hash order are summed (pre-aggregated), prefix sums run over
    buckets, and within a bucket in one task; a source of any size is spread over its buckets. Rows of equal id and text are
    copies of their own; null ids, texts and sources take part (null text: size 0, taken 0). Kept columns that clash are refused.
    """
    if set(keep) & {"doc_id", "source", "size", "draw", "tie", "bucket", "upto", "before", "source_size", "place", "target", "taken", "position", "start"}:
        raise ValueError("a kept column has the name of one that the plan makes; pack it into a struct as `mixed` does")
    full = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), F.size(words(docs[text_col])).cast("long").alias("size"), F.md5(F.coalesce(docs[id_col].cast("string"), F.lit(""))).alias("draw"), F.crc32(F.coalesce(docs[text_col], F.lit(""))).alias("tie"), *keep)
    rows = stored(full.drop(*keep), "sizes")
    sources = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    n = rows.count()
    digits = 0
    while n > BUCKET_ROWS * 16**digits:
        digits += 1
    bucket = F.substring("draw", 1, digits)
    buckets = rows.withColumn("bucket", bucket).groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    buckets = buckets.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "before", "source_size", "place", "target")
    buckets = stored(buckets, "buckets")
    local = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (full if keep else rows).withColumn("bucket", bucket).withColumn("upto", F.sum("size").over(local)).join(hinted(buckets, MOST_BROADCAST), F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    start = F.col("before") + F.col("upto") - F.col("size")
    goal = F.round("target").cast("long")
    taken = sum((F.least(F.greatest(goal - p * F.col("source_size") - start, F.lit(0)), F.col("size")) for p in range(most)), F.lit(0).cast("long"))
    position = F.when(taken > 0, _position(start / F.greatest(goal, F.lit(1)), F.col("place")))
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), position.alias("position"), start.alias("start"), "place", *keep)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = MOST_REPEATS) -> DataFrame:
    """The documents in training order, each as often as the mix reads it; own columns only.

    Every copy that the mix begins is whole, the last of a source's stream too. Copies are dealt and sorted by ranges of their
    positions, so that files in order are the training order.
    """
    names = docs.columns
    held = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in names]))
    made = plan(held, weights, most, keep=("_row",))
    goal = F.round("target").cast("long")
    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: F.col("start") + p * F.col("source_size")), lambda c: (c < goal) & (F.col("taken") > 0))
    each = made.withColumn("_c", F.explode(copies))
    each = each.withColumn("_t", _position(F.col("_c") / F.greatest(goal, F.lit(1)), F.col("place")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartitionByRange(parts, "_t", "doc_id").sortWithinPartitions("_t", "doc_id").select(*[F.col("_row")[c].alias(c) for c in names])


def report(docs: DataFrame) -> DataFrame:
    """One row a document, in the order of the documents' first positions."""
    made = plan(docs).select("doc_id", "size", "source_size", "target", "taken", "position")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return made.repartitionByRange(parts, "position", "doc_id").sortWithinPartitions("position", "doc_id")
