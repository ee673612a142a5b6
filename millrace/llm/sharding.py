"""Sharding by sampled splitters, so that shards hold near equal bytes and equal texts stay together.

Documents are ordered by a hash of their text, then by id. A size-weighted sample of keys gives splitters that cut the order
into many narrow ranges; a key that covers a whole quantile (a large group of equal texts) gets a range of its own. Ranges
that turn out overfull are subdivided by a hash of the id. Exact byte counts of the ranges then place every document:
cumulative bytes decide the shard. A group of equal texts goes by its middle and so stays whole unless it is large
against a shard.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS = 16
#: Narrow ranges a shard: what is ordered in one task, and from which share of all bytes on a group of equal texts is divided.
RANGES = 16
#: Rows the sample has about for each range (a documented bound: it only places splitters; every count is exact).
DRAWS = 64


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1; null text: 1), text_crc32, and the key: a 64-bit hash of the text."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))


def splitters(rows: DataFrame, total: int, parts: int) -> tuple[list[int], list[int]]:
    """Distinct splitters of the key at equal shares of bytes, and those of them that span a share or more, from a size-weighted sample."""
    unit = max(1, total // (DRAWS * parts))
    # a row is drawn size / unit times on average: the whole part, and once more as a hash of id and key has it
    draws = F.floor((F.col("size") + F.pmod(F.xxhash64("doc_id", "key", F.lit(7)), F.lit(unit))) / unit).cast("long")
    drawn = rows.select("key", draws.alias("weight")).filter("weight > 0").groupBy("key").agg(F.sum("weight").alias("weight")).orderBy("key").collect()
    share, upto, cuts, heavy = sum(r.weight for r in drawn) / parts, 0, [], []
    for r in drawn:
        if r.weight >= share:
            heavy.append(r.key)
        if (upto + r.weight) // share > upto // share or r.weight >= share:
            cuts.append(r.key)
        upto += r.weight
    return cuts, heavy


def _below(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are below the key: first by whole blocks, then within one."""
    if not cuts:
        return F.lit(0)
    size = max(1, int(len(cuts) ** 0.5))
    blocks = F.size(F.filter(F.array(*map(F.lit, cuts[size - 1 :: size])), lambda c: c < key))
    return size * blocks + F.size(F.filter(F.slice(F.array(*map(F.lit, cuts)), size * blocks + 1, size), lambda c: c < key))


def _range_of(key: Column, cuts: list[int], heavy: list[int]) -> Column:
    """Twice the number of splitters below the key; one more for a heavy key itself."""
    return 2 * _below(key, cuts) + (key.isin(heavy).cast("int") if heavy else F.lit(0))


def by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in its shard), grown_shard (null).

    Texts are read once, for a slim table that all later steps use; what is ordered in one task is a narrow range, subdivided where
    overfull. The driver gets a bounded sample and one row a range. Repeated rows get slots of their own; null ids are documents
    too; null and empty texts are equal texts of size 1. Nothing depends on the session's settings: the same rows and parameters give the same shards.
    """
    spark = docs.sparkSession
    rows = stored(slim(docs, id_col, text_col), "sizes")
    total = rows.agg(F.sum("size")).collect()[0][0] or 0
    parts = shards * ranges
    cuts, heavy = splitters(rows, total, parts) if total else ([], [])
    ranged = rows.withColumn("range", _range_of(F.col("key"), cuts, heavy))
    share = max(1, total // parts)
    loads = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > 3 * share).collect()
    full = spark.createDataFrame([(r.range, 2 * -(-r.bytes // share)) for r in loads], "range int, pieces long")
    own = {2 * bisect_left(cuts, k) + 1 for k in heavy}
    spread = F.when(F.col("range").isin(sorted(own)), F.xxhash64("doc_id", "text_crc32")).otherwise(F.xxhash64("key"))
    ranged = ranged.join(F.broadcast(full), "range", "left").withColumn("piece", F.coalesce(F.pmod(spread, F.col("pieces")), F.lit(0)).cast("int")).drop("pieces")
    offsets, bytes_at, rows_at = [], 0, 0
    for r in ranged.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("range", "piece").collect():
        offsets.append((r.range, r.piece, bytes_at, rows_at))
        bytes_at, rows_at = bytes_at + r.bytes, rows_at + r.n
    table = F.broadcast(spark.createDataFrame(offsets, "range int, piece int, bytes_at long, rows_at long"))
    local = Window.partitionBy("range", "piece").orderBy("key", "doc_id", "text_crc32")
    same = Window.partitionBy("range", "piece", "key")
    placed = ranged.join(table, ["range", "piece"]).withColumns({"nth": F.row_number().over(local), "before": F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")})
    placed = placed.withColumns({"group_at": F.min("before").over(same), "group_bytes": F.sum("size").over(same)})
    alone = F.col("range").isin(sorted(own))
    middle = F.col("bytes_at") + F.when(alone, F.col("before") + F.col("size") / 2).otherwise(F.col("group_at") + F.col("group_bytes") / 2)
    placed = placed.select("doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(middle * shards / max(total, 1))).cast("int").alias("shard"), (F.col("rows_at") + F.col("nth") - 1).alias("nth"))
    placed = stored(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
