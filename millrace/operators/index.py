"""An ordered index: a table laid out by ranges of its key, with bounds, ranges, ranks, updates, and batch lookups.

Parquet's min and max statistics do what inner nodes of a tree do: point and range lookups read only the files that can match.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..flow import Flow
from ..session import partitions
from .ranges import PART, PLACE, Ranges


@dataclass(frozen=True)
class SortedIndex:
    """Rows by a key. Duplicate keys are allowed, as in a multiset; an index is a value, updates give a new one."""

    df: DataFrame
    key: str
    metadata: dict[str, Any] = field(default_factory=dict)

    def _with(self, df: DataFrame) -> SortedIndex:
        return replace(self, df=df)

    def with_metadata(self, **values: Any) -> SortedIndex:
        """The index with values of its own beside the rows; they go along with updates."""
        return replace(self, metadata={**self.metadata, **values})

    def size(self) -> int:
        return self.df.count()

    def empty(self) -> bool:
        return self.df.isEmpty()

    # building and storing
    def write(self, path: str, codec: str = "snappy") -> SortedIndex:
        """Bulk load: files are disjoint ranges of the key, sorted within."""
        n = partitions(self.df.sparkSession)
        self.df.repartitionByRange(n, self.key).sortWithinPartitions(self.key).write.mode("overwrite").option("compression", codec).parquet(path)
        return self._with(self.df.sparkSession.read.schema(self.df.schema).parquet(path))

    # lookups
    def find(self, k) -> DataFrame:
        return self.df.filter(F.col(self.key) == F.lit(k)).limit(1)

    def lower_bound(self, k) -> DataFrame:
        """The first row with a key of k or more."""
        return self.df.filter(F.col(self.key) >= F.lit(k)).orderBy(self.key).limit(1)

    def upper_bound(self, k) -> DataFrame:
        """The first row with a key beyond k."""
        return self.df.filter(F.col(self.key) > F.lit(k)).orderBy(self.key).limit(1)

    def predecessor(self, k) -> DataFrame:
        return self.df.filter(F.col(self.key) < F.lit(k)).orderBy(F.col(self.key).desc()).limit(1)

    def range(self, low, high, where: Column | None = None) -> DataFrame:
        """Rows with keys from low to high, both included; bounds in the wrong order are swapped."""
        low, high = min(low, high), max(low, high)
        df = self.df.filter(F.col(self.key).between(F.lit(low), F.lit(high)))
        return df if where is None else df.filter(where)

    def iterate(self, reverse: bool = False) -> DataFrame:
        return self.df.orderBy(F.col(self.key).desc() if reverse else F.col(self.key).asc())

    # updates
    def insert(self, rows: DataFrame) -> SortedIndex:
        return self._with(self.df.unionByName(rows))

    def insert_unique(self, rows: DataFrame) -> SortedIndex:
        """Insert rows whose keys aren't there yet."""
        return self._with(self.df.unionByName(rows.join(self.df.select(self.key), self.key, "left_anti").select(*self.df.columns)))

    def erase(self, *keys) -> SortedIndex:
        """Without the rows of these keys, all of each."""
        return self._with(self.df.filter(~F.coalesce(F.col(self.key).isin(*keys), F.lit(False))))

    def erase_rows(self, rows: DataFrame) -> SortedIndex:
        return self._with(self.df.join(rows.select(self.key), self.key, "left_anti").select(*self.df.columns))

    def erase_counted(self, *keys) -> tuple[SortedIndex, int]:
        """Without the rows of these keys, and how many went."""
        gone = self.df.filter(F.col(self.key).isin(*keys)).count()
        return self.erase(*keys), gone

    def erase_one(self, k, *tie: str) -> SortedIndex:
        """Without one row of a key: the first by the columns `tie` (which tell its rows apart), as an iterator points at one."""
        one = self.df.filter(F.col(self.key) == F.lit(k)).orderBy(*tie).limit(1).select(self.key, *tie)
        same = F.lit(True)
        for c in (self.key, *tie):
            same &= self.df[c].eqNullSafe(one[c])
        return self._with(self.df.join(F.broadcast(one), same, "left_anti"))

    def upsert(self, rows: DataFrame) -> SortedIndex:
        """Rows replace those of equal keys, others are added."""
        kept = self.df.join(rows.select(self.key), self.key, "left_anti").select(*self.df.columns)
        return self._with(kept.unionByName(rows.select(*self.df.columns)))

    # aggregates
    def ranks(self, total: Column, *tie: str) -> DataFrame:
        """Each row with rank (rows before it) and prefix (their sum of `total`)."""
        return Ranges(Flow(self.df, (self.key, *tie))).position("rank").running("prefix", total).df.drop(PART, PLACE)

    def levels(self, fanout: int, *aggregates: Column) -> list[DataFrame]:
        """Augmented levels from the leaves up, fanout items a node: (node, min_key, count, aggregates)."""
        r = Ranges(Flow(self.df, (self.key,))).position("__pos")
        df, out, width, n = r.df, [], fanout, r.total()
        while True:
            out.append(df.groupBy(F.floor(F.col("__pos") / width).alias("node")).agg(F.min(self.key).alias("min_key"), F.count("*").alias("count"), *aggregates))
            if width >= n:
                return out
            width *= fanout

    # batch lookups
    def successors(self, probes: DataFrame, probe: str, name: str = "bound", strict: bool = False) -> DataFrame:
        """Each probe with the least key of at least it (or beyond it, if strict); null where there is none. See `nearest`."""
        return nearest(probes, probe, self.df, self.key, name, after=True, strict=strict)

    def predecessors(self, probes: DataFrame, probe: str, name: str = "bound", strict: bool = False) -> DataFrame:
        return nearest(probes, probe, self.df, self.key, name, after=False, strict=strict)


def nearest(probes: DataFrame, probe: str, keys: DataFrame, key: str, name: str, after: bool, strict: bool = False, by: list[tuple[str, str]] | None = None) -> DataFrame:
    """As-of join: each probe row with the nearest key after (or before) it, equal keys included unless strict; null where there is none.

    With `by` (pairs of probe and key columns, nulls being equal) only keys of the probe's group count. Probes and distinct keys are
    sorted together once, by group and value; ranges of that order are scanned by tasks of their own and the last key is carried on from
    range to range, so that a group of any size is spread over its ranges.
    """
    by = by or []
    groups = [f"__g{i}" for i in range(len(by))]
    row = F.struct(*[F.col(f"`{c}`") for c in probes.columns])
    # at equal values: keys come before a probe unless strict
    last = 0 if strict else 1
    k = keys.select(*[F.col(b).alias(g) for (_, b), g in zip(by, groups)], F.col(key).alias("__x")).filter("__x is not null").distinct()
    k = k.select(*groups, "__x", F.lit(1 - last).alias("__side"), F.lit(None).cast(probes.select(row.alias("r")).schema["r"].dataType).alias("__row"), F.struct(*groups, "__x").alias("__key"))
    p = probes.select(*[F.col(a).alias(g) for (a, _), g in zip(by, groups)], F.col(probe).alias("__x"), F.lit(last).alias("__side"), row.alias("__row"), F.lit(None).cast(k.schema["__key"].dataType).alias("__key"))
    order = (*groups, "-__x" if after else "__x", "__side")
    done = Ranges(Flow(p.unionByName(k), order)).filled("__hit", "__key").df.filter("__row is not null")
    fits = F.col("__x").isNotNull()
    for g in groups:
        fits &= F.col(g).eqNullSafe(F.col("__hit")[g])
    return done.select("__row.*", F.when(fits, F.col("__hit")["__x"]).alias(name))
