"""Connected components and list ranking, by rounds of joins; nothing that grows with the input gathers in one task or on the driver."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each component, for all nodes with an edge to another.

    Every node takes the least label of itself and its neighbours, labels are followed to their roots by pointer jumping, and edges are
    contracted to those between different roots, until none is left: a logarithmic number of rounds, each written out.
    """
    labels = None
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    while True:
        edges = stored(edges, "edges")
        if edges.isEmpty():
            break
        two = edges.union(edges.select("b", "a"))
        least = two.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        least = stored(least, "least")
        while True:  # labels fall along each chain, so this ends
            up = least.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = least.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("next") < F.col("root")).alias("moved"))
            jumped = stored(jumped, "jumped")
            least = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = least
        else:
            up = least.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = labels.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        labels = stored(labels, "labels")
        x = edges.join(least.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(least.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = x.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


class DisjointSets:
    """Sets of members under unions: make_set, union_set, find_set and count_sets over DataFrames. A set's name is its least member."""

    def __init__(self, members: DataFrame, column: str):
        self.members = members.select(F.col(column).alias("node")).distinct()
        self.edges: DataFrame | None = None

    def union_set(self, edges: DataFrame, a: str, b: str) -> DisjointSets:
        more = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        self.edges = more if self.edges is None else self.edges.union(more)
        return self

    def find_set(self) -> DataFrame:
        """(node, root) for every member."""
        if self.edges is None:
            return self.members.withColumn("root", F.col("node"))
        return self.members.join(connected(self.edges), "node", "left").withColumn("root", F.coalesce("root", "node"))

    def count_sets(self) -> int:
        return self.find_set().select("root").distinct().count()


#: Edges that are ranked on the driver: so many at most, whatever the input.
FEW_EDGES = 50_000


def list_rank(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """(src, dst, weight, rank) of the edges of linked lists: rank is the sum of weights from the head up to and with the edge.

    Contraction: in a round each edge goes to one of its two nodes, that of the lesser hash (at either end of a list, to the inner one); where
    a node got both its edges they become one. About a third of a long list's edges goes in each round and lists of one edge leave, so all rounds
    together shuffle and write a few times the edges. What is left is ranked on the driver once it is few, then each round's edges
    get what lies before them, last round first. A node has one edge in and one out at most; cycles have no head and are refused.
    """
    spark = edges.sparkSession
    given = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(weight).alias("weight"))
    kind, node = given.schema["weight"].dataType, given.schema["src"].dataType
    total = T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else T.LongType() if isinstance(kind, T.IntegralType) else kind
    known = given.filter("src is not null")  # a null is no node
    ends = given.join(known.select(F.col("dst").alias("src"), F.lit(True).alias("in")), "src", "left").join(known.select(F.col("src").alias("dst"), F.lit(True).alias("out")), "dst", "left")
    first = stored(ends.select("src", "dst", "weight", F.col("in").isNull().alias("head"), (F.col("out").isNull() | F.col("src").isNull()).alias("tail")), "rank")
    rounds, table = [], first.withColumn("weight", F.col("weight").cast(total))
    while True:
        now = table.filter("not (head and tail)")
        n, cycles = now.agg(F.count("*"), F.count_if(F.col("src") == F.col("dst"))).collect()[0]
        if cycles:
            raise ValueError("the edges hold a cycle")
        if n <= FEW_EDGES:
            break
        h = lambda c: F.xxhash64(c, F.lit(len(rounds)))  # noqa: B023, E731
        at = F.when(F.col("head"), F.col("dst")).when(F.col("tail") | (h("src") < h("dst")), F.col("src")).otherwise(F.col("dst"))
        to, off = F.col("dst") == F.col("node"), F.coalesce(F.col("src") == F.col("node"), F.lit(False))
        to = F.coalesce(to, F.lit(False))
        side = lambda which, *columns: [F.max(F.when(which, F.col(c))).alias(f"{'e' if which is to else 'f'}_{c}") for c in columns]  # noqa: B023, E731
        met = now.withColumn("node", at).groupBy("node").agg(F.count_if(to).alias("to"), F.count_if(off).alias("off"), *side(to, "src", "weight", "head", "tail"), *side(off, "dst", "weight", "head", "tail"))
        both, only = F.col("to") + F.col("off") > 1, F.col("to") > 0
        either = lambda e, f: F.when(only, e).otherwise(f)  # noqa: B023, E731
        merged = met.select(
            either(F.col("e_src"), F.col("node")).alias("src"),
            F.when(F.col("off") > 0, F.col("f_dst")).otherwise(F.col("node")).alias("dst"),
            F.when(both, F.col("e_weight") + F.col("f_weight")).otherwise(either(F.col("e_weight"), F.col("f_weight"))).cast(total).alias("weight"),
            either(F.col("e_head"), F.col("f_head")).alias("head"),
            F.when(F.col("off") > 0, F.col("f_tail")).otherwise(F.col("e_tail")).alias("tail"),
            F.when(both, F.col("node")).alias("mid"),
            F.when(both, F.col("e_weight")).alias("more"),
        )
        table = stored(merged, "rank")
        rounds.append(table)
    follows, before = {r.src: r for r in now.collect()}, {}
    for r in [r for r in follows.values() if r.head]:
        sofar = 0
        while r is not None:
            before[r.src] = sofar
            sofar = None if sofar is None or r.weight is None else sofar + r.weight
            r = follows.get(r.dst)
    if len(before) < len(follows):
        raise ValueError("the edges hold a cycle")
    zero = {T.DecimalType: Decimal, T.DoubleType: float, T.FloatType: float}.get(type(total), int)
    schema = T.StructType([T.StructField("src", node), T.StructField("before", total)])
    offsets = spark.createDataFrame([(k, None if v is None else zero(v)) for k, v in before.items()], schema)
    for table in reversed(rounds):
        alone = table.filter("head and tail").select("src", F.lit(0).cast(total).alias("before"))
        mids = table.filter("mid is not null").select("src", "mid", "more")
        whole = offsets.unionByName(alone).join(mids, "src", "left")
        two = F.array(F.struct("src", "before"), F.struct(F.col("mid").alias("src"), (F.col("before") + F.col("more")).cast(total).alias("before")))
        offsets = whole.select(F.explode(F.when(F.col("mid").isNull(), F.slice(two, 1, 1)).otherwise(two)).alias("x")).select("x.src", "x.before")
    rest = first.filter("not (head and tail)").join(offsets, "src").select("src", "dst", "weight", (F.col("before") + F.col("weight")).cast(kind if total == T.LongType() else total).alias("rank"))
    return rest.unionByName(first.filter("head and tail").select("src", "dst", "weight", F.col("weight").cast(kind if total == T.LongType() else total).alias("rank")))
