"""One query an operator over the shared tables, beside the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..flow import Flow, begin, chunk_if, middle, parallel
from ..operators import aggregate, combine, containers, geometry, graph, index, mapping, matrix, ordering, permute, scan, spatial
from ..operators.ranges import positioned
from ..session import stored
from ..sources import range_source, to_vector
from ..sources.readers import linked_list

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The total order of lineitem (its first two columns alone repeat).
LINES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_BY = ", ".join(LINES)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flow(spark: SparkSession, sf_dir: str, name: str, *order: str) -> Flow:
    return Flow(_t(spark, sf_dir, name), order)


def _long(*columns: str) -> list[Column]:
    return [F.col(c).cast("long").alias(c) for c in columns]


# -- sources, sinks, per-item operators --------------------------------------------------------


@query("select range as i from range(0, 100000, 3)")
def range_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_source(spark, 0, 100_000, 3)().df


@query("select o_orderkey, (o_orderkey * 3 + 7)::bigint as y from orders")
def map_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = mapping.linear("o_orderkey", 3, 7, "y") | mapping.project("o_orderkey", F.col("y").cast("long").alias("y"))
    return pipe(_flow(spark, sf_dir, "orders", "o_orderkey")).df


@query("select l_orderkey, l_partkey, l_quantity from lineitem where l_quantity < 5")
def filter_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = mapping.filter_items(F.col("l_quantity") < 5) | mapping.project("l_orderkey", "l_partkey", "l_quantity")
    return pipe(_flow(spark, sf_dir, "lineitem", *LINES)).df


@query("select p_partkey, (p_size * 2)::bigint as v from part where p_size % 3 = 0")
def exclude_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = mapping.exclude((F.col("p_size") * 2).cast("long"), F.col("p_size") % 3 == 0, "v") | mapping.project("p_partkey", "v")
    return pipe(_flow(spark, sf_dir, "part", "p_partkey")).df


@query("select p_partkey, (p_size * p_size)::bigint as v from part")
def scan_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = mapping.project("p_partkey", F.col("p_size").cast("long").alias("v")) | mapping.square("v")
    return pipe(_flow(spark, sf_dir, "part", "p_partkey")).df


@query("select p_partkey, p_name as first from part")
def extract_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = mapping.map_items(pair=F.struct("p_name", "p_size")) | mapping.extract_first("pair", "first") | mapping.project("p_partkey", "first")
    return pipe(_flow(spark, sf_dir, "part", "p_partkey")).df


@query("select c_custkey, c_acctbal * 2 + 1 as v from customer where c_acctbal > 0")
def conditional_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = mapping.filter_items("c_acctbal > 0") | chunk_if(True, mapping.linear("c_acctbal", 2, 1, "v")) | chunk_if(False, mapping.filter_items("false")) | mapping.project("c_custkey", "v")
    return pipe(_flow(spark, sf_dir, "customer", "c_custkey")).df


@query("select o_orderkey, (o_custkey + 1)::bigint as v, (row_number() over (order by o_orderkey) - 1)::bigint as pos from orders")
def parallel_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = parallel(mapping.map_items(v=F.col("o_custkey") + 1))(_flow(spark, sf_dir, "orders", "o_orderkey"))
    return positioned(flow).df.select("o_orderkey", "v", "pos")


@query("select event_type, sum(event_id)::bigint as s, count(*) as n from events group by event_type")
def fold_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_type = aggregate.fold(F.sum("event_id").alias("s"), F.count("*").alias("n"), by=["event_type"])
    return by_type(_flow(spark, sf_dir, "events", "event_id"))


@query("select range::bigint as pos, (range * 3 * 2)::bigint as v from range(0, 20)")
def vector_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = range_source(spark, 0, 20, name="pos") | mapping.map_items(v=F.col("pos") * 3) | mapping.linear("v", 2, 0) | to_vector()
    return spark.createDataFrame(pipe(), "pos long, v long")


# -- sorting and order -------------------------------------------------------------------------


@query(f"select l_orderkey, l_partkey, (row_number() over (order by l_extendedprice desc, {_BY}) - 1)::bigint as pos from lineitem")
def sort_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = ordering.sort("-l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey") | middle(positioned) | mapping.project("l_orderkey", "l_partkey", "pos")
    return pipe(_flow(spark, sf_dir, "lineitem").with_df(_t(spark, sf_dir, "lineitem").select(*LINES))).df


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.top(20, "-o_totalprice", "o_orderkey")(_flow(spark, sf_dir, "orders")).df.select("o_orderkey", "o_totalprice")


@query("select c_custkey, (row_number() over (order by c_custkey desc) - 1)::bigint as pos from customer")
def reverse_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioned(ordering.reverse()(_flow(spark, sf_dir, "customer", "c_custkey"))).df.select("c_custkey", "pos")


@query("select c_custkey, c_name from customer")
def buffer_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.buffer()(_flow(spark, sf_dir, "customer", "c_custkey")).df.select("c_custkey", "c_name")


@query("select o_orderkey, lead(o_custkey) over (order by o_orderkey) as next_cust from orders")
def pull_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.peek(["o_custkey"])(_flow(spark, sf_dir, "orders", "o_orderkey")).df.select("o_orderkey", F.col("next.o_custkey").alias("next_cust"))


@query("select s_name as s, (row_number() over (order by s_name, s_suppkey) - 1)::bigint as pos from supplier")
def serialization_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    sorter = ordering.PassiveSorter("s_name", "s_suppkey")
    sorter.input(_flow(spark, sf_dir, "supplier"))
    return positioned(sorter.output()).df.select(F.col("s_name").alias("s"), "pos")


@query("select k, (row_number() over (order by k, src) - 1)::bigint as pos from (select c_custkey k, 0 src from customer union all select s_suppkey, 1 from supplier union all select p_partkey, 2 from part)")
def merge_sorted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = [Flow(_t(spark, sf_dir, t).select(F.col(c).alias("k"), F.lit(i).alias("src")), ("k",)) for i, (t, c) in enumerate((("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey")))]
    return positioned(ordering.merge_sorted(runs, "k", "src")).df.select("k", "pos")


@query("select o_orderkey, pos from (select o_orderkey, (row_number() over (order by o_orderkey) - 1)::bigint as pos from orders) where pos >= 100")
def seek_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.seek(100)(_flow(spark, sf_dir, "orders", "o_orderkey")).df.select("o_orderkey", "pos")


@query("select o_orderkey from orders order by o_orderkey limit 100")
def truncate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.truncate(100)(_flow(spark, sf_dir, "orders", "o_orderkey")).df.select("o_orderkey")


# -- fan-in, fan-out, positional joins ---------------------------------------------------------


@query("select c_custkey as k, c_name as name from customer union all select s_suppkey, s_name from supplier")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Flow(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")))
    b = Flow(_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))
    return combine.union(a, b).df


@query("select n_nationkey, 0 as branch from nation union all select n_nationkey, 1 from nation")
def fork_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches = combine.split(_flow(spark, sf_dir, "nation", "n_nationkey"), 2)
    return combine.union(*[b.with_df(b.df.select("n_nationkey", F.lit(i).alias("branch"))) for i, b in enumerate(branches)]).df


_ZIP = "with a as (select c_custkey, row_number() over (order by c_custkey) rn from customer), b as (select p_partkey, row_number() over (order by p_partkey) rn from part) "


@query(_ZIP + "select c_custkey, p_partkey from a join b using (rn)")
def zip_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Flow(_t(spark, sf_dir, "customer").select("c_custkey"), ("c_custkey",))
    b = Flow(_t(spark, sf_dir, "part").select("p_partkey"), ("p_partkey",))
    return combine.zipped(a, b).df.select("c_custkey", "p_partkey")


@query(_ZIP + "select (rn - 1)::bigint as pos, c_custkey as first, null::bigint as second from a join b using (rn) where false union all select (rn - 1)::bigint, c_custkey, null from a union all select (rn - 1)::bigint, null, p_partkey from b where rn <= (select count(*) from a)")
def unzip_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Flow(_t(spark, sf_dir, "customer").select("c_custkey"), ("c_custkey",))
    b = Flow(_t(spark, sf_dir, "part").select("p_partkey"), ("p_partkey",))
    x, y = combine.unzipped(combine.zipped(a, b), ["c_custkey"], ["p_partkey"])
    none = F.lit(None).cast("long")
    return combine.union(Flow(x.df.select("pos", F.col("c_custkey").alias("first"), none.alias("second"))), Flow(y.df.select("pos", none.alias("first"), F.col("p_partkey").alias("second")))).df


@query(_ZIP + "select c_custkey as k, ((rn - 1) * 2)::bigint as pos from a union all select p_partkey, ((rn - 1) * 2 + 1)::bigint from b where rn <= (select count(*) from a)")
def merge_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Flow(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), ("k",))
    b = Flow(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), ("k",))
    return combine.interleaved(a, b).df.select("k", "pos")


@query("with u as (select c_custkey k, 0 side from customer union all select s_suppkey, 1 from supplier) select k, side, (row_number() over (order by k, side) - 1)::bigint as pos from u")
def ordered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Flow(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), ("k",))
    b = Flow(_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), ("k",))
    return positioned(combine.ordered_merge(a, b, "k")).df.select("k", "side", "pos")


@query("with a as (select o_orderkey, row_number() over (order by o_orderkey) - 1 rn from orders) select (rn // 2)::bigint as pos, sum(o_orderkey)::bigint as v from a group by 1")
def pairwise_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.pairwise(F.col("o_orderkey"), "v")(Flow(_t(spark, sf_dir, "orders").select("o_orderkey"), ("o_orderkey",))).df


_TWO = "with a as (select o_orderkey x, row_number() over (order by o_orderkey) rn from orders), b as (select o_custkey y, row_number() over (order by o_orderkey) rn from orders) "


@query(_TWO + "select (rn - 1)::bigint as pos, (x + y)::bigint as added, (x - y)::bigint as taken, (x * y)::bigint as times from a join b using (rn)")
def stream_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    a = Flow(o.select(F.col("o_orderkey").alias("x")), ("x",))
    b = Flow(o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("y")), ("k",))
    z = combine.arithmetic(a, b, "x", "y", "+", "added").df
    return z.select("pos", "added", (F.col("x") - F.col("y")).alias("taken"), (F.col("x") * F.col("y")).alias("times"))


@query("with a as (select o_custkey f, row_number() over (order by o_orderkey) - 1 pos from orders), b as (select o_custkey s, row_number() over (order by o_totalprice, o_orderkey) - 1 pos from orders) select pos::bigint as pos, f as first, s as second from a join b using (pos) where f is distinct from s")
def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return combine.differences(Flow(o, ("o_orderkey",)), Flow(o, ("o_totalprice", "o_orderkey")), "o_custkey", "o_custkey").df.select("pos", "first", "second")


@query("select n_regionkey as k from nation intersect all select r_regionkey from region")
def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k")).intersectAll(_t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k")))


@query("select o_custkey as k from orders except all select c_custkey from customer")
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' further orders: an order for each, less each customer once."""
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).exceptAll(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


@query("with a as (select c_custkey x, row_number() over (order by c_custkey) rn from customer), b as (select p_partkey y, row_number() over (order by p_partkey) rn from part), c as (select o_orderkey z, row_number() over (order by o_orderkey) rn from orders) select (rn - 1)::bigint as pos, (x + y + z)::bigint as s from a join b using (rn) join c using (rn)")
def nary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [("customer", "c_custkey", "x"), ("part", "p_partkey", "y"), ("orders", "o_orderkey", "z")]
    flows = [Flow(_t(spark, sf_dir, t).select(F.col(c).alias(n)), (n,)) for t, c, n in keys]
    return scan.scan(flows, s=F.col("x") + F.col("y") + F.col("z")).df


@query("select c_custkey as k, ((row_number() over (order by c_custkey) - 1) * 3)::bigint as pos from customer union all select s_suppkey, ((row_number() over (order by s_suppkey) - 1) * 3 + 1)::bigint from supplier union all select n_nationkey, ((row_number() over (order by n_nationkey) - 1) * 3 + 2)::bigint from nation")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey")]
    return scan.interleave([Flow(_t(spark, sf_dir, t).select(F.col(c).cast("long").alias("k")), ("k",)) for t, c in keys]).df.select("k", "pos")


# -- runs, distinct items, groups --------------------------------------------------------------

_RUNS = f"with a as (select l_returnflag f, row_number() over (order by {_BY}) - 1 pos from lineitem), b as (select *, case when pos > 0 and lag(f) over (order by pos) is not distinct from f then 0 else 1 end n from a) "


def _flags(spark: SparkSession, sf_dir: str) -> Flow:
    return Flow(_t(spark, sf_dir, "lineitem").select(*LINES, F.col("l_returnflag").alias("f")), LINES)


@query(_RUNS + "select pos::bigint as pos, f from b where n = 1")
def unique_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.unique(["f"], "pos")(_flags(spark, sf_dir)).df.select("pos", "f")


@query(_RUNS + ", g as (select *, sum(n) over (order by pos) run from b) select run::bigint as run, f, count(*) as c from g group by 1, 2")
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.count_consecutive(["f"], "c")(_flags(spark, sf_dir)).df.select("run", "f", "c")


@query(f"with a as (select l_partkey v, row_number() over (order by {_BY}) - 1 pos from lineitem) select v, min(pos)::bigint as pos from a group by v")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-occurrence distinct of the parts, in line order."""
    flow = Flow(_t(spark, sf_dir, "lineitem").select(*LINES, F.col("l_partkey").alias("v")), LINES)
    return aggregate.distinct_first(["v"])(flow).df


@query("with a as (select p_partkey, row_number() over (order by p_partkey) - 1 rn from part) select (rn // 16)::bigint as chunk, string_agg(p_partkey::varchar, ',' order by p_partkey) as items from a group by 1")
def chunker(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = Flow(_t(spark, sf_dir, "part").select("p_partkey"), ("p_partkey",))
    return aggregate.chunker(16, "p_partkey")(flow).df.select("chunk", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("select l_orderkey, l_partkey, (row_number() over (partition by l_orderkey order by l_extendedprice, l_linenumber, l_partkey, l_suppkey) - 1)::bigint as nth from lineitem")
def subpipeline_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = Flow(_t(spark, sf_dir, "lineitem").select(*LINES))
    order = [F.col(c) for c in ("l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey")]
    return aggregate.ranked_within(["l_orderkey"], order)(flow).df.select("l_orderkey", "l_partkey", F.col("nth").cast("long").alias("nth"))


@query(_RUNS + ", g as (select *, sum(n) over (order by pos) run from b) select run::bigint as run, f, max(pos)::bigint as last from g group by 1, 2")
def consecutive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold within each run of equal flags."""
    flow = scan.consecutive_groups(["f"], "run")(positioned(_flags(spark, sf_dir)))
    return flow.df.groupBy("run", "f").agg(F.max("pos").alias("last"))


@query("select user_id, max(value) - min(value) as spread from events group by user_id")
def user_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": pdf["user_id"].iloc[:1], "spread": [pdf["value"].max() - pdf["value"].min()]})

    return aggregate.grouped(["user_id"], inner, "user_id long, spread double")(Flow(_t(spark, sf_dir, "events").select("user_id", "value"))).df


@query("with t as (select sum(p_size) s from (select p_size from part order by p_size desc limit 20)) select p_partkey, (s - 20 * p_size)::bigint as diff from part, t")
def sum_diff_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.top_difference("p_size", 20)(Flow(_t(spark, sf_dir, "part").select("p_partkey", "p_size"))).df.select("p_partkey", "diff")


@query("select l_returnflag, l_linestatus, count(*) as n, sum(l_linenumber)::bigint as s from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.rollup(["l_returnflag", "l_linestatus"], F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))(_flow(spark, sf_dir, "lineitem")).df


# -- ordered index -----------------------------------------------------------------------------


def _orders(spark: SparkSession, sf_dir: str) -> index.SortedIndex:
    return index.SortedIndex(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query("select o_orderkey, count(*) over w as rank, coalesce(sum(o_custkey) over w, 0)::bigint as prefix from orders window w as (order by o_orderkey rows between unbounded preceding and 1 preceding)")
def rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).ranks(F.col("o_custkey")).select("o_orderkey", "rank", "prefix")


@query("with k as (select o_orderkey * 3 as k from orders) select p_partkey, (select min(k) from k where k >= p_partkey) as bound from part")
def lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = index.SortedIndex(_t(spark, sf_dir, "orders").select((F.col("o_orderkey") * 3).alias("k")), "k")
    return keys.successors(_t(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


@query("with k as (select o_orderkey * 3 as k from orders) select p_partkey, (select min(k) from k where k > p_partkey) as bound from part")
def upper_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = index.SortedIndex(_t(spark, sf_dir, "orders").select((F.col("o_orderkey") * 3).alias("k")), "k")
    return keys.successors(_t(spark, sf_dir, "part").select("p_partkey"), "p_partkey", strict=True)


@query("with k as (select o_orderkey * 3 as k from orders) select p_partkey, (select max(k) from k where k < p_partkey) as bound from part")
def predecessor_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = index.SortedIndex(_t(spark, sf_dir, "orders").select((F.col("o_orderkey") * 3).alias("k")), "k")
    return keys.predecessors(_t(spark, sf_dir, "part").select("p_partkey"), "p_partkey", strict=True)


@query("with d as (select user_id, ts, lead(ts) over (partition by user_id order by ts) as nxt from (select distinct user_id, ts from events)) select event_id, d.nxt from events e join d on d.user_id = e.user_id and d.ts = e.ts")
def asof_succ(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return index.nearest(e, "ts", e.select("user_id", "ts"), "ts", "nxt", after=True, strict=True, by=[("user_id", "user_id")]).select("event_id", "nxt")


@query("with d as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as prv from (select distinct user_id, ts from events)) select event_id, d.prv from events e join d on d.user_id = e.user_id and d.ts = e.ts")
def asof_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return index.nearest(e, "ts", e.select("user_id", "ts"), "ts", "prv", after=False, strict=True, by=[("user_id", "user_id")]).select("event_id", "prv")


@query("select o_orderkey, o_custkey from orders where o_orderkey between 100 and 400")
def range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).range(400, 100)


@query("select * from (select o_orderkey, o_custkey, 'find' as op from orders where o_orderkey = 17 limit 1) union all select * from (select o_orderkey, o_custkey, 'lower' from orders where o_orderkey >= 50 order by o_orderkey limit 1) union all select * from (select o_orderkey, o_custkey, 'upper' from orders where o_orderkey > 50 order by o_orderkey limit 1) union all select * from (select o_orderkey, o_custkey, 'pred' from orders where o_orderkey < 50 order by o_orderkey desc limit 1)")
def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _orders(spark, sf_dir)
    found = [("find", x.find(17)), ("lower", x.lower_bound(50)), ("upper", x.upper_bound(50)), ("pred", x.predecessor(50))]
    return combine.union(*[Flow(df.withColumn("op", F.lit(op))) for op, df in found]).df


@query("select s_suppkey, s_nationkey + 100 as s_nationkey from supplier where s_suppkey % 3 = 0 union all select s_suppkey, s_nationkey from supplier where s_suppkey % 3 <> 0")
def upsert_modify(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    new = s.filter("s_suppkey % 3 = 0").withColumn("s_nationkey", F.col("s_nationkey") + 100)
    return index.SortedIndex(s, "s_suppkey").upsert(new).df


@query("select o_orderkey, o_custkey from orders where o_orderkey not in (3, 5, 8) and o_orderkey % 7 <> 0")
def erase_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _orders(spark, sf_dir)
    return x.erase(3, 5, 8).erase_rows(x.df.filter("o_orderkey % 7 = 0")).df


@query("with a as (select o_orderkey k, o_custkey c, row_number() over (order by o_orderkey) - 1 pos from orders), l as (select i, (32 ** (i + 1))::bigint as width from (select unnest(range(0, 12)) as i) where i = 0 or 32 ** i < (select count(*) from orders)) select i::bigint as level, (pos // width)::bigint as node, min(k) as min_key, count(*) as count, sum(c)::bigint as total from a, l group by 1, 2")
def augmented_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels, up to the root."""
    levels = _orders(spark, sf_dir).levels(32, F.sum("o_custkey").alias("total"))
    return combine.union(*[Flow(df.select(F.lit(i).cast("long").alias("level"), "node", "min_key", "count", "total")) for i, df in enumerate(levels)]).df


@query("select o_orderkey, o_custkey from orders where o_orderkey between 50 and 900")
def layered_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = index_by_batches(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    return layers.index().range(50, 900)


def index_by_batches(df: DataFrame) -> scan.LayeredIndex:
    layers = scan.LayeredIndex("o_orderkey")
    for i in range(4):
        layers.insert(df.filter(F.pmod("o_custkey", F.lit(4)) == i))
    return layers


# -- containers and graphs ---------------------------------------------------------------------

_PUSH = "event_id % 3 <> 0"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("v"))


_REPLAY = """with e as (select user_id, event_id, floor(value)::bigint as v, event_id % 3 <> 0 as push from events),
s as (select *, sum(case when push then 1 else -1 end) over (partition by user_id order by event_id) as total from e),
a as (select *, total - least(0, min(total) over (partition by user_id order by event_id)) as after from s),
h as (select *, coalesce(lag(after) over (partition by user_id order by event_id), 0) as held from a) """


@query(_REPLAY + ", c as (select *, sum(push::int) over w as pushed, sum((not push and held > 0)::int) over w as taken from h window w as (partition by user_id order by event_id)) select p.user_id, p.event_id, p.v, q.v as popped from c p left join c q on q.user_id is not distinct from p.user_id and q.push and q.pushed = p.taken and p.held > 0 where not p.push")
def fifo_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.fifo_replay(_events(spark, sf_dir), ["user_id"], ["event_id"], F.expr(_PUSH), "v")


@query(_REPLAY + ", t as (select *, last_value(case when push then v end ignore nulls) over (partition by user_id, case when push then held + 1 else held end order by event_id rows between unbounded preceding and 1 preceding) as top from h) select user_id, event_id, v, case when held > 0 then top end as popped from t where not push")
def lifo_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.lifo_replay(_events(spark, sf_dir), ["user_id"], ["event_id"], F.expr(_PUSH), "v")


_QUEUE = """with recursive e as (select user_id, event_id, floor(value)::bigint as v, event_id % 3 <> 0 as push, row_number() over (partition by user_id order by event_id) as nth from events),
r as (select user_id, 0::bigint as nth, []::bigint[] as held, null::bigint as event_id, null::bigint as v, true as push, null::bigint as popped from (select distinct user_id from e)
union all select r.user_id, e.nth, case when e.push then list_sort(list_append(r.held, e.v)) else r.held[2:] end, e.event_id, e.v, e.push, case when not e.push then r.held[1] end from r join e on e.user_id is not distinct from r.user_id and e.nth = r.nth + 1) """


@query(_QUEUE + "select user_id, event_id, v, push, popped from r where not push")
def pq_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("push", F.expr(_PUSH))
    return containers.priority_replay(events, ["user_id"], ["event_id"], "push", "v", "user_id long, event_id long, v long, push boolean, popped long")


@query("select p_size::bigint as p_size, count(*) as n, min(p_partkey) as first from part group by p_size")
def pq_pop_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.pop_equals(_t(spark, sf_dir, "part").select("p_partkey", *_long("p_size")), ["p_size"], F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("select c_custkey as node, (c_custkey // 10 * 10)::bigint as root from customer where c_custkey // 10 * 10 >= (select min(c_custkey) from customer) union all select c_custkey, (select min(c_custkey) from customer) from customer where c_custkey // 10 * 10 < (select min(c_custkey) from customer)")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers chained within tens of their keys."""
    c = _t(spark, sf_dir, "customer").select("c_custkey")
    edges = c.select((F.col("c_custkey") - 1).alias("a"), F.col("c_custkey").alias("b")).filter("b % 10 <> 0").join(c.withColumnRenamed("c_custkey", "a"), "a", "left_semi")
    return graph.DisjointSets(c, "c_custkey").union_set(edges, "a", "b").find_set()


@query("select src, rank from (select o_orderkey as src, row_number() over (order by o_orderkey) as rank, lead(o_orderkey) over (order by o_orderkey) as dst from orders) where dst is not null")
def list_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, each linked to the one of the next key."""
    x = _orders(spark, sf_dir)
    edges = x.successors(x.df.select(F.col("o_orderkey").alias("src")), "src", "dst", strict=True).filter("dst is not null")
    return graph.list_rank(edges.withColumn("weight", F.lit(1).cast("long"))).select("src", "rank")


# -- space -------------------------------------------------------------------------------------


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    xlo, ylo = F.col("p_partkey") % 97, F.col("p_size").cast("long")
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), xlo.alias("xlo"), ylo.alias("ylo"), (xlo + F.col("p_size") % 7).alias("xhi"), (ylo + F.col("p_partkey") % 5).alias("yhi"))


_RECTS = "with r as (select p_partkey id, p_partkey % 97 xlo, p_size::bigint ylo, p_partkey % 97 + p_size % 7 xhi, p_size + p_partkey % 5 yhi from part) "


@query(_RECTS + "select min(xlo)::bigint as xlo, min(ylo)::bigint as ylo, max(xhi)::bigint as xhi, max(yhi)::bigint as yhi from r")
def mbr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.mbr(_rects(spark, sf_dir))


@query(_RECTS + "select r.id as red, b.id as blue from r, r b where r.xlo <= b.xhi and b.xlo <= r.xhi and r.ylo <= b.yhi and b.ylo <= r.yhi")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rects(spark, sf_dir)
    return spatial.overlap_join(r, r, "id", "id")


@query(_RECTS + "select id, xlo, ylo from r where xlo between 10 and 40 and ylo between 5 and 20")
def window_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _rects(spark, sf_dir).select("id", F.col("xlo").alias("x"), F.col("ylo").alias("y"))
    return spatial.window_query(points, (40, 10), (5, 20)).select("id", F.col("x").alias("xlo"), F.col("y").alias("ylo"))


@query(_RECTS + "select id from r where xlo <= 30 and xhi >= 25 and ylo <= 12 and yhi >= 8")
def rtree_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.rect_query(_rects(spark, sf_dir), (25, 8, 30, 12)).select("id")


@query(_RECTS + ", b as (select id as box, id % 90 as x0, id % 90 + 6 as x1, id % 40 as y0, id % 40 + 5 as y1 from r) select box, id as point from r, b where xlo between x0 and x1 and ylo between y0 and y1")
def batch_window_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rects(spark, sf_dir)
    boxes = r.select(F.col("id").alias("box"), (F.col("id") % 90).alias("xlo"), (F.col("id") % 40).alias("ylo"), (F.col("id") % 90 + 6).alias("xhi"), (F.col("id") % 40 + 5).alias("yhi"))
    return spatial.batch_window_query(r.select("id", F.col("xlo").alias("x"), F.col("ylo").alias("y")), boxes, "id", "box")


@query(_RECTS + "select id, ((xlo - 40) * (xlo - 40) + (ylo - 20) * (ylo - 20))::bigint as distance2 from r order by 2, 1 limit 10")
def nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _rects(spark, sf_dir).select("id", F.col("xlo").alias("x"), F.col("ylo").alias("y"))
    return spatial.nearest_points(points, 40, 20, 10).select("id", "distance2")


@query("with e as (select o_custkey as lo, o_custkey + 3 as hi, o_orderkey as id from orders) select x.id as a, y.id as b from e x, e y where x.lo <= y.hi and y.lo <= x.hi")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("lo"), (F.col("o_custkey") + 3).alias("hi"))
    return spatial.interval_join(o, o, "id", "id")


_GRID = _RECTS.replace("with ", "with recursive ", 1) + """, b as (select min(xlo)::double x0, max(xhi)::double x1, min(ylo)::double y0, max(yhi)::double y1 from r),
g as (select r.*, floor(((xlo + xhi) / 2.0 - x0) * (32767 / greatest(x1 - x0, 1e-300)))::bigint as gx, floor(((ylo + yhi) / 2.0 - y0) * (32767 / greatest(y1 - y0, 1e-300)))::bigint as gy from r, b),
h as (select id, 14 as k, gx, gy, 0::bigint as value from g
union all select id, k - 1, case when gy >> k & 1 = 0 then case when gx >> k & 1 = 1 then 32767 - gy else gy end else gx end, case when gy >> k & 1 = 0 then case when gx >> k & 1 = 1 then 32767 - gx else gx end else gy end,
value * 4 + xor(3 * (gx >> k & 1), gy >> k & 1) from h where k >= 0),
leaves as (select g.*, h.value as hilbert, row_number() over (order by h.value, g.id) - 1 as pos from g join h on h.id = g.id and h.k = -1) """


@query(_GRID + "select id, hilbert::bigint as hilbert, pos::bigint as pos, (pos // 16)::bigint as node from leaves")
def hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.pack(_rects(spark, sf_dir), "id", 16)[0].select("id", "hilbert", "pos", "node")


@query(_GRID + ", l as (select i, (16 ** (i + 1))::bigint as width from (select unnest(range(0, 8)) as i) where i = 0 or 16 ** i < (select count(*) from part)) select i::bigint as level, (pos // width)::bigint as node, case when i = 0 then count(*) else count(distinct pos // (width // 16)) end::bigint as count, min(xlo)::bigint as xlo, min(ylo)::bigint as ylo, max(xhi)::bigint as xhi, max(yhi)::bigint as yhi from leaves, l group by i, width, pos // width")
def rtree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels of the packed tree: nodes, their entries, and their rectangles."""
    levels = spatial.pack(_rects(spark, sf_dir), "id", 16)[1]
    return combine.union(*[Flow(df.select(F.lit(i).cast("long").alias("level"), "node", "count", "xlo", "ylo", "xhi", "yhi")) for i, df in enumerate(levels)]).df


@query("""with p as (select l_quantity as x, min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem group by 1),
low as (select x, lo as y from p where not exists (select 1 from p a, p b where a.x < p.x and b.x > p.x and (p.x - a.x) * (b.lo - a.lo) - (p.lo - a.lo) * (b.x - a.x) <= 0)),
high as (select x, hi as y from p where not exists (select 1 from p a, p b where a.x < p.x and b.x > p.x and (p.x - a.x) * (b.hi - a.hi) - (p.hi - a.hi) * (b.x - a.x) >= 0)),
corners as (select x, y, 0 as side, x as along from low union select x, y, 1, -x from high where not exists (select 1 from low where low.x = high.x and low.y = high.y))
select x, y, (row_number() over (order by side, along) - 1)::bigint as pos from corners""")
def convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return geometry.convex_hull(s)


# -- matrices and permutations -----------------------------------------------------------------


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 20).alias("i"), (F.col("l_suppkey") % 20).alias("j")).agg(F.sum("l_linenumber").alias("v"))


_MATRIX = "with a as (select l_partkey % 20 i, l_suppkey % 20 j, sum(l_linenumber)::bigint v from lineitem group by 1, 2) "


@query(_MATRIX + "select x.i as i, y.j as j, sum(x.v * y.v)::bigint as v from a x join a y on x.j = y.i group by 1, 2")
def matrix_mult(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _matrix(spark, sf_dir)
    return matrix.multiply(a, a)


@query("with a as (select l_partkey p, l_suppkey s, sum(l_linenumber)::bigint v from lineitem group by 1, 2) select x.s as i, y.s as j, sum(x.v * y.v)::bigint as v from a x join a y on x.p = y.p group by 1, 2")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by suppliers: the parts x suppliers matrix, transposed, times itself."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), "l_linenumber").repartition("i")
    a = stored(lines.groupBy("i", "j").agg(F.sum("l_linenumber").alias("v")), "cells")
    return matrix.multiply(a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), a)


@query(_MATRIX + "select i, j, sum(v)::bigint as v from (select i, j, v from a union all select j, i, v from a) group by 1, 2")
def matrix_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _matrix(spark, sf_dir)
    return matrix.add(a, a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


@query(_MATRIX + "select i, j, sum(v)::bigint as v from (select i, j, v from a union all select j, i, -v from a) group by 1, 2")
def matrix_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _matrix(spark, sf_dir)
    return matrix.subtract(a, a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


@query(_MATRIX + "select range as i, coalesce(s, 0)::bigint as v from range(0, 24) left join (select i, sum(v * (j + 1)) s from a group by i) on i = range")
def sparse_times_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = spark.range(20).select(F.col("id").alias("i"), (F.col("id") + 1).alias("v"))
    return matrix.times_vector(_matrix(spark, sf_dir), vector, 24)


@query("select (range // 30)::bigint as i, (range % 30)::bigint as j, (case when range // 30 <= range % 30 then 5 else 0 end)::bigint as v from range(0, 900)")
def matrix_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.upper_triangle(spark, 30, 30, 5).select("i", "j", F.col("v").cast("long").alias("v"))


@query(_MATRIX + ", p as (select range // 24 i, range % 24 j from range(0, 576)) select p.i::bigint as i, p.j::bigint as j, coalesce(v, 0)::bigint as v, ((p.i // 8 * 3 + p.j // 8) * 64 + p.i % 8 * 8 + p.j % 8)::bigint as place from p left join a on a.i = p.i and a.j = p.j")
def matrix_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.pad(_matrix(spark, sf_dir), 20, 20, 8).withColumn("place", matrix.block_position(24, 8))


@query(_MATRIX + "select (i // 4)::bigint as band, count(*) as cells, min(i) as first, max(i) as last from a group by 1")
def sparse_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.bands(_matrix(spark, sf_dir), 4)


@query("with a as (select c_custkey, row_number() over (order by c_custkey) - 1 pos, count(*) over () n from customer) select c_custkey, ((pos * 7 + 3) % n)::bigint as dest from a")
def general_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = Flow(_t(spark, sf_dir, "customer").select("c_custkey"), ("c_custkey",))
    return permute.general_permute(lambda pos, n: (pos * 7 + 3) % n)(flow).df.select("c_custkey", "dest")


@query("with a as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos, length(bin((select count(*) from orders) - 1)) as bits from orders) select o_orderkey, list_sum(list_transform(range(0, bits), lambda i: ((pos >> (bits - 1 - i)) & 1) << i))::bigint as dest from a")
def bmmc_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, the bits of their positions reversed: places below the next power of two."""

    def reversal(pos: Column, n: int) -> Column:
        bits = max(1, (n - 1).bit_length())
        return permute.bit_matrix_apply(pos, [1 << (bits - 1 - i) for i in range(bits)], 0)

    flow = Flow(_t(spark, sf_dir, "orders").select("o_orderkey"), ("o_orderkey",))
    return permute.general_permute(reversal)(flow).df.select("o_orderkey", "dest")
