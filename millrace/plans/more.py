"""Queries of sources and sinks, virtual chunks, shared structures, updates of indexes, and aggregates, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..flow import Flow, Shared, begin, chunk_end_if, end, order_before, vfork
from ..functions import area, ccw, extended_area, overlap_area
from ..operators import aggregate, combine, containers, index, mapping, ordering, permute, spatial
from ..operators.ranges import positioned
from ..session import scratch_path
from ..sources import from_items, output, parquet, write_sorted
from ..sources.readers import scan_ints, text_lines, zero
from ..sources.writers import print_ints
from .queries import _flow, _t, query

# -- sources and sinks: written to the shared scratch folder and read again --------------------------


@query("select o_orderkey, o_custkey, (row_number() over (order by o_orderkey desc) - 1)::bigint as pos from orders where o_orderkey <= 400")
def input_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders back to front, from a key on."""
    pipe = parquet(spark, f"{sf_dir}/orders.parquet", "o_orderkey", start=("o_orderkey", 400), reverse=True) | mapping.project("o_orderkey", "o_custkey")
    return positioned(pipe()).df


@query("select c_custkey, c_name, (row_number() over (order by c_name desc) - 1)::bigint as pos from customer")
def output_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings written in order and in disjoint files, then read back to front of that order."""
    path = scratch_path(spark, "sorted")
    (parquet(spark, f"{sf_dir}/customer.parquet", "c_name") | mapping.project("c_custkey", "c_name") | write_sorted(path))()
    return positioned((parquet(spark, path, "c_name", reverse=True) | ordering.buffer())()).df.select("c_custkey", "c_name", "pos")


@query("select s_suppkey, s_nationkey from supplier union all select s_suppkey, s_nationkey from supplier where s_nationkey < 10")
def output_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that two pipelines write one after another, with another codec."""
    path = scratch_path(spark, "appended")
    rows = parquet(spark, f"{sf_dir}/supplier.parquet", "s_suppkey") | mapping.project("s_suppkey", "s_nationkey")
    order_before(rows | output(path, codec="zstd"), rows | mapping.filter_items("s_nationkey < 10") | output(path, codec="zstd"))
    return spark.read.parquet(path)


@query("select o_custkey as v, count(*) as n from orders group by 1")
def printed_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers printed as text, a line each, and scanned again."""
    path = scratch_path(spark, "printed")
    (parquet(spark, f"{sf_dir}/orders.parquet", "o_orderkey") | print_ints(path, "o_custkey"))()
    return scan_ints(spark, path).df.groupBy("v").agg(F.count("*").alias("n"))


@query("select c_name as line from customer")
def printed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    _t(spark, sf_dir, "customer").select("c_name").write.text(path)
    return text_lines(spark, path).select("line")


@query("select range::bigint as pos, (range * range)::bigint as v from range(0, 50) where range % 2 = 0")
def items_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a Python iterable, joined with a source of no items."""
    some = (from_items(spark, (i * i for i in range(50))) | mapping.filter_items("pos % 2 = 0"))()
    return combine.union(some, zero(spark, "pos long, v long")()).df


# -- virtual chunks, shared structures, several outputs --------------------------------------------


@query("select s_suppkey, s_nationkey, 'kept' as side from supplier where s_nationkey >= 5 union all select s_suppkey, s_nationkey, 'forked' from supplier")
def virtual_fork(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow that goes on through a chunk and whole into an end."""
    path = scratch_path(spark, "forked")
    pipe = vfork(mapping.filter_items("s_nationkey >= 5"), output(path)) | vfork(None, None) | mapping.project("s_suppkey", "s_nationkey")
    kept = pipe(_flow(spark, sf_dir, "supplier", "s_suppkey")).df
    return kept.withColumn("side", F.lit("kept")).union(spark.read.parquet(path).select("s_suppkey", "s_nationkey", F.lit("forked")))


@query("select count(*) as n from orders")
def conditional_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = end(aggregate.fold(F.count("*").alias("n")), "count")
    return (parquet(spark, f"{sf_dir}/orders.parquet", "o_orderkey") | chunk_end_if(True, counted))()


@query("select o_orderkey, o_custkey, c_nationkey from orders left join customer on c_custkey = o_custkey where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
def shared_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One phase fills a map and a set, the next one looks items up in both."""
    shared = Shared()
    order_before(
        parquet(spark, f"{sf_dir}/customer.parquet", "c_custkey") | mapping.project(F.col("c_custkey").alias("o_custkey"), "c_nationkey") | shared.put("nations"),
        parquet(spark, f"{sf_dir}/nation.parquet", "n_nationkey") | mapping.filter_items("n_regionkey = 1") | mapping.project(F.col("n_nationkey").alias("c_nationkey")) | shared.put("wanted"),
    )
    pipe = parquet(spark, f"{sf_dir}/orders.parquet", "o_orderkey") | mapping.project("o_orderkey", "o_custkey") | combine.lookup(shared.get("nations").df, "o_custkey") | combine.contained(shared.get("wanted").df, "c_nationkey")
    return pipe().df.select("o_orderkey", "o_custkey", "c_nationkey")


@query("select p_partkey, case when p_size < 10 then 0 when p_size % 2 = 0 then 1 else 2 end::bigint as output from part")
def scan_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = combine.dealt(_flow(spark, sf_dir, "part", "p_partkey"), F.col("p_size") < 10, F.col("p_size") % 2 == 0)
    return combine.union(*[Flow(f.df.select("p_partkey", F.lit(i).cast("long").alias("output"))) for i, f in enumerate(outputs)]).df


# -- order ------------------------------------------------------------------------------------------


@query("select c_custkey, (row_number() over (order by length(c_name) desc, c_acctbal, c_custkey) - 1)::bigint as pos from customer")
def sort_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order by extracted keys."""
    pipe = ordering.sort_by(long=-F.length("c_name"), balance=F.col("c_acctbal"), key=F.col("c_custkey"))
    return positioned(pipe(_flow(spark, sf_dir, "customer"))).df.select("c_custkey", "pos")


@query("select case when pos <= 100 then pos - 1 when pos > 100 then pos - 1 + (select count(*) from region) end::bigint as pos, s_suppkey as k from (select s_suppkey, row_number() over (order by s_suppkey) as pos from supplier) union all select (least(100, (select count(*) from supplier)) + row_number() over (order by r_regionkey) - 1)::bigint, r_regionkey from region")
def insert_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = _flow(spark, sf_dir, "region", "r_regionkey")
    more = more.with_df(more.df.select(F.col("r_regionkey").cast("long").alias("k")), ("k",))
    flow = _flow(spark, sf_dir, "supplier", "s_suppkey")
    return ordering.insert_before(100, more)(flow.with_df(flow.df.select(F.col("s_suppkey").alias("k")), ("k",))).df.select("pos", "k")


@query("select p_partkey, p_size::bigint as p_size, p_size = (select min(p_size) from part) as popped from part")
def pop_top_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the items that tie at the top pop."""
    top, rest = containers.pop_top(_t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size")), ["p_size"])
    return top.withColumn("popped", F.lit(True)).union(rest.withColumn("popped", F.lit(False)))


@query("select c_custkey, c_acctbal from customer where c_custkey <> (select c_custkey from customer order by c_acctbal, c_custkey limit 1) union all select 0, 1000.0")
def pop_and_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([(0, 1000.0)], "c_custkey long, c_acctbal double")
    return containers.pop_and_push(_t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), new, "c_acctbal", "c_custkey")[1]


# -- indexes, space, aggregates -----------------------------------------------------------------------


@query("select 'erased' as what, count(*)::bigint as n from orders where o_custkey in (1, 4, 7) union all select 'left', count(*) from orders where o_custkey not in (1, 4, 7) union all select 'less one', count(*) - 1 from orders")
def index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows an erasure takes, how many are left, and the index without one row."""
    x = index.SortedIndex(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey").with_metadata(name="orders by customer")
    left, gone = x.erase_counted(1, 4, 7)
    some = x.df.agg(F.min("o_custkey")).collect()[0][0]
    rows = [("erased", gone), ("left", left.size()), ("less one", x.erase_one(some, "o_orderkey").size())]
    return spark.createDataFrame(rows, "what string, n long")


@query("select o_orderkey, o_custkey from orders where o_orderkey <> (select min(o_orderkey) from orders where o_custkey = (select min(o_custkey) from orders))")
def erase_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = index.SortedIndex(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    return x.erase_one(x.df.agg(F.min("o_custkey")).collect()[0][0], "o_orderkey").df


@query("select p_partkey as id, p_partkey % 97 as x, p_size::bigint as y from part where p_partkey % 97 between 20 and 60 and p_size <= 25")
def three_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three-sided query over files that are compact in space."""
    points = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97).alias("x"), F.col("p_size").cast("long").alias("y"))
    return spatial.three_sided_query(spatial.z_layout(points, scratch_path(spark, "layout"), 4), (60, 20), 25)


@query("""with r as (select p_partkey as id, p_partkey % 97 as x0, p_size::bigint as y0, p_partkey % 97 + p_size % 7 as x1, p_size + p_partkey % 5 as y1 from part)
select id, ((x1 - x0) * (y1 - y0))::bigint as area, ((greatest(x1, 30) - least(x0, 25)) * (greatest(y1, 12) - least(y0, 8)))::bigint as extended, (greatest(0, least(x1, 30) - greatest(x0, 25)) * greatest(0, least(y1, 12) - greatest(y0, 8)))::bigint as overlap, (5 * (y0 - 8) - 4 * (x0 - 25) > 0) as left_turn from r""")
def rectangle_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("p_partkey") % 97, F.col("p_size").cast("long")
    box = lambda a, b, c, d: F.struct(a.alias("xlo"), b.alias("ylo"), c.alias("xhi"), d.alias("yhi"))
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), box(x, y, x + F.col("p_size") % 7, y + F.col("p_partkey") % 5).alias("r"))
    rows = rows.withColumn("q", box(*[F.lit(v).cast("long") for v in (25, 8, 30, 12)]))
    turn = ccw(point(F.lit(25), F.lit(8)), point(F.lit(30), F.lit(12)), point(F.col("r.xlo"), F.col("r.ylo")))
    return rows.select("id", *[c.cast("long").alias(n) for n, c in (("area", area(F.col("r"))), ("extended", extended_area(F.col("r"), F.col("q"))), ("overlap", overlap_area(F.col("r"), F.col("q"))))], turn.alias("left_turn"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.cube(["l_returnflag", "l_linestatus"], F.count("*").alias("n"))(_flow(spark, sf_dir, "lineitem")).df


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.grouping_sets([["l_returnflag"], ["l_linestatus"], []], F.count("*").alias("n"))(_flow(spark, sf_dir, "lineitem")).df


@query("select l_returnflag, true as near from lineitem group by 1")
def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sketch is within a tenth of the exact number."""
    about = aggregate.approx_distinct(["l_returnflag"], "l_partkey", rsd=0.02)(_flow(spark, sf_dir, "lineitem")).df
    exact = _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"))
    return about.join(exact, "l_returnflag").select("l_returnflag", (F.abs(F.col("distinct") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))


@query("select count(*) as n, sum(o_orderkey)::bigint as s, count(distinct o_orderkey) as d from orders")
def random_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random order holds every item once."""
    mixed = positioned(permute.shuffled(7)(_flow(spark, sf_dir, "orders", "o_orderkey")), "at").df
    return mixed.agg(F.count_distinct("at").alias("n"), F.sum("o_orderkey").alias("s"), F.count_distinct("o_orderkey").alias("d"))


@query("select s_suppkey from supplier where s_suppkey > 3")
def begin_from_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline whose source is a structure that another one filled."""
    shared = Shared()
    (begin(lambda: _flow(spark, sf_dir, "supplier", "s_suppkey")) | mapping.project("s_suppkey") | shared.put("keys"))()
    return (shared.source("keys") | mapping.filter_items("s_suppkey > 3"))().df
