"""Every registered query of the engine against its SQL on the smallest tables, plan shapes, and streams."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import streaming
from millrace.flow import Flow
from millrace.operators import aggregate, mapping
from millrace.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    if name not in SQL:
        assert df.columns
        return
    r = duck.sql(SQL[name])
    names = list(r.columns)
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(_plain(x[names.index(c)]) for c in sorted(names)) for x in r.fetchall()), key=repr)
    assert sorted((tuple(_plain(x[c]) for c in sorted(names)) for x in rows), key=repr) == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, small):
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,5.0)]" in _plan(QUERIES["filter_pred"](spark, small))
    assert "TakeOrderedAndProject" in _plan(QUERIES["sort_topk"](spark, small))
    for name in ("parallel_ordered", "unique_adjacent", "run_length", "rank_sum", "lower_bound"):
        plan = _plan(QUERIES[name](spark, small))
        assert "SinglePartition" not in plan, name
    for name in ("overlap_join", "batch_window_query", "interval_join"):
        assert "NestedLoop" not in _plan(QUERIES[name](spark, small)) and "Cartesian" not in _plan(QUERIES[name](spark, small))


def test_streams(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    flow = streaming.source(spark, f"file://{tmp_path}/in", events.schema)
    pipe = mapping.filter_items("value > 10") | mapping.linear("value", 2, 1, "v")
    streaming.drain(streaming.through(flow, pipe).df.select("event_id", "v"), f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    want = pipe(Flow(events)).df.select("event_id", "v")
    assert sorted(spark.read.parquet(f"file://{tmp_path}/out").collect()) == sorted(want.collect())
    with pytest.raises(ValueError):
        aggregate.unique(["value"])(flow.with_df(flow.df, ("ts",)))
    done = streaming.windowed(flow, "ts", "1 hour", "1 hour", ["event_type"], F.count("*").alias("n"))
    assert done.isStreaming


def test_whole_tables(spark, small):
    """The queries over all rows of their tables, against brute force."""
    orders = spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_custkey").toPandas()
    key, lo = orders.o_orderkey.to_numpy(), orders.o_custkey.to_numpy()
    meet = abs(lo[:, None] - lo[None, :]) <= 3
    got = QUERIES["interval_join"](spark, small)
    assert "NestedLoop" not in _plan(got) and "Cartesian" not in _plan(got)
    pairs = {(r.a, r.b) for r in got.collect()}
    assert len(pairs) == meet.sum() and all(meet[list(key).index(a), list(key).index(b)] for a, b in list(pairs)[:200])
    levels = QUERIES["augmented_levels"](spark, small).toPandas()
    assert (levels.groupby("level")["count"].sum() == len(key)).all() and (levels.level == levels.level.max()).sum() == 1
    ranks = {r.src: r["rank"] for r in QUERIES["list_rank"](spark, small).collect()}
    assert ranks == {k: i + 1 for i, k in enumerate(sorted(key)[:-1])}
    dest = {r.dest for r in QUERIES["bmmc_permute"](spark, small).collect()}
    assert len(dest) == len(key)
    parts = spark.read.parquet(f"{small}/part.parquet").select("p_partkey").count()
    assert QUERIES["overlap_join"](spark, small).select("blue").distinct().count() == parts
    assert QUERIES["batch_window_query"](spark, small).filter("box % 50 <> 0").count() > 0


def test_streamed_windows(spark, small, tmp_path):
    """Tumbling windows of a stream, written once the watermark has passed them, are those of the table."""
    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts", "event_type")
    events.orderBy("ts").repartition(2).write.parquet(f"file://{tmp_path}/in")
    flow = streaming.source(spark, f"file://{tmp_path}/in", events.schema, files_per_trigger=100)
    done = streaming.windowed(flow, "ts", "1 day", "1 hour", ["event_type"], F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    streaming.drain(done, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    want = {(r.start, r.event_type): r.n for r in events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and got.items() <= want.items() and len({s for s, _ in want}) - len({s for s, _ in got}) <= 1


def test_entry_without_a_dependency(tmp_path):
    """Where a module that the corpus operators import is missing, all other queries are there."""
    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('not here')")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'distinct_first' in q and len(q) > 90 and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, env={**os.environ, "PYTHONPATH": f"{tmp_path}:{root}"})
