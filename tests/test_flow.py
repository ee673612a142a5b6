"""Composition, metadata, and the ordered operators, on the closed-form fixtures."""

import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from millrace import session, sources
from millrace.flow import Flow, Shared, begin, checked, chunk_end_if, chunk_if, end, forwarder, identity, middle, parallel, preparer, vfork
from millrace.operators import aggregate, combine, containers, mapping, matrix, ordering
from millrace.operators.index import SortedIndex
from millrace.operators.ranges import Ranges, positioned
from millrace.sources import from_items, range_source, readers, to_vector, zero


def seq(spark, values, kind="long"):
    return Flow(spark.createDataFrame(list(enumerate(values)), f"pos long, v {kind}").repartition(4), ("pos",))


def values(flow, column="v"):
    return [r[column] for r in flow.df.orderBy(*flow.sort_columns()).collect()]


def test_vector_pipeline(spark):
    pipe = from_items(spark, range(20)) | mapping.map_items(v=F.col("v") * 3) | mapping.linear("v", 2, 0) | to_vector()
    assert [r.v for r in pipe()] == [6 * i for i in range(20)]


def test_kinds_compose(spark):
    with pytest.raises(TypeError):
        to_vector() | identity()
    with pytest.raises(TypeError):
        identity() | begin(lambda: None)
    pipe = (begin(lambda: None, "a") | middle(lambda f: f, "b")) | end(lambda f: f, "c")
    assert pipe.kind == "pipeline" and "n0 -> n1" in pipe.to_dot() and '"c"' in pipe.to_dot()


def test_metadata(spark):
    seen = []
    flow = (range_source(spark, 0, 10, 3) | forwarder("k", 7) | preparer(lambda f: seen.append(f.fetch("items"))) | chunk_if(False, mapping.filter_items("false")))()
    assert seen == [4] and flow.fetch("k", int) == 7 and not flow.can_fetch("no") and flow.df.count() == 4
    with pytest.raises(TypeError):
        flow.fetch("k", str)
    with pytest.raises(KeyError):
        flow.fetch("no")


@pytest.mark.parametrize("n", [0, 1, 2, 20, 5000])
def test_sort(spark, n):
    flow = ordering.sort("v")(seq(spark, range(n, 0, -1)))
    p = positioned(flow)
    assert values(p) == list(range(1, n + 1)) and values(p, "pos") == list(range(n)) and p.fetch("items") == n


def test_reverse_twice_and_sum(spark):
    n = 1000
    flow = seq(spark, range(n))
    back = ordering.reverse()(flow)
    assert values(back) == list(range(n))[::-1]
    z = combine.zipped(Flow(flow.df.select(F.col("pos").alias("k"), "v"), ("k",)), Flow(back.df.select((-F.col("pos")).alias("r"), F.col("v").alias("w")), ("r",)))
    assert {r.v + r.w for r in z.df.collect()} == {n - 1}


def test_unique_and_runs(spark):
    items = [i for i in range(5) for _ in range(i + 1)]
    flow = seq(spark, items)
    assert values(aggregate.unique(["v"])(flow)) == list(range(5))
    runs = aggregate.count_consecutive(["v"], "n")(flow)
    assert [(r.v, r.n) for r in runs.df.orderBy("run").collect()] == [(i, i + 1) for i in range(5)]


def _runs(xs):
    out = []
    for x in xs:
        if out and out[-1][0] == x:
            out[-1][1] += 1
        else:
            out.append([x, 1])
    return [tuple(x) for x in out]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=st.lists(st.one_of(st.none(), st.integers(0, 2)), max_size=40))
def test_runs_like_python(spark, xs):
    flow = seq(spark, xs)
    got = [(r.v, r.n) for r in aggregate.count_consecutive(["v"], "n")(flow).df.orderBy("run").collect()]
    assert got == _runs(xs)
    assert values(aggregate.unique(["v"])(flow)) == [x for x, _ in _runs(xs)]
    assert sorted(x.p for x in Ranges(flow).position("p").df.collect()) == list(range(len(xs)))


def test_chunks_pairs_peek(spark):
    flow = seq(spark, range(9))
    assert [r["items"] for r in aggregate.chunker(4, "v")(flow).df.orderBy("chunk").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7], [8]]
    assert values(combine.pairwise(F.col("v"))(seq(spark, range(10))), "value") == [1, 5, 9, 13, 17]
    with pytest.raises(ValueError):
        combine.pairwise(F.col("v"))(flow)
    assert [r.next and r.next.v for r in ordering.peek(["v"])(flow).df.orderBy("pos").collect()] == [*range(1, 9), None]
    assert aggregate.chunker(4, "v")(seq(spark, [])).df.count() == 0


def test_positional_joins(spark):
    a, b = seq(spark, range(5)), seq(spark, range(100, 107))
    left, right = Flow(a.df.withColumnRenamed("pos", "k"), ("k",)), Flow(b.df.withColumnRenamed("pos", "k"), ("k",))
    assert values(combine.interleaved(left, right)) == [0, 100, 1, 101, 2, 102, 3, 103, 4, 104]
    with pytest.raises(ValueError):
        combine.zipped(right, Flow(a.df.select(F.col("v").alias("w")), ("w",)))
    with pytest.raises(ValueError):
        combine.interleaved(right, left)
    merged = combine.ordered_merge(Flow(a.df.select("v"), ("v",)), Flow(spark.createDataFrame([(1,), (1,), (7,)], "v long"), ("v",)), "v")
    assert [(r.v, r.side) for r in merged.df.orderBy(*merged.sort_columns()).collect()] == [(0, 0), (1, 0), (1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (7, 1)]


def test_join_split_fork(spark):
    flow = seq(spark, range(10))
    assert sorted(values(Flow(combine.union(*combine.split(flow, 2)).df, ("v",)))) == sorted([*range(10)] * 2)
    side = []
    assert combine.fork(middle(lambda f: side.append(f.df.count())))(flow).df.count() == 10 and side == [10]


def test_subpipeline_and_parallel(spark):
    rows = [(i, (13 * j) % 31) for i in range(10) for j in range(31)]
    flow = Flow(spark.createDataFrame(rows, "g int, v int"))
    got = parallel(aggregate.ranked_within(["g"], [F.col("v")]), 3)(flow).df
    assert got.filter("nth <> v").count() == 0 and got.count() == 310


def test_top_and_difference(spark):
    flow = Flow(spark.createDataFrame([(i,) for i in range(1, 101)], "v long"))
    d = {r.v: r["diff"] for r in aggregate.top_difference("v", 20)(flow).df.collect()}
    assert d == {v: 1810 - 20 * v for v in range(1, 101)}


def test_edges(spark):
    none = zero(spark, "pos long, v long")()
    assert positioned(none).df.count() == 0 and aggregate.unique(["v"])(none).df.count() == 0
    assert range_source(spark, 5, 5)().df.count() == 0 and range_source(spark, 7, 5)().df.count() == 0
    with pytest.raises(ValueError):
        range_source(spark, 0, 5, -1)
    with pytest.raises(ValueError):
        positioned(Flow(spark.range(3)))
    same = seq(spark, [1] * 100)
    assert values(aggregate.unique(["v"])(same)) == [1]
    with pytest.raises(TypeError):
        mapping.item_type(spark.range(1).schema)(same)
    sorter = ordering.PassiveSorter("v")
    sorter.input(seq(spark, [3, 1, 2]))
    assert values(sorter.output()) == [1, 2, 3]
    with pytest.raises(RuntimeError):
        sorter.output()


def test_sinks_and_observers(spark, tmp_path):
    flow = Flow(spark.range(10).withColumnRenamed("id", "v"), ("-v",))
    assert [r.v for r in sources.to_iterator()(flow)] == list(range(9, -1, -1))
    sources.noop()(flow)
    seen = spark.sparkContext.accumulator(0)
    sources.foreach(lambda r: seen.add(r.v))(flow)
    assert seen.value == 45
    lines = []
    observation = Observation("items")
    logged = (mapping.log_items("here", lines.append) | mapping.visit(observation, F.count("*").alias("n")))(flow)
    assert lines == ["here: struct<v:bigint> by -v"]
    logged.df.collect()
    assert observation.get == {"n": 10}
    held = combine.tee(f"file://{tmp_path}/tee")(flow)
    assert held.df.count() == 10 and held.order == flow.order
    assert sorted(r.v for r in sources.serialized(spark, f"file://{tmp_path}/tee", "v")().df.collect()) == list(range(10))


def test_buffers_and_reversers(spark):
    flow = Flow(spark.range(10).withColumnRenamed("id", "v"), ("v",))
    assert ordering.bounded_buffer(10)(flow).df.count() == 10
    with pytest.raises(ValueError):
        ordering.bounded_buffer(9)(flow)
    for passive, want in ((ordering.PassiveBuffer(), ("v",)), (ordering.PassiveReverser(), ("-v",))):
        with pytest.raises(RuntimeError):
            passive.output()
        passive.input(flow)
        assert passive.output().order == want
        with pytest.raises(RuntimeError):
            passive.output()
    assert [r.v for r in ordering.sorted_within("v")(flow).df.coalesce(1).collect()] == list(range(10))
    assert [r.v for r in containers.drained(flow.df, F.col("v").desc()).collect()][:2] == [9, 8]
    assert [r.v for r in SortedIndex(flow.df, "v").iterate(reverse=True).collect()][0] == 9
    x = SortedIndex(flow.df, "v").with_metadata(owner="me")
    assert x.erase(3).metadata == {"owner": "me"} and x.size() == 10 and not x.empty() and x.erase(*range(10)).empty()


def test_truncate_by_position(spark, monkeypatch):
    flow = Flow(spark.range(100).withColumnRenamed("id", "v").repartition(3), ("-v",))
    for most in (100_000, 5):
        monkeypatch.setattr(ordering, "MOST_MERGED", most)
        assert sorted(r.v for r in ordering.truncate(12)(flow).df.collect()) == list(range(88, 100))


def test_virtual_chunks(spark):
    flow = Flow(spark.range(4).withColumnRenamed("id", "v"), ("v",))
    with pytest.raises(TypeError):
        checked(None, "end")
    with pytest.raises(TypeError):
        checked(mapping.filter_items("true"), "end")
    forked = vfork(None, end(lambda f: f.df.count(), "count"))(flow)
    assert forked.fetch("forked") == 4 and forked.df.count() == 4
    with pytest.raises(KeyError):
        Shared().get("nothing")
    assert chunk_end_if(False, end(lambda f: 1))(flow) is flow


def test_generators(spark):
    assert sources.random_points(spark, 50).filter("x between 0 and 1 and y between 0 and 1").count() == 50
    assert readers.random_ints(spark, 50, 7).filter("v between 0 and 6").count() == 50
    cells = matrix.uniform_sparse(spark, 40, 50, 0.25)
    assert 300 < cells.count() < 700 and cells.filter("v <> 1.0").count() == 0


def test_scratch_goes(spark):
    with session.scratch(spark):
        held = session.stored(spark.range(5).toDF("v"), "here")
        path = held.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert held.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)
