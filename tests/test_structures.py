"""Index, containers, graphs, space, matrices and permutations against plain Python."""

import bisect
import heapq
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.flow import Flow
from millrace.functions import get_bits, hilbert, intersects, overlap_area, packed
from millrace.operators import containers, geometry, graph, matrix, permute, spatial
from millrace.operators.index import SortedIndex
from millrace.sources.readers import linked_list, points_text, rectangles_text, scan_ints


def test_index_model(spark, tmp_path):
    rng = random.Random(42)
    keys = sorted(rng.randrange(400) for _ in range(300))
    probes = [(i, rng.randrange(-5, 410) if i % 7 else None) for i in range(200)]
    index = SortedIndex(spark.createDataFrame([(k,) for k in keys], "k long").repartition(5), "k").write(f"file://{tmp_path}/index")
    frame = spark.createDataFrame(probes, "i long, x long")

    def at(i):
        return keys[i] if 0 <= i < len(keys) else None

    expected = {
        "ge": lambda x: at(bisect.bisect_left(keys, x)),
        "gt": lambda x: at(bisect.bisect_right(keys, x)),
        "le": lambda x: at(bisect.bisect_right(keys, x) - 1),
        "lt": lambda x: at(bisect.bisect_left(keys, x) - 1),
    }
    found = {"ge": index.successors(frame, "x"), "gt": index.successors(frame, "x", strict=True), "le": index.predecessors(frame, "x"), "lt": index.predecessors(frame, "x", strict=True)}
    for name, df in found.items():
        got = {r.i: r.bound for r in df.collect()}
        assert got == {i: None if x is None else expected[name](x) for i, x in probes}, name
    assert index.find(keys[0]).count() == 1
    assert sorted(r.k for r in index.erase(keys[0]).df.collect()) == [k for k in keys if k != keys[0]]
    more = spark.createDataFrame([(keys[0],), (1000,)], "k long")
    assert index.insert(more).df.count() == 302 and index.insert_unique(more).df.count() == 301


def test_rank_sum(spark):
    for n in (1234, 617):
        df = spark.range(n).select(F.col("id").alias("v")).orderBy(F.rand(1))
        got = {r.v: (r.rank, r.prefix) for r in SortedIndex(df, "v").ranks(F.col("v")).collect()}
        assert got == {i: (i, i * (i - 1) // 2) for i in range(n)}


def test_levels(spark):
    levels = SortedIndex(spark.range(100).withColumnRenamed("id", "v"), "v").levels(5, F.sum("v").alias("s"))
    assert [x.count() for x in levels] == [20, 4, 1] and levels[-1].collect()[0].s == 4950


def test_replays(spark):
    rng = random.Random(3)
    rows = [(g, t, rng.random() < 0.55, rng.randrange(50)) for g in range(4) for t in range(60)]
    df = spark.createDataFrame(rows, "g int, t int, push boolean, v int").repartition(3)
    model = {"fifo": {}, "lifo": {}, "pq": {}}
    for g in range(4):
        q, s, h = [], [], []
        for _, t, push, v in [r for r in rows if r[0] == g]:
            if push:
                q.append(v), s.append(v), heapq.heappush(h, v)
            else:
                model["fifo"][g, t] = q.pop(0) if q else None
                model["lifo"][g, t] = s.pop() if s else None
                model["pq"][g, t] = heapq.heappop(h) if h else None
    got = {
        "fifo": containers.fifo_replay(df, ["g"], ["t"], F.col("push"), "v"),
        "lifo": containers.lifo_replay(df, ["g"], ["t"], F.col("push"), "v"),
        "pq": containers.priority_replay(df, ["g"], ["t"], "push", "v", "g int, t int, push boolean, v int, popped int"),
    }
    for name, out in got.items():
        assert {(r.g, r.t): r.popped for r in out.collect()} == model[name], name


def test_disjoint_sets(spark):
    members = spark.range(307)
    sets = graph.DisjointSets(members, "id")
    assert sets.count_sets() == 307
    edges = spark.range(1, 307).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    assert graph.DisjointSets(members, "id").union_set(edges.limit(10), "a", "b").count_sets() == 297
    assert sets.union_set(edges, "a", "b").count_sets() == 1
    assert graph.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_random(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)} | {x: r for x, r in got.items() if find(x) == r}


def test_list_rank(spark):
    edges = linked_list(spark, 100).orderBy(F.rand(2))
    order = {(17 + i * 903584919) % 2**30: i + 1 for i in range(100)}
    assert {r.src: r["rank"] for r in graph.list_rank(edges).collect()} == order
    with pytest.raises(ValueError):
        graph.list_rank(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "src long, dst long, weight long"))


def _rects(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.randrange(60), rng.randrange(60)
        out.append((i, x, y, x + rng.randrange(9), y + rng.randrange(9)))
    return out


def test_overlap_join(spark):
    a, b = _rects(120, 1), _rects(90, 2)
    schema = "id long, xlo long, ylo long, xhi long, yhi long"
    truth = sorted((r[0], s[0]) for r in a for s in b if r[1] <= s[3] and s[1] <= r[3] and r[2] <= s[4] and s[2] <= r[4])
    for cell in (None, (1.0, 1.0), (7.0, 13.0), (1000.0, 1000.0)):
        got = spatial.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "id", "id", cell=cell)
        assert sorted((r.red, r.blue) for r in got.collect()) == truth
    empty = spark.createDataFrame([], schema)
    assert spatial.overlap_join(empty, spark.createDataFrame(b, schema), "id", "id").count() == 0


def _hilbert(x, y, side):
    """The textbook rotation form, up to the orientation of the first step."""
    d, s = 0, side // 2
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        s //= 2
    return d


def test_hilbert_is_a_walk(spark):
    side = 16
    df = spark.range(side * side).select((F.col("id") % side).alias("x"), F.floor(F.col("id") / side).alias("y")).withColumn("h", hilbert(F.col("x"), F.col("y"), side))
    at = {r.h: (r.x, r.y) for r in df.collect()}
    assert sorted(at) == list(range(side * side))
    assert all(abs(at[i][0] - at[i + 1][0]) + abs(at[i][1] - at[i + 1][1]) == 1 for i in range(side * side - 1))
    starts = {at[0], at[side * side - 1]}
    ends = {next((x, y) for x in range(side) for y in range(side) if _hilbert(x, y, side) == k) for k in (0, side * side - 1)}
    assert len(starts) == len(ends) == 2
    assert spark.range(1).select(hilbert(F.lit(side), F.lit(0), side).alias("h")).collect()[0].h is None


def test_pack(spark):
    rects = spark.createDataFrame(_rects(100, 4), "id long, xlo long, ylo long, xhi long, yhi long")
    leaves, levels = spatial.pack(rects, "id", 8)
    assert sorted(r.pos for r in leaves.collect()) == list(range(100)) and [x.count() for x in levels] == [13, 2, 1]
    assert levels[-1].collect()[0]["xlo"] == rects.agg(F.min("xlo")).collect()[0][0]
    assert spatial.tree_stats(levels).count() == 3


def test_convex_hull(spark):
    rng = np.random.default_rng(0)
    pts = rng.integers(0, 50, (500, 2)).astype(float)
    got = [(r.x, r.y) for r in geometry.convex_hull(spark.createDataFrame(pts.tolist(), "x double, y double").repartition(7)).orderBy("pos").collect()]
    p = sorted(set(map(tuple, pts.tolist())))

    def on_left(a, b):
        return all((b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]) >= 0 for q in p)

    assert got[0] == p[0] and all(on_left(a, b) for a, b in zip(got, got[1:] + got[:1])) and len(set(got)) == len(got)
    line = spark.createDataFrame([(float(i), float(i)) for i in range(9)] + [(None, 1.0)], "x double, y double")
    assert {(r.x, r.y) for r in geometry.convex_hull(line).collect()} == {(0.0, 0.0), (8.0, 8.0)}
    assert geometry.convex_hull(line.filter("x < 0")).count() == 0


def test_matrices(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-3, 4, (9, 7)), rng.integers(-3, 4, (7, 8))
    coo = lambda m: spark.createDataFrame([(i, j, int(v)) for (i, j), v in np.ndenumerate(m) if v], "i long, j long, v long")
    out = np.zeros((9, 8), int)
    for r in matrix.multiply(coo(a), coo(b)).collect():
        out[r.i, r.j] = r.v
    assert (out == a @ b).all()
    padded = matrix.pad(coo(a), 9, 7, 4)
    assert padded.count() == 12 * 8 and matrix.unpad(padded, 9, 7).count() == 63
    places = padded.select(matrix.block_position(8, 4).alias("p")).collect()
    assert sorted(r.p for r in places) == list(range(96))
    vector = spark.createDataFrame([(j, j + 1) for j in range(7)], "i long, v long")
    got = {r.i: r.v for r in matrix.times_vector(coo(a), vector, 9).collect()}
    assert [got[i] for i in range(9)] == (a @ np.arange(1, 8)).tolist()


def test_permutations(spark):
    flow = Flow(spark.range(64), ("id",))
    got = permute.bit_permute([3, 6, 12, 24, 48, 32], 5)(flow).df
    assert sorted(r.dest for r in got.collect()) == list(range(64))
    assert all(r.dest == sum((bin(r.id & m).count("1") % 2) << i for i, m in enumerate([3, 6, 12, 24, 48, 32])) ^ 5 for r in got.collect())


def test_geometries(spark):
    ring = [[{"x": 0.0, "y": 1.0, "z": None}, {"x": 4.0, "y": -2.0, "z": 1.0}]]
    rows = [(3, [{"type": "int", "int": 5, "float": None, "double": None, "string": None, "long": None}], [ring]), (3, [], [ring]), (1, [], [])]
    df = spark.createDataFrame(rows, geometry.GEOMETRY)
    assert {r.kind: r["count"] for r in geometry.kinds(df).collect()} == {3: 2, 1: 1}
    assert tuple(geometry.geometry_mbr(df).collect()[0]) == (0.0, -2.0, 4.0, 1.0)
    assert [r.value for r in geometry.field_values(df).collect()] == ["5"]


def test_functions(spark):
    box = lambda *v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("xlo", "ylo", "xhi", "yhi"))])
    a, b, c = box(0, 0, 2, 2), box(2, 2, 3, 3), box(1, 1, 5, 5)
    r = spark.range(1).select(intersects(a, b).alias("touch"), overlap_area(a, c).alias("area"), overlap_area(a, b).alias("none")).collect()[0]
    assert (r.touch, r.area, r.none) == (True, 1, 0)
    word = packed(F.array(*map(F.lit, [5, 0, 7, 3])), 3)
    got = spark.range(4).select(get_bits(word, F.col("id"), 3).alias("v")).collect()
    assert [x.v for x in got] == [5, 0, 7, 3]


def test_text_sources(spark, tmp_path):
    (tmp_path / "ints").write_text("1 2\n3 x 4\n5")
    assert [r.v for r in scan_ints(spark, f"file://{tmp_path}/ints").df.orderBy("nth", "at").collect()] == [1, 2, 3]
    (tmp_path / "rects").write_text("7 4 5 1 2\n\n8 0 0 1 1\n")
    assert [tuple(r) for r in rectangles_text(spark, f"file://{tmp_path}/rects").orderBy("id").collect()] == [(7, 1.0, 2.0, 4.0, 5.0), (8, 0.0, 0.0, 1.0, 1.0)]
    (tmp_path / "points").write_text("1 2\n3 4\n")
    assert points_text(spark, f"file://{tmp_path}/points").count() == 2


def test_scans(spark):
    from millrace.operators import scan

    flows = [Flow(spark.range(n).select((F.col("id") * k).alias(c)), (c,)) for n, k, c in ((5, 1, "a"), (6, 10, "b"), (7, 100, "c"))]
    got = scan.scan(flows, s=F.col("a") + F.col("b") + F.col("c")).df
    assert {r.pos: r.s for r in got.collect()} == {i: 111 * i for i in range(5)}
    same = [Flow(f.df.toDF("v"), ("v",)) for f in flows]
    assert [r.v for r in scan.interleave(same[:2]).df.orderBy("pos").limit(6).collect()] == [0, 0, 1, 10, 2, 20]

    def step(pdf):
        return pdf[pdf["input"] == 1].assign(seen=(pdf["input"] == 0).cumsum())[["g", "t", "seen"]]

    left = Flow(spark.createDataFrame([(1, t) for t in (1, 4, 6)], "g int, t int"))
    right = Flow(spark.createDataFrame([(1, t) for t in (0, 5, 9)], "g int, t int"))
    out = scan.scan_by([left, right], "g", ["t"], step, "g int, t int, seen long")
    assert sorted((r.t, r.seen) for r in out.collect()) == [(0, 0), (5, 2), (9, 3)]


def test_layers(spark):
    from millrace.operators.scan import LayeredIndex

    layers = LayeredIndex("v", factor=2)
    for i in range(12):
        layers.insert(spark.range(i * 10, i * 10 + 10).withColumnRenamed("id", "v"))
    assert len(layers.layers) <= 4 and layers.index().df.count() == 120
    assert layers.index().lower_bound(55).collect()[0].v == 55
    with pytest.raises(ValueError):
        LayeredIndex("v").index()


def test_asof_within_groups(spark):
    from millrace.operators.index import nearest

    rng = random.Random(6)
    keys = [(rng.choice([None, 1, 2, 2, 2]), rng.randrange(60)) for _ in range(80)]
    probes = [(i, rng.choice([None, 1, 2, 2, 3]), rng.choice([None, *range(60)])) for i in range(120)]
    k, p = spark.createDataFrame(keys, "h int, y int"), spark.createDataFrame(probes, "i int, g int, x int").repartition(3)
    for after in (True, False):
        for strict in (True, False):
            got = {r.i: r.b for r in nearest(p, "x", k, "y", "b", after, strict, by=[("g", "h")]).collect()}
            for i, g, x in probes:
                fit = [] if x is None else [y for h, y in keys if h == g and (y > x if after else y < x) or h == g and not strict and y == x]
                assert got[i] == (min(fit) if after else max(fit)) if fit else got[i] is None


def test_overlap_of_sizes_far_apart(spark):
    """Rectangles from points to the whole plane, most in one spot: each pair once, and a few rows a rectangle."""
    rng = random.Random(11)
    rows = []
    for i in range(300):
        x, y = (rng.random() * 10, rng.random() * 10) if i % 3 else (rng.uniform(-1e5, 1e5), rng.uniform(-1e5, 1e5))
        w = rng.choice([0.0, 0.1, 1.0, 50.0, 1e4]) * rng.random()
        rows.append((i, x, y, x + w, y + w * rng.random()))
    rows += [(300, -1e6, -1e6, 1e6, 1e6), (301, -1e6, 3.0, 1e6, 3.0), (302, 5.0, 9.0, 4.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, xlo double, ylo double, xhi double, yhi double")
    got = [(r.red, r.blue) for r in spatial.overlap_join(df, df, "id", "id").collect()]
    want = {(a[0], b[0]) for a in rows[:302] for b in rows[:302] if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    assert len(got) == len(set(got)) and set(got) == want


def test_overlap_of_equal_rectangles(spark, monkeypatch):
    """Equal rectangles are joined as one, in lists of bounded length; ids may be null or repeat."""
    monkeypatch.setattr(spatial, "LIST", 16)
    rng = random.Random(3)
    boxes = [(x, y, x + 2, y + 1) for x in range(5) for y in range(4)]
    rows = [(None if i % 50 == 0 else i // 2, *(boxes[0] if i % 3 else rng.choice(boxes))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, xlo long, ylo long, xhi long, yhi long")
    lists = spatial._lists(df, "id").selectExpr("size(ids) as n").collect()
    assert sum(r.n for r in lists) == 400 and max(r.n for r in lists) < 64 and len(lists) < 80
    got = Counter((r.red, r.blue) for r in spatial.overlap_join(df, df.filter("xlo < 3"), "id", "id").collect())
    assert got == Counter((a[0], b[0]) for a in rows for b in rows if b[1] < 3 and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])


def test_windows_of_equal_boxes(spark):
    """Many equal boxes and points: each distinct box and point meets once, and all pairs of ids come."""
    points = spark.range(600).selectExpr("id", "id % 3 as x", "id % 2 as y")
    boxes = spark.range(400).selectExpr("id as box", "id % 2 as xlo", "0 as ylo", "id % 2 + 1 as xhi", "0 as yhi")
    got = spatial.batch_window_query(points, boxes, "id", "box")
    assert "explode(b_ids" in got._jdf.queryExecution().toString()
    assert got.count() == got.distinct().count() == 400 * 200
    assert got.filter("not (point % 2 = 0 and point % 3 between box % 2 and box % 2 + 1)").isEmpty()


def test_intervals_meet_in_small_cells(spark):
    """On a line, cells grow no longer with the number of intervals, so that pairs compared grow no faster than they."""
    for n in (2_000, 32_000):
        flat = spark.range(n).selectExpr("id", "id * 5 as xlo", "id * 5 + 3 as xhi", "0 as ylo", "0 as yhi")
        assert spatial._cell_sizes(flat.withColumn("ids", F.array("id")), flat.withColumn("ids", F.array("id")))[0] < 60
    few = spark.range(3000).selectExpr("id", "id as lo", "id + 3 as hi")
    assert spatial.interval_join(few, few, "id", "id").count() == 7 * 3000 - 2 * (3 + 2 + 1)


@pytest.mark.parametrize("kind", ["long", "double", "decimal(12,2)"])
def test_products_of_blocks(spark, kind):
    rng = np.random.default_rng(4)
    a, b = (np.where(rng.random(shape) < 0.2, rng.integers(-5, 6, shape), 0) for shape in ((30, 50), (50, 21)))
    table = lambda m: spark.createDataFrame([(int(i), int(j), int(m[i, j])) for i, j in zip(*np.nonzero(m))], "i long, j long, v long").withColumn("v", F.col("v").cast(kind))
    want = {(int(i), int(j)): int((a @ b)[i, j]) for i, j in zip(*np.nonzero((a != 0).astype(int) @ (b != 0).astype(int)))}
    for block in (128, 7, None):
        assert {(r.i, r.j): int(r.v) for r in matrix.multiply(table(a), table(b), block).collect()} == want


def test_dense_products_go_by_blocks(spark):
    dense = spark.range(200 * 200).select(F.floor(F.col("id") / 200).alias("i"), (F.col("id") % 200).alias("j"), (F.col("id") % 7).alias("v"))
    thin = dense.filter("(i * 7 + j) % 40 = 0")
    plans = [matrix.multiply(m, m)._jdf.queryExecution().toString() for m in (dense, thin)]
    assert "MapInArrow" in plans[0] and "MapInArrow" not in plans[1]
    m = (np.arange(200 * 200) % 7).reshape(200, 200)
    got = matrix.multiply(dense, dense).toPandas().sort_values(["i", "j"]).v.to_numpy().reshape(200, 200)
    assert (got == m @ m).all()


def test_sparse_products_by_bands(spark, monkeypatch):
    """All products of a band of rows are made and summed in one task: no shuffle of sums."""
    monkeypatch.setattr(matrix, "WIDE", 16)
    rng = np.random.default_rng(9)
    a, b = (np.where(rng.random((90, 90)) < 0.1, rng.integers(-5, 6, (90, 90)), 0) for _ in "ab")
    table = lambda m: spark.createDataFrame([(int(i) - 40, int(j) - 40, int(m[i, j])) for i, j in zip(*np.nonzero(m))], "i long, j long, v long")
    want = {(int(i) - 40, int(j) - 40): int((a @ b)[i, j]) for i, j in zip(*np.nonzero((a != 0).astype(int) @ (b != 0).astype(int)))}
    made = matrix._by_bands(table(a), table(b), 1)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") < plan.index("Exchange") and {(r.i, r.j): r.v for r in made.collect()} == want


def test_ranks_of_many_lists(spark):
    rng = random.Random(6)
    edges, want = [], {}
    nodes = iter(rng.sample(range(10**6), 3000))
    for length in (1, 2, 3, 7, 64, 65, 300):
        chain = [next(nodes) for _ in range(length + 1)]
        total = 0
        for a, b in zip(chain, chain[1:]):
            w = rng.randint(1, 9)
            total += w
            edges.append((a, b, w))
            want[a] = total
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "src long, dst long, weight long")
    assert {r.src: r["rank"] for r in graph.list_rank(df).collect()} == want
    with pytest.raises(ValueError):
        graph.list_rank(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "src long, dst long, weight long"))
    assert graph.list_rank(df.limit(0)).count() == 0


def test_priority_queues_of_many_keys(spark):
    """Queues with null keys and values, in batches smaller than a key."""
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3]), i, rng.random() < 0.6, rng.choice([None, *range(5)])) for i in range(600)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = containers.priority_replay(spark.createDataFrame(rows, "k long, at long, push boolean, v long").repartition(3), ["k"], ["at"], "push", "v", "k long, at long, push boolean, v long, popped long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held, want = {}, {}
    for k, at, push, v in rows:
        q = held.setdefault(k, [])
        if push:
            q.append((v is None, v if v is not None else 0))
            q.sort()
        else:
            want[at] = None if not q or q[0][0] else q[0][1]
            q[:1] = []
    assert {r["at"]: r.popped for r in got} == want


@pytest.mark.parametrize("kind", ["int", "decimal(12,2)"])
def test_lists_are_contracted(spark, monkeypatch, kind):
    """Ranks by rounds that each take edges away: what all rounds write is a few times the edges, whatever their number."""
    monkeypatch.setattr(graph, "FEW_EDGES", 20)
    rng = random.Random(8)
    edges, want = [], {}
    nodes = iter(rng.sample(range(10**6), 3000))
    for length in (1, 1, 2, 3, 40, 200):
        chain, total = [next(nodes) for _ in range(length + 1)], 0
        for a, b in zip(chain, chain[1:]):
            w = rng.randint(1, 9)
            total += w
            edges.append((a, b, w))
            want[a] = total
    edges += [(None, 10**7, 5), (10**7, None, 4)]
    want |= {None: 5, 10**7: 4}
    rng.shuffle(edges)
    written, kept = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: written.append(kept(df, name)) or written[-1])
    df = spark.createDataFrame(edges, "src long, dst long, weight long").withColumn("weight", F.col("weight").cast(kind))
    got = graph.list_rank(df)
    assert {r.src: int(r["rank"]) for r in got.collect()} == want and got.columns == ["src", "dst", "weight", "rank"]
    assert sum(x.count() for x in written) < 6 * len(edges)
    ring = spark.createDataFrame([(i, (i + 1) % 30, 1) for i in range(30)], "src long, dst long, weight long")
    with pytest.raises(ValueError):
        graph.list_rank(ring)
