"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions by random rotations, shifted, put on a grid and ordered along a Hilbert curve; each
curve has its own rotation and shift. Every curve is range-partitioned and ranked in Spark, with a short code of each vector (half
precision). The vectors whose ranks lie within a window around a query's, on any curve, are its candidates: codes give the
nearest of them, the lists of all curves merge, and exact distances on the original vectors rerank these.

How wide a window must be depends on the vectors: neighbours of points in clusters lie next to them on some curve, while in vectors without
structure a near neighbour is hardly nearer than others, and no window of a few points finds it. So the window is measured: for
PROBES points the true neighbours are found by a pass over all points, and the window is what reaches the share AIM of these. Equal
vectors are one point of a curve, with the least ids of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, in_batches, stored

#: Curves, projected dimensions of each, and bits a dimension (their product is at most 62).
CURVES, DIMS, BITS = 16, 8, 7
#: A window reaches so many ranks to either side of a query at least.
LEAST_WINDOW = 64
#: Points whose true neighbours are found to measure the window (a documented bound; those of least hash), and the share of these it is to reach.
PROBES, AIM = 64, 0.97
#: Candidates of a query on a curve, by codes, that go on to exact distances, for each neighbour asked for.
SPARE = 4
#: Points searched together.
BLOCK = 4096
#: Vectors that the grid's scale is fitted to, at most (a documented bound; those of least hash).
FIT_ROWS = 4096
#: Points and queries' places up to which a table is broadcast.
MOST_BROADCAST = 100_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Ranks of grid cells (n x d, each below 2**bits) along the d-dimensional Hilbert curve, by Gray-code transposition."""
    x = cells.astype(np.uint64).T.copy()
    d = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = (one << np.uint64(b)) - one
        for i in range(d):
            high = (x[i] >> np.uint64(b)) & one == one
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b)) & one == one, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


class Curves:
    """Rotations, shifts and the scale of every curve; fitted to a bounded sample, the same for every run."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = 7):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        dims = min(dims, width)
        self.bits = min(bits, 62 // dims)
        self.mean = sample.mean(axis=0)
        self.axes, self.scale, self.shift = [], [], []
        turn, at = None, width
        for _ in range(curves):
            if at + dims > width:  # a fresh rotation once all its directions are used
                turn, at = np.linalg.qr(rng.normal(size=(width, width)))[0], 0
            axes = turn[:, at : at + dims]
            at += dims
            spread = ((sample - self.mean) @ axes).std(axis=0)
            self.axes.append(axes)
            self.scale.append(np.where(spread > 0, 8 * spread, 1.0))
            self.shift.append(rng.uniform(0.375, 0.625, dims))

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        top = (1 << self.bits) - 1
        centred = vectors - self.mean
        return [hilbert_keys(np.clip(((centred @ a) / s + o) * (top + 1), 0, top), self.bits) for a, s, o in zip(self.axes, self.scale, self.shift)]


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec): rows with an id whose vector is not null, not zero, without null or non-finite components, and of the most common length."""
    v = F.col("vec")
    df = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vec_col].alias("vec")).filter(F.col("vec_id").isNotNull() & v.isNotNull())
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    df = df.filter(F.coalesce(ok, F.lit(False)))
    common = df.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return df.filter(F.size("vec") == (common[0].n if common else 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column of one length, as doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def _probed(classes: DataFrame, probes: np.ndarray, names: np.ndarray, k: int) -> DataFrame:
    """(probe, point): the k nearest other points of each probe, by a pass over all points; a batch sends k rows a probe at most."""
    width = probes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            d = (v * v).sum(axis=1)[None] - 2 * probes @ v.T
            d[names[:, None] == ids[None]] = np.inf
            best = np.argpartition(d, min(k, len(ids)) - 1, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best.shape[1])), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(d, best, 1).ravel())], names=["probe", "point", "d"])

    found = in_batches(classes.select("point", "vec"), run, "probe long, point long, d double").filter("d < double('infinity')")
    nth = F.row_number().over(Window.partitionBy("probe").orderBy("d", "point"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= k).select("probe", "point")


def _window(ranks: DataFrame, near: DataFrame) -> int:
    """The window that reaches the share AIM of the pairs (probe, point): by pair, the least distance of ranks on any curve."""
    pairs = near.collect()  # PROBES * k at most
    if not pairs:
        return 0
    wanted = ranks.sparkSession.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "point long")
    at = {(r.curve, r.point): r.pos for r in ranks.join(F.broadcast(wanted), "point").select("curve", "pos", "point").collect()}  # a row a curve and point
    least = sorted(min(abs(at[c, a] - at[c, b]) for c in range(CURVES)) for a, b in pairs)
    return int(least[min(len(least) - 1, int(AIM * len(least)))])


def search(rows: DataFrame, every: int = 100, k: int = 10, share: float | None = None, least: int = LEAST_WINDOW, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest found of each row whose id is divisible by `every`: (query_id, rank, vec_id, score).

    Candidates are all other rows (rows that repeat the query's id aside); the score is the Euclidean distance in double precision; ties go to the
    smaller id. Fewer rows than k give as many as there are, an empty table none. The window to either side is measured (see above) and `least` ranks at
    least; `share` sets it to that share of all points instead.
    """
    return searched(rows, every, k, share, least, id_col, vec_col)[0]


def searched(rows: DataFrame, every: int, k: int, share: float | None, least: int, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """What `search` gives, and the window it took."""
    spark = rows.sparkSession
    points = usable(rows, id_col, vec_col).select("vec_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    # of equal vectors, the k + 1 least ids are all that any list can show; the limit works before the shuffle too
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    members = stored(points.withColumn("nth", nth).filter(F.col("nth") <= k + 1).withColumn("point", F.min("vec_id").over(Window.partitionBy("h1", "h2"))), "members")
    classes = members.filter("nth = 1").select("point", "vec", "h1", "h2")
    asked = points.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    asked = stored(asked.join(classes.select("point", "h1", "h2"), ["h1", "h2"]).select("query_id", "point"), "asked")
    n = classes.count()
    fit = classes.orderBy(F.xxhash64("point"), "point").limit(FIT_ROWS).select("point", "vec").collect()
    if not fit:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), 0
    sample = np.array([r.vec for r in fit], float)
    width = sample.shape[1]
    curves = Curves(sample)
    unit = max(float(np.abs(sample - curves.mean).max()), 1e-300)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1), width)
            code = np.clip((v - curves.mean) / unit, -60000, 60000).astype(np.float16)
            code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * width), len(v), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
            for c, key in enumerate(curves.keys(v)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(key), batch.column(0), code], names=["curve", "key", "point", "code"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a range, sorted, with their place on their curve within it."""
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve = batch.column(0).to_numpy()
            at = np.empty(len(curve), np.int64)
            for c in np.unique(curve):
                own = np.flatnonzero(curve == c)
                at[own] = np.arange(len(own)) + seen.get(c, 0)
                seen[c] = seen.get(c, 0) + len(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(curve), part, np.int32)), batch.column(0), pa.array(at), batch.column(2), batch.column(3)], names=["part", "curve", "at", "point", "code"])

    laid = in_batches(classes.select("point", "vec"), keyed, "curve int, key long, point long, code binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = laid.repartitionByRange(parts, "curve", "key", "point").sortWithinPartitions("curve", "key", "point")
    ranged = stored(in_batches(ranged, placed, "part int, curve int, at long, point long, code binary"), "curves")
    counts = ranged.groupBy("part", "curve").agg(F.count("*").alias("n")).collect()  # one row a range
    upto, shifts = {}, []
    for r in sorted(counts, key=lambda r: (r.curve, r.part)):
        shifts.append((r.part, r.curve, upto.get(r.curve, 0)))
        upto[r.curve] = upto.get(r.curve, 0) + r.n
    ranks = ranged.join(F.broadcast(spark.createDataFrame(shifts, "part int, curve int, shift long")), ["part", "curve"]).select("curve", (F.col("at") + F.col("shift")).alias("pos"), "point", "code")
    if share is None:
        window = max(least, _window(ranks, _probed(classes, sample[:PROBES], np.array([r.point for r in fit[:PROBES]]), k)))
    else:
        window = max(least, int(n * share))
    block = max(1, min(BLOCK, window))
    wanted = hinted(stored(asked.select("point").distinct(), "wanted"), MOST_BROADCAST)
    blocks = F.sequence(F.floor(F.greatest(F.col("pos") - window, F.lit(0)) / block), F.floor(F.least(F.col("pos") + window, F.lit(n - 1)) / block))
    queries = ranks.join(wanted, "point").select(F.col("curve").alias("qcurve"), F.explode(blocks).alias("qblock"), F.col("point").alias("query"), F.col("pos").alias("at"), F.col("code").alias("qcode"))
    most = SPARE * (k + 1)

    def near(asks: pd.DataFrame, pts: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(pts):
            return pd.DataFrame({"query": [], "point": [], "rough": []})
        codes = [np.frombuffer(b"".join(x), np.float16).reshape(-1, width).astype(np.float32) for x in (asks["qcode"], pts["code"])]
        pos, ids, names, at = pts["pos"].to_numpy(), pts["point"].to_numpy(), asks["query"].to_numpy(), asks["at"].to_numpy()
        out = []
        for i in range(0, len(names), 256):
            some = slice(i, i + 256)
            d = (codes[0][some] ** 2).sum(axis=1)[:, None] + (codes[1] ** 2).sum(axis=1)[None] - 2 * codes[0][some] @ codes[1].T
            d[np.abs(pos[None] - at[some, None]) > window] = np.inf
            best = np.argpartition(d, min(most, len(ids)) - 1, axis=1)[:, :most]
            made = pd.DataFrame({"query": np.repeat(names[some], best.shape[1]), "point": ids[best].ravel(), "rough": np.take_along_axis(d, best, 1).ravel()})
            out.append(made[np.isfinite(made["rough"])])
        return pd.concat(out)

    cells = ranks.withColumn("block", F.floor(F.col("pos") / block))
    found = queries.groupBy("qcurve", "qblock").cogroup(cells.groupBy("curve", "block")).applyInPandas(near, "query long, point long, rough float")
    merged = found.groupBy("query", "point").agg(F.min("rough").alias("rough"))
    merged = merged.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("rough", "point"))).filter(F.col("nth") <= most)
    merged = stored(merged.select("query", "point"), "candidates")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch.column(2), width), _matrix(batch.column(3), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.sqrt(((y - x) ** 2).sum(axis=1)))], names=["query", "point", "score"])

    vecs = classes.select("point", "vec")
    both = merged.join(vecs, "point").join(vecs.select(F.col("point").alias("query"), F.col("vec").alias("qvec")), "query")
    scored = in_batches(both.select("query", "point", "qvec", "vec"), exact, "query long, point long, score double")
    nth = F.row_number().over(Window.partitionBy("query").orderBy("score", "point"))
    scored = stored(scored.withColumn("nth", nth).filter(F.col("nth") <= k + 1).select("query", "point", "score"), "nearest")
    # points become rows again: the members of each, without the query's own
    rows_near = scored.join(members.select("point", "vec_id"), "point").join(asked.select("query_id", F.col("point").alias("query")), "query")
    rows_near = rows_near.filter(F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", "score").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return rows_near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), window
