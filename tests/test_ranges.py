"""Ranges of bounded size, runs that cross them, and tasks that hold one range each."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from millrace.flow import Flow
from millrace.operators import aggregate, ranges
from millrace.operators.ranges import PART, Ranges


@pytest.mark.parametrize("values", ["a", "ab", "abc", [None, "a"]])
def test_runs_over_many_ranges(spark, monkeypatch, values):
    """A task holds one range of about so many rows, however many there are; runs may cover several ranges."""
    monkeypatch.setattr(ranges, "ROWS", 40)
    rng = random.Random(5)
    rows, v = [], values[0]
    for i in range(500):
        v = rng.choice(values) if rng.random() < 0.04 else v
        rows.append((i, v))
    flow = Flow(spark.createDataFrame(rows, "i long, v string").repartition(3), ("i",))
    r = Ranges(flow).neighbour(["v"])
    assert r.parts == 13 and max(r.counts.values()) < 120
    tasks = r.df.select(PART, F.spark_partition_id().alias("task"), "__near").distinct().select(PART, "task").distinct().collect()
    assert len(tasks) == len({t.task for t in tasks}) == len(r.counts)
    got = aggregate.count_consecutive(["v"], "n")(flow).df
    want = [(i + 1, k, len(list(g))) for i, (k, g) in enumerate(groupby(x for _, x in rows))]
    assert [(x.run, x.v, x.n) for x in got.orderBy("run").collect()] == want
    assert aggregate.count_consecutive(["v"], "n")(flow.with_df(flow.df.limit(0))).df.count() == 0
