"""Quality rules, the quality model, line dedup, sharding and mixing against plain Python and DuckDB."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import line_dedup, mixing, quality_model, quality_rules, sharding

from .conftest import WORD, words


def _base(text):
    w = words(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def test_base_counts(spark, odd_docs, no_docs, small):
    for docs in (odd_docs, spark.read.parquet(f"{small}/documents.parquet")):
        got = quality_rules.report(docs).collect()
        want = Counter((r.doc_id, *_base(r.text)) for r in docs.select("doc_id", "text").collect())
        assert Counter(tuple(r)[:7] for r in got) == want
        assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.report(no_docs).collect() == []


def test_rules_reject_junk_and_keep_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [(labels[r.doc_id], r.kept) for r in quality_rules.report(docs).collect() if r.doc_id in labels and not r.base_failed]
    good, junk = [k for q, k in got if q], [k for q, k in got if not q]
    assert sum(good) >= 0.97 * len(good) and sum(junk) <= 0.1 * len(junk)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == quality_rules.report(docs).filter("kept").count()


def test_rules_keep_clashing_columns(odd_docs):
    kept = quality_rules.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() <= odd_docs.count()


def test_sketch_is_near_the_quantile(spark):
    rows = spark.range(5000).select((F.col("id") % 997).alias("v"))
    kept = rows.select(quality_rules._cleared(F.col("v")).alias("b"), "v").collect()
    assert all(r.b <= r.v and (r.v - r.b) * 16 <= max(r.v, 1) for r in kept)


def test_model_tables():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3) | (x[:, 2] > 0.9)).astype(float)
    m = quality_model.PairwiseAdditive().fit(x[:2000], y[:2000])
    s = m.score(x[2000:])
    assert ((s >= 0.5) == y[2000:]).mean() > 0.9 and 0 <= s.min() and s.max() <= 1
    assert (0, 1) in m.links
    assert np.allclose(quality_model.PairwiseAdditive().fit(x[:0], y[:0]).score(x[:3]), 0.5)
    assert quality_model.PairwiseAdditive().fit(x[:9], np.ones(9)).score(x[:1])[0] > 0.8


def test_features_of_many_texts(spark, odd_texts, small, monkeypatch):
    """Whole buffers of texts give what one text at a time gives, whatever the buffers' size."""
    texts = [*odd_texts, "A B\n\n \nA B\nC", "a" * 16 + " b", "x\x0by\x0cz\r\nx", "one", *[r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]]
    want = np.array([quality_model.features(t) for t in texts])
    for size in (1 << 19, 3000):
        monkeypatch.setattr(quality_model, "CHUNK", size)
        assert np.allclose(quality_model.feature_rows(texts), want, rtol=1e-12, atol=1e-12)
    assert quality_model.feature_rows([]).shape == (0, len(quality_model.FEATURES))


def test_scores_by_plain_lookups(spark, small):
    """Every document's score is the logistic of the intercept and its bins' entries, looked up one by one."""
    import bisect
    import math

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.train(docs, labels)
    got = {r.doc_id: r for r in quality_model.scored(docs, model).collect()}
    for r in docs.select("doc_id", "text").collect():
        bins = [bisect.bisect_right(list(c), v) for c, v in zip(model.cuts, quality_model.features(r.text))]
        total = model.base + sum(t[b] for t, b in zip(model.tables, bins))
        step = -(-model.bins // model.coarse)
        total += sum(g[(bins[i] // step) * model.coarse + bins[j] // step] for (i, j), g in zip(model.links, model.grids))
        score = 1 / (1 + math.exp(-total))
        assert math.isclose(got[r.doc_id].score, score, rel_tol=1e-9) and got[r.doc_id].predicted == (score >= 0.3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_repeated_rows_train_once(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    once = quality_model.train(docs, labels)
    twice = quality_model.train(docs.union(docs), labels.union(labels))
    assert all(np.array_equal(a, b) for a, b in zip(once.tables + once.grids, twice.tables + twice.grids)) and once.base == twice.base


def test_model_on_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality_model.train(docs, labels)
    got = {r.doc_id: r for r in quality_model.scored(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(truth[i], got[i].predicted) for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(r.predicted == (r.score >= 0.3) for r in got.values()) and len(got) == docs.count()


def test_model_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 1, 0), (2, 0, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.train(odd_docs, labels)
    got = quality_model.scored(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_model.scored(no_docs, quality_model.train(no_docs, labels)).collect() == []


def _duck(spark, docs, sql):
    c = duckdb.connect()
    c.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    return c.sql(sql).fetchall()


BOILER = ["Share this page with all your friends today", "Copyright 2019 by the owners of this site", "Copyright 2021 by the owners of this site"]


def test_line_dedup(spark, odd_docs, no_docs):
    own = "abcdefgh"  # digits would count as variable fields
    rows = [(i, "\n".join([f"alpha{x} begins beta{x} here gamma{x}", BOILER[0], f"delta{x} goes on epsilon{x} there zeta{x}", f"Copyright {1990 + i} by the owners of this site", f"eta{x} ends theta{x} now iota{x}"])) for i, x in enumerate(own)]
    rows += [(100 + i, "one copied text of some words\nwith a second line of words\nand a third line of words") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.cleaned(docs).collect()}
    for i in range(8):
        assert len(got[i]) == 3 and BOILER[0] not in got[i] and not any(x.startswith("Copyright") for x in got[i])
    assert all(len(got[100 + i]) == 3 for i in range(20))  # copies are not boilerplate
    for d in (docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        assert sorted(map(tuple, line_dedup.report(d).collect())) == sorted(_duck(spark, d.select("doc_id", "text"), line_dedup.SQL))
    done = line_dedup.cleaned(odd_docs)
    assert done.count() == odd_docs.count() and done.filter("doc_id = 0 and text is not null").count() == 0
    assert line_dedup.report(no_docs).collect() == []


def _shards(docs):
    rows = docs.select("doc_id", "text").collect()
    got = sharding.by_bytes(docs).collect()
    sizes = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, sizes(r.text), zlib.crc32((r.text or "").encode())) for r in rows)
    slots, load = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return got, load


def test_shards(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got, load = _shards(docs)
    assert len(load) == 16 and max(load.values()) - min(load.values()) <= 2 * max(r.size for r in got)  # a document is whole
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert all(len(v) == 1 for v in where.values())
    _shards(odd_docs)
    assert sharding.by_bytes(no_docs).collect() == []


def test_shards_do_not_depend_on_settings(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    key = lambda df: sorted(map(repr, df.collect()))
    first = key(sharding.by_bytes(docs))
    spark.conf.set("spark.sql.shuffle.partitions", "700")
    try:
        assert key(sharding.by_bytes(docs.repartition(7))) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_shards_with_a_hot_text(spark):
    rows = [(i, "hot text " * 20 if i % 3 == 0 else f"text {i} " * 20) for i in range(6000)]
    _, load = _shards(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(load) == 16 and max(load.values()) <= 1.05 * min(load.values())


def _targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 3 * sizes[s]
            free.discard(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


@pytest.mark.parametrize("which", ["tables", "odd"])
def test_mixing(spark, odd_docs, which):
    docs = odd_docs if which == "odd" else spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    want = _targets(sizes)
    got = mixing.plan(docs.withColumn("whose", F.col("source")), keep=("whose",)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, len(words(r.text))) for r in rows)
    taken = Counter()
    for r in got:
        taken[r.whose] += r.taken
        assert r.source_size == sizes[r.whose] and abs(r.target - want[r.whose]) < 1e-6 * max(1, want[r.whose])
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(tuple, mixing.report(docs).collect()), key=repr) == sorted(map(tuple, mixing.report(docs.repartition(5)).collect()), key=repr)


def test_mixing_copies(spark, no_docs, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    copies = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    for r in mixing.report(docs).collect():
        assert copies[r.doc_id] == -(-r.taken // r.size if r.size else 0) or copies[r.doc_id] - r.taken / r.size < 2 and copies[r.doc_id] >= r.taken / r.size
    assert mixing.mixed(odd_docs).columns == odd_docs.columns
    assert mixing.report(no_docs).collect() == [] and mixing.mixed(no_docs).collect() == []


def test_schedule_integrates(spark):
    share = spark.range(0, 101).select((F.col("id") / 100).alias("s"), F.explode(F.array(*map(F.lit, range(3)))).alias("place"))
    for r in share.select("s", "place", mixing._position(F.col("s"), F.col("place")).alias("t")).collect():
        a, b = mixing.SLOPES[r.place]
        assert abs(a * r.t + (b - a) * r.t**2 / 2 - r.s) < 1e-9
