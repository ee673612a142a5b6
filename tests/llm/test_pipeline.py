"""The pipeline: every stage against plain Python on its own input, and the guard of the entry module."""

import os
import random
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from millrace.llm import line_dedup, mixing, oracles, quality_rules
from millrace.llm.common import stored

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def stages(spark, small):
    out = [spark.read.parquet(f"{small}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], small), name))
    return out


def _duck(docs, sql):
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    r = c.sql(sql)
    return [dict(zip(r.columns, x)) for x in r.fetchall()]


def test_columns(stages):
    assert all(set(df.columns) == set(stages[0].columns) for df in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "sentencepiece"]


def test_quality(stages):
    kept = {r["doc_id"] for r in _duck(stages[0], oracles.QUALITY_RULES) if r["kept"]}
    before = {r.doc_id: tuple(r) for r in stages[0].collect()}
    assert {r.doc_id: tuple(r) for r in stages[1].select(*stages[0].columns).collect()} == {i: before[i] for i in kept}


def test_lines(stages):
    import hashlib

    want = {r["doc_id"]: r["text_md5"] for r in _duck(stages[1], line_dedup.SQL)}
    assert {r.doc_id: hashlib.md5(r.text.encode()).hexdigest() for r in stages[2].collect()} == want
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near(stages):
    want = {r["doc_id"] for r in _duck(stages[2], oracles.NEAR_DEDUP) if r["kept"]}
    before = {r.doc_id: r.text for r in stages[2].collect()}
    assert {r.doc_id: r.text for r in stages[3].collect()} == {i: before[i] for i in want}


def test_mix(stages):
    taken = {r["doc_id"]: r for r in _duck(stages[3], oracles.MIXING)}
    copies = Counter(r.doc_id for r in stages[4].collect())
    text = {r.doc_id: r.text for r in stages[3].collect()}
    assert all(r.text == text[r.doc_id] for r in stages[4].collect())
    for i, r in taken.items():
        assert (copies[i] == 0) == (r["taken"] == 0) and 0 <= copies[i] * r["size"] - r["taken"] < r["size"] + (r["size"] == 0)


def test_tokens(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r.doc_id, tuple([1, *library.encode(r.text), 2])) for r in stages[4].collect())
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in stages[5].collect()) == want


def test_run(spark, small, stages):
    key = lambda rows: sorted((r.doc_id, tuple(r.token_ids)) for r in rows)
    assert key(corpus_pipeline.run(spark, small).collect()) == key(stages[5].collect())
    assert corpus_pipeline.ORACLE_SQL is None


def _rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_odd_tables(spark, odd_docs, no_docs):
    """Nulls, empty and very long texts, repeated rows, extra and clashing columns, and no rows, stage by stage."""
    extra = odd_docs.withColumns({"_row": odd_docs.key, "_n_dropped": odd_docs.label, "__text": odd_docs.key, "_name1": odd_docs.label})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, extra, "")
        assert out.columns == extra.columns, name
        got = out.collect()
        if name != "line_dedup":
            assert {repr(tuple(r)) for r in got} <= {repr(tuple(r)) for r in extra.collect()}, name
        slim = stage(spark, odd_docs.select("doc_id", "text", "lang", "source", "n_chars"), "")
        assert _rows(out.select("doc_id", "text", "lang", "source", "n_chars")) == _rows(slim), name
        if name == "quality_rules":
            assert all(len((r.text or "").split()) >= 50 for r in got)
        elif name == "line_dedup":
            assert len(got) == extra.count()
        assert stage(spark, no_docs, "").collect() == [] and stage(spark, no_docs, "").columns == no_docs.columns, name
    out = corpus_pipeline.STAGES[4][1](spark, extra, "")
    assert out.count() == extra.count() and corpus_pipeline.STAGES[4][1](spark, no_docs, "").collect() == []


def test_rows_that_repeat_an_id_are_judged_by_their_own_text(spark):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80))
    rows = [(1, prose, "en", None), (1, "short", "en", None), (1, prose, None, "en"), (None, prose, "en", None), (None, None, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted((r.doc_id or 0, r.lang or "", len(r.text)) for r in quality_rules.keep_good(docs).collect()) == sorted([(1, "en", len(prose)), (1, "", len(prose)), (0, "en", len(prose))])


def test_entry_without_the_corpus_operators(tmp_path):
    """The rest imports when these folders and the pipeline are gone."""
    for name in ("millrace", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "millrace/llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'distinct_first' in q and not any(x.startswith('op') and x[2].isdigit() or x == 'pipeline' for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_mixing_is_the_same_anew(spark, stages):
    a = mixing.report(stages[3]).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, mixing.report(stages[3]).collect()))
    assert quality_rules.report(stages[3]).count() == stages[3].count()
