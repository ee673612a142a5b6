"""SentencePiece and token files: exact ids, exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import sentencepiece_codec, token_store

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def _check(library, texts):
    c = sentencepiece_codec.codec(PIECES)
    got = list(c.encode(texts, ends=True))
    want = [[1, *library.encode(t or ""), 2] for t in texts]
    assert [x.tolist() for x in got] == want
    assert c.decode(got) == [library.decode(x) for x in want]


def test_odd_texts(library, odd_texts):
    _check(library, odd_texts)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from(list(" ▁abtheingTHE.,\n\t0é漢🙂\x00<s>")), max_size=60), max_size=8))
def test_any_text(texts):
    _check(sentencepiece.SentencePieceProcessor(model_file=PIECES), texts)


def test_long_texts_are_cut_where_nothing_merges(library):
    rng = random.Random(2)
    text = "".join(rng.choice(["the ", "  ", "inging", "\n", "é", "x" * 50, " " * 40]) for _ in range(60_000))
    assert len(text) > 2 * sentencepiece_codec.CHARS
    _check(library, [text, "short", text[:1000]])


def test_decoding_any_ids(library):
    rng = random.Random(3)
    c = sentencepiece_codec.codec(PIECES)
    for _ in range(500):
        ids = [rng.randrange(32_000) if rng.random() < 0.3 else rng.randrange(1, 259) for _ in range(rng.randrange(12))]
        assert c.decode([np.array(ids, np.int64)]) == [library.decode(ids)]


def test_round_trip_rows(spark, library, odd_docs, no_docs):
    rows = sorted(odd_docs.select("doc_id", "text").collect(), key=repr)
    got = sentencepiece_codec.round_trip(odd_docs, PIECES).collect()
    want = []
    for r in rows:
        ids = [1, *library.encode(r.text or ""), 2]
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sentencepiece_codec.round_trip(no_docs, PIECES).collect() == []
    ids = {r.doc_id: r.token_ids for r in sentencepiece_codec.encode_documents(odd_docs, PIECES).collect()}
    assert ids[0] == [1, 2]


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 24, 31, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    raw = token_store.pack(ids, bits)
    assert len(raw) == -(-1000 * bits // 8)
    for a, n in ((0, 1000), (17, 5), (999, 1), (3, 0)):
        assert (token_store.unpack(raw, bits, a, n) == ids[a : a + n]).all()
    if bits < 32:
        with pytest.raises(ValueError):
            token_store.pack(np.array([1 << bits], np.uint32), bits)


def test_bits():
    assert [token_store.bits_for(n) for n in (1, 2, 3, 256, 257, 49_408, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_file(tmp_path):
    rng = np.random.default_rng(4)
    docs = [(i if i else None, rng.integers(0, 49_408, int(n)).astype(np.uint32)) for i, n in enumerate([0, 5, 20_000, 1, 8192, 0])]
    w = token_store.TokenWriter(f"file://{tmp_path}/a/x.tok", 16)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    r = token_store.TokenReader(f"file://{tmp_path}/a/x.tok")
    flat = np.concatenate([x for _, x in docs])
    assert r.docs == [d for d, _ in docs] and all((r.document(k) == x).all() for k, (_, x) in enumerate(docs))
    assert (r.ids(8190, 8200) == flat[8190:8200]).all() and (r.ids(0, r.n) == flat).all()
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["x.tok"]


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from(list(" aBcZ'sStTlLrRevmM.,!<|>_éÉİ́̈Σσ中0\n\x0b\x1c\x85\xa0")), max_size=40), max_size=6))
def test_words_encode_as_whole_texts(texts):
    e = token_store.encoder(WORDS)
    assert [x.tolist() for x in e.encode(texts, 1)] == [[*e.whole(t), 1] for t in texts]


def test_memory_starts_anew(odd_texts, monkeypatch):
    e = token_store.WordEncoder(WORDS)
    monkeypatch.setattr(e, "MOST", 50)
    for t in odd_texts:
        assert [x.tolist() for x in e.encode([t], 1)] == [[*e.whole(t), 1]]


def test_digest_rows(spark, odd_docs, no_docs):
    e = token_store.encoder(WORDS)
    rows = odd_docs.select("doc_id", "text").collect()
    got = token_store.token_digest(odd_docs, WORDS).orderBy("start").collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert [key(r) for r in got] == sorted(key(r) for r in got)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    sums = lambda t: zlib.crc32(np.array([*e.whole(t), 1], "<u4").tobytes())
    assert sorted(((r.doc_id, r.ids_crc32) for r in got), key=repr) == sorted(((r.doc_id, sums(r.text)) for r in rows), key=repr)
    assert token_store.token_digest(no_docs, WORDS).collect() == []
