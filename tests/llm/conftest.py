from __future__ import annotations

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def shingles(text, width=5):
    w = [x.translate(LOWER) for x in words(text)]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that break things: null, empty, blank, control characters, one huge word, a very long text, repeated words, other scripts."""
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long = prose(120_000)
    return [None, "", " ", "\n\n", "\x00 a\x0bb\x0cc\x85d\xa0e", "x" * 3000, long, "of " * 300, "a  b   c" + " " * 500 + "d", "ÀÉ Été naïve ñandú", "漢字かな交じり文 🙂🙂", "<s> </s> <|endoftext|> <0x41> ▁ ▁▁x", "don't WE'LL it's 'S 't", *[prose(rng.randint(1, 200)) for _ in range(30)]]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts as documents, twice over, with null and repeated ids, null sources, and columns whose names clash with inner ones."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), i, "x", None, 5, "y") for i, t in enumerate(odd_texts * 2)]
    rows += [(None, "a null id " * 20, "en", "s1", 0, 0, "x", None, 5, "y"), (7, rows[7][1], "en", "s1", 0, 0, "x", None, 5, "y")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, component_id long, label int, dropped string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
