"""What the corpus operators share: word rules and batched text hashing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import hinted, scratch_path, stored

__all__ = ["CHUNK", "LOWER", "SPACE", "WORD", "cut_text", "hash_spans", "hinted", "in_batches", "mix64", "run_sums", "scratch_path", "shingle_hashes", "stored", "word_hashes", "word_spans", "words"]

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


#: Bytes of a batch of rows that passes to Python, at most (a single row may be larger).
BATCH_BYTES = 2 << 20


def in_batches(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """mapInArrow over batches of bounded bytes: texts differ in length by orders, so a number of rows bounds nothing.

    The bound is a setting of the session; a lower one that is set already stays.
    """
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    held = re.match(r"(\d+)([kmg]?)", conf.get(name).lower())
    if int(held[1]) * 1024 ** " kmg".index(held[2] or " ") > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


# -- vectorised hashing of words over UTF-8 bytes ----------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: list[np.ndarray] = []
#: Bytes hashed at once; longer texts are cut at white space and their word hashes joined.
CHUNK = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bijection on 64-bit words (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = max(n, CHUNK + (1 << 16))
        one = np.full(size, _BASE, np.uint64)
        back = np.full(size, inverse, np.uint64)
        one[0] = back[0] = 1
        _POWERS[:] = [np.cumprod(one, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a buffer."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: differences of a prefix polynomial, shifted back to power 0, then mixed."""
    power, back = _powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
    raw = (total[ends] - total[starts]) * back[starts]
    return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A prefix polynomial over hashes, and the factors that shift back: (total[end] - total[start]) * back[start] is a run's hash before mixing."""
    power, back = _powers(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * power[: len(x)], out=total[1:])
    return total, back


def cut_text(raw: bytes) -> Iterator[bytes]:
    """Cut a long text at white space into pieces of about CHUNK bytes, words whole."""
    at = 0
    while len(raw) - at > CHUNK:
        cut = at + CHUNK
        back = max(raw.rfind(c, at + 1, cut) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if back <= at:  # one word longer than a piece: go on to its end
            hits = [x for x in (raw.find(c, cut) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0]
            back = min(hits, default=len(raw))
        yield raw[at:back]
        at = back
    yield raw[at:]


def word_hashes(texts: list[str | None], lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """For each text in order, its index and the 64-bit hashes of its words (A-Z lower-cased first).

    Texts are hashed together in buffers of about a megabyte; memory is bounded whatever a text's length.
    """
    group: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        buf = np.frombuffer(b" ".join(raw for _, raw in group), np.uint8)
        if lower:
            buf = LOWER[buf]
        starts, ends = word_spans(buf)
        hashes = hash_spans(buf, starts, ends)
        offsets = np.cumsum([0] + [len(raw) + 1 for _, raw in group])
        cuts = np.searchsorted(starts, offsets)
        for (i, _), a, b in zip(group, cuts[:-1], cuts[1:]):
            yield i, hashes[a:b]

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > CHUNK:
            if group:
                yield from flush()
                group, held = [], 0
            parts = []
            for piece in cut_text(raw):
                buf = np.frombuffer(piece, np.uint8)
                buf = LOWER[buf] if lower else buf
                starts, ends = word_spans(buf)
                parts.append(hash_spans(buf, starts, ends))
            yield i, np.concatenate(parts)
            continue
        group.append((i, raw))
        held += len(raw) + 1
        if held >= CHUNK:
            yield from flush()
            group, held = [], 0
    if group:
        yield from flush()


_STEP = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingle_hashes(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """A hash for each run of `width` words by position; fewer words give one hash of the whole sequence, none give none."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(n, width)
    total = np.full(n - size + 1, np.uint64(size), np.uint64)
    for j in range(size):
        total += hashes[j : n - size + 1 + j] * _STEP[j]
    return mix64(total)
