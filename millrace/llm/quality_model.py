"""A quality classifier: a generalised additive model with pairwise interactions, learnt as lookup tables.

Features are cut into quantile bins. Boosting goes round the features in a cycle; each step fits a shallow tree of one
feature to the gradient of the log loss, from histograms of its bins, and adds it to the feature's table. Then the
pairs of features whose coarse grids explain most of what is left get tables of their own in the same way. A score is
the logistic of the intercept and the sum of the looked-up entries: vectorised bin additions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK, hash_spans, in_batches, mix64, word_spans

#: Labelled rows that the model is fitted to, at most (a documented bound; those of least hash of the id).
TRAIN_ROWS = 20_000
#: Predicted 1 from this score on.
THRESHOLD = 0.3
#: One of so many folds by crc32 of the id is held out.
FOLDS = 5

# -- features ----------------------------------------------------------------------------------

FEATURES = ["log_words", "word_bytes", "upper", "digit", "symbol", "pipe", "bang", "punct", "non_ascii", "distinct", "top_word", "repeat_pairs", "dup_lines", "words_a_line", "long_words"]
_KINDS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!", b".,;:?'\"()-"), 1):
    _KINDS[list(_chars)] = _k
_KINDS[128:] = 7


def features(text: str | None) -> list[float]:
    """Measures of a whole text, each a rate or a mean so that its length matters only where it is asked for. Null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=8)
    inked = sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    return [
        float(np.log1p(n)),
        inked / n,
        kinds[1] / inked,
        kinds[2] / inked,
        kinds[3] / n,
        kinds[4] / n,
        kinds[5] / n,
        kinds[6] / n,
        kinds[7] / inked,
        len(counts) / n**0.8,
        max(counts.values()) / n,
        1 - len(set(pairwise(words))) / (n - 1) if n > 1 else 0.0,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        sum(1 for w in words if len(w) > 15) / n,
    ]


def feature_rows(texts: list[str | None]) -> np.ndarray:
    """The features of many texts, a row each: the same as `features` gives, by sums and runs over whole buffers of text.

    Words, pairs of words and lines of a text are told apart by 52-bit hashes. Texts over CHUNK bytes are measured one by one, so that buffers stay bounded.
    """
    out = np.zeros((len(texts), len(FEATURES)))
    held: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > CHUNK:
            out[i] = features(text)
            continue
        held.append((i, raw))
        size += len(raw) + 1
        if size >= CHUNK or len(held) == 1 << _TEXTS_BITS:
            _measure(held, out)
            held, size = [], 0
    if held:
        _measure(held, out)
    return out


#: Texts of a buffer at most: their numbers take the upper bits of sorted keys, beside as many bits of a hash as are left.
_TEXTS_BITS = 12


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of items by owner: how many distinct hashes each of n owners has, and how often its most frequent one comes."""
    keys = np.sort(owner.astype(np.uint64) << np.uint64(64 - _TEXTS_BITS) | hashes >> np.uint64(_TEXTS_BITS))
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    of = (keys[begins] >> np.uint64(64 - _TEXTS_BITS)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, np.diff(np.append(begins, len(keys))))
    return np.bincount(of, minlength=n), most


def _measure(held: list[tuple[int, bytes]], out: np.ndarray) -> None:
    """Fill the rows of some texts, which are joined by line ends into one buffer."""
    n = len(held)
    buf = np.frombuffer(b"\n".join(raw for _, raw in held) + b"\n", np.uint8)
    bounds = np.cumsum([0] + [len(raw) + 1 for _, raw in held])

    def by_text(at: np.ndarray, worth: np.ndarray | None = None) -> np.ndarray:
        total = np.append(0, np.cumsum(np.ones(len(at), np.int64) if worth is None else worth))
        return np.diff(total[np.searchsorted(at, bounds)])

    starts, ends = word_spans(buf)
    words = by_text(starts)
    hashes = hash_spans(buf, starts, ends)
    owner = np.repeat(np.arange(n), words)
    distinct, top = _distinct(owner, hashes, n)
    together = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = _distinct(owner[together], mix64(hashes[together] * np.uint64(0x9E3779B97F4A7C15) + mix64(hashes[together + 1])), n)[0]
    line_end = np.flatnonzero(buf == 10)
    line_start = np.append(0, line_end[:-1] + 1)
    full = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[full], line_end[full]
    lines = by_text(line_start)
    own_lines = _distinct(np.repeat(np.arange(n), lines), hash_spans(buf, line_start, line_end), n)[0]
    kind = np.bincount(np.repeat(np.arange(0, 8 * n, 8), np.diff(bounds)) + _KINDS[buf], minlength=8 * n).reshape(n, 8).T
    w, inked, some = np.maximum(words, 1), np.maximum(by_text(starts, ends - starts), 1), np.maximum(lines, 1)
    rows = np.stack(
        [
            np.log1p(words),
            by_text(starts, ends - starts) / w,
            kind[1] / inked,
            kind[2] / inked,
            kind[3] / w,
            kind[4] / w,
            kind[5] / w,
            kind[6] / w,
            kind[7] / inked,
            distinct / w**0.8,
            top / w,
            np.where(words > 1, 1 - pairs / np.maximum(words - 1, 1), 0),
            1 - own_lines / some,
            words / some,
            by_text(starts, ends - starts > 15) / w,
        ],
        axis=1,
    )
    out[[i for i, _ in held]] = np.where(words[:, None] > 0, rows, 0.0)


# -- model -------------------------------------------------------------------------------------


@dataclass
class PairwiseAdditive:
    """Intercept, cut points and lookup tables; picklable and small (a few thousand numbers)."""

    bins: int = 64
    coarse: int = 8
    rounds: int = 150
    pairs: int = 6
    rate: float = 0.1
    l2: float = 1.0
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    links: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def _cut(self, v: np.ndarray) -> np.ndarray:
        """Cut points at quantiles of the rows, at quantiles of the distinct values (many rows may be 0), and at equal distances."""
        third = (self.bins - 1) // 3
        shares = np.linspace(0, 1, third + 2)[1:-1]
        return np.unique(np.concatenate([np.quantile(v, shares), np.quantile(np.unique(v), shares), v.min() + (v.max() - v.min()) * shares]))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1) if len(self.cuts) else np.zeros((len(x), 0), int)

    def _cell(self, b: np.ndarray, i: int, j: int) -> np.ndarray:
        step = -(-self.bins // self.coarse)
        return (b[:, i] // step) * self.coarse + b[:, j] // step

    def _leaf(self, g: float, h: float) -> float:
        return -g / (h + self.l2)

    def _gain(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + self.l2)

    def _step(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree of depth two over ordered bins: the best cut, then the best cut of either side."""
        out = np.zeros(len(g))

        def best(a: int, b: int) -> int | None:
            if b - a < 2:
                return None
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            left = self._gain(cg[:-1], ch[:-1]) + self._gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
            k = int(np.argmax(left))
            return a + k + 1 if left[k] > self._gain(cg[-1], ch[-1]) + 1e-9 else None

        def fill(a: int, b: int, depth: int) -> None:
            cut = best(a, b) if depth else None
            if cut is None:
                out[a:b] = self._leaf(g[a:b].sum(), h[a:b].sum())
            else:
                fill(a, cut, depth - 1)
                fill(cut, b, depth - 1)

        fill(0, len(g), 2)
        return out

    def _grid_step(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree of depth two over a grid: a cut of one axis, then of the other on either side."""
        g, h = g.reshape(self.coarse, self.coarse), h.reshape(self.coarse, self.coarse)

        def halves(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
            cg, ch = np.cumsum(a), np.cumsum(b)
            score = self._gain(cg[:-1], ch[:-1]) + self._gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
            k = int(np.argmax(score))
            out = np.full(len(a), self._leaf(cg[-1] - cg[k], ch[-1] - ch[k]))
            out[: k + 1] = self._leaf(cg[k], ch[k])
            return float(score[k]), out

        found = (-1.0, np.zeros_like(g))
        for axis in (0, 1):
            gg, hh = (g, h) if axis == 0 else (g.T, h.T)
            for cut in range(1, self.coarse):
                s1, low = halves(gg[:cut].sum(0), hh[:cut].sum(0))
                s2, high = halves(gg[cut:].sum(0), hh[cut:].sum(0))
                if s1 + s2 > found[0]:
                    table = np.concatenate([np.tile(low, (cut, 1)), np.tile(high, (self.coarse - cut, 1))])
                    found = (s1 + s2, table if axis == 0 else table.T)
        return found[1].ravel()

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseAdditive:
        """Fit to rows of features and 0/1 labels. With no rows, or one label only, every score is the smoothed rate."""
        n = len(y)
        p = (y.sum() + 1) / (n + 2)
        self.base = float(np.log(p / (1 - p)))
        if n == 0 or y.min() == y.max():
            return self
        self.cuts = [self._cut(x[:, j]) for j in range(x.shape[1])]
        b = self._binned(x)
        self.tables = [np.zeros(self.bins) for _ in self.cuts]
        f = np.full(n, self.base)
        for _ in range(self.rounds):
            for j, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-f))
                step = self.rate * self._step(np.bincount(b[:, j], p - y, self.bins), np.bincount(b[:, j], p * (1 - p), self.bins))
                table += step
                f += step[b[:, j]]
        p = 1 / (1 + np.exp(-f))
        cells = self.coarse**2
        worth = []
        for i, j in combinations(range(len(self.cuts)), 2):
            c = self._cell(b, i, j)
            worth.append((float(self._gain(np.bincount(c, p - y, cells), np.bincount(c, p * (1 - p), cells)).sum()), i, j))
        self.links = [(i, j) for _, i, j in sorted(worth, reverse=True)[: self.pairs]]
        self.grids = [np.zeros(cells) for _ in self.links]
        at = [self._cell(b, i, j) for i, j in self.links]
        for _ in range(self.rounds // 3):
            for c, grid in zip(at, self.grids):
                p = 1 / (1 + np.exp(-f))
                step = self.rate * self._grid_step(np.bincount(c, p - y, cells), np.bincount(c, p * (1 - p), cells))
                grid += step
                f += step[c]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        if len(self.cuts) and len(x):
            b = self._binned(x)
            for j, table in enumerate(self.tables):
                f += table[b[:, j]]
            for (i, j), grid in zip(self.links, self.grids):
                f += grid[self._cell(b, i, j)]
        return 1 / (1 + np.exp(-f))


# -- Spark -------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Whether an id's crc32 as text leaves no remainder; a null id counts as held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = feature_rows(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.float64()))], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = TRAIN_ROWS) -> PairwiseAdditive:
    """Fit to labelled documents outside the held-out fold, at most `rows` of them; null labels and labels without a document don't count.

    Rows that repeat an id and a label count once, with the least of the id's texts; an id with both labels counts with each.
    """
    known = labels.select(labels["doc_id"].alias("_id"), labels[label_col].cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))).distinct()
    some = known.orderBy(F.xxhash64("_id"), "_id", "label").limit(rows)
    texts = docs.join(F.broadcast(some), docs["doc_id"] == some["_id"]).groupBy(some["_id"], some["label"]).agg(F.min(docs["text"]).alias("text")).select("label", "text")
    got = in_batches(texts, _measured, "label int, x array<double>").collect()
    data = sorted((tuple(r.x), r.label) for r in got)
    return PairwiseAdditive().fit(np.array([x for x, _ in data]).reshape(len(data), len(FEATURES)), np.array([y for _, y in data], float))


def scored(docs: DataFrame, model: PairwiseAdditive, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for every row; one pass over whole texts, no shuffle.

    Null texts score as empty ones; rows that repeat an id score each by its own text. Other columns, whatever their names, play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                s = model.score(feature_rows(part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), "text")
    schema = T.StructType([source.schema[0], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return in_batches(source, run, schema)
