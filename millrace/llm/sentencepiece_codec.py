"""SentencePiece BPE encoding and decoding in numpy, without a Python loop over words or symbols.

Texts become one flat array of code points. It is cut wherever two neighbouring characters occur side by side
in no vocabulary piece, as no merge can cross such a place; equal segments are encoded once a batch. Then
come rounds: the rank of every adjacent pair, the least rank of each segment by a segmented minimum, and all
leftmost non-overlapping pairs of that rank merge together; finished segments leave the arrays, until no pair
is left. A round is exact when no pair that a merge creates can rank at or before the merged pair itself. The pieces for
which that can fail are known from the vocabulary: of these only a segment's leftmost pair merges in a round. Pieces
whose scores tie (runs of the space mark) and long segments of that kind finish in an exact sequential merge.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_batches, mix64

MARK = "▁"
_NONE = np.int64(1) << 40
#: Characters encoded at once.
CHARS = 1 << 18
#: Symbols beyond which a segment with order-dependent merges is finished sequentially.
LONG = 48


def _utf8(cp: int) -> bytes:
    return chr(cp).encode("utf-8", "surrogatepass")


class PieceCodec:
    """Tables of a SentencePiece BPE model with byte fallback and the identity normaliser."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or not train.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only the identity normaliser with a leading space mark is supported")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.size = len(model.pieces)
        text = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        score = {i: p.score for i, p in enumerate(model.pieces) if p.type == 1}
        self.bos = next((i for i, p in enumerate(model.pieces) if p.piece == "<s>"), -1)
        self.eos = next((i for i, p in enumerate(model.pieces) if p.piece == "</s>"), -1)
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        # single characters: piece ids; every other character is itself, beyond the vocabulary
        self.char = np.arange(0x110000, dtype=np.int64) + self.size
        for piece, i in text.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        # which characters stand side by side within some piece
        chars = sorted({c for p in text for c in p})
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in text:
            k = self.kind[[ord(c) for c in p]]
            self.beside[k[:-1], k[1:]] = True
        symbol = {p: i for p, i in text.items()}
        for c in chars:
            symbol.setdefault(c, self.size + ord(c))
        keys, ranks, made = [], [], []
        for p, i in text.items():
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    ranks.append(order[score[i]])
                    made.append(i)
        at = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[at], np.int64(1) << 62)
        self.ranks = np.append(np.array(ranks, np.int64)[at], _NONE)
        self.made = np.append(np.array(made, np.int64)[at], -1)
        # pieces that can take part in a pair ranking at or before themselves
        first = np.full(self.size, _NONE)
        for key, rank in zip(keys, ranks):
            for part in (key >> 32, key & 0xFFFFFFFF):
                if part < self.size:
                    first[part] = min(first[part], rank)
        own = np.full(self.size, _NONE)
        for i, s in score.items():
            own[i] = order[s]
        normal = np.array(list(score))
        self.careful = np.zeros(self.size, bool)
        self.careful[normal] = (first <= own)[normal]
        self.tied = np.zeros(self.size, bool)
        self.tied[normal] = np.bincount(own[normal])[own[normal]] > 1
        # bytes
        self.byte = np.full(256, -1, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte[int(p.piece[1:-1], 16)] = i
        # what each id decodes to
        self.is_byte = np.array([p.type == 6 for p in model.pieces])
        self.silent = np.array([p.type == 3 for p in model.pieces])
        self.marked = np.array([p.type == 1 and p.piece.startswith(MARK) for p in model.pieces])
        spelt = []
        for p in model.pieces:
            if p.type == 6:
                spelt.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == 3:
                spelt.append(b"")
            elif p.type == 2:
                spelt.append((train.unk_surface or " ⁇ ").encode())
            else:
                spelt.append(p.piece.replace(MARK, " ").encode())
        self.spelt_at = np.cumsum([0] + [len(x) for x in spelt])
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)

    # -- encoding ------------------------------------------------------------------------------

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a << np.int64(32)) | b
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), np.where(hit, self.made[at], -1)

    def _finish(self, symbols: list[int]) -> list[int]:
        """Exact sequential merging of one segment: least rank first, then leftmost."""
        table = self._pairs()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and (hit := table.get((symbols[i] << 32) | symbols[j])) is not None:
                heapq.heappush(heap, (hit[0], i, j, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if not (live[i] and live[j]) or symbols[i] != a or symbols[j] != b or after[i] != j:
                continue
            symbols[i] = table[(a << 32) | b][1]
            live[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s, x in zip(symbols, live) if x]

    def _pairs(self) -> dict[int, tuple[int, int]]:
        if not hasattr(self, "_table"):
            self._table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        return self._table

    def _merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge flat segments until no pair is left; returns the symbols and the number of each segment's."""
        n = len(symbols)
        out, alive = symbols.copy(), np.ones(n, bool)
        sizes = np.diff(np.append(starts, n))
        home = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(n)
        cur, seg = symbols, home
        rank, made = self._rank(cur, seg)
        redo: list[np.ndarray] = []
        while len(cur):
            heads = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            least = np.minimum.reduceat(rank, heads)
            lens = np.diff(np.append(heads, len(cur)))
            low = np.repeat(least, lens)
            hit = rank == low
            live = least < _NONE
            hit &= low < _NONE
            spot = np.flatnonzero(hit)
            kind = made[spot]
            doubt = self.careful[kind] | self.tied[kind]
            if doubt.any():
                # of these only the leftmost merges now; ties and long segments finish sequentially
                own = np.cumsum(np.append(True, seg[1:] != seg[:-1]))[spot] - 1
                late = np.append(False, own[1:] == own[:-1])
                slow = doubt & (self.tied[kind] | (lens[own] > LONG))
                hit[spot[doubt & late]] = False
                if slow.any():
                    redo.append(seg[spot[slow]])
                    live[own[slow]] = False
            # finished segments, and those that need the sequential way, leave
            go = np.repeat(live, lens)
            if not go.all():
                cur, seg, at, rank, made, hit = (x[go] for x in (cur, seg, at, rank, made, hit))
                if not len(cur):
                    break
            # leftmost first within each run of neighbouring pairs: every other one from the run's start
            spot = np.flatnonzero(hit)
            fresh = np.append(True, (spot[1:] != spot[:-1] + 1))
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(spot)), 0))
            spot = spot[((np.arange(len(spot)) - start) & 1) == 0]
            merged = made[spot]
            cur[spot] = merged
            out[at[spot]] = merged
            alive[at[spot + 1]] = False
            keep = np.ones(len(cur), bool)
            keep[spot + 1] = False
            moved = np.cumsum(keep) - 1
            spot = moved[spot]
            cur, seg, at, rank, made = (x[keep] for x in (cur, seg, at, rank, made))
            near = np.zeros(len(cur), bool)
            near[spot] = True
            near[spot[spot > 0] - 1] = True
            touch = np.flatnonzero(near)
            rank[touch], made[touch] = self._rank_at(cur, seg, touch)
        counts = np.bincount(home[alive], minlength=len(starts))
        flat = out[alive]
        if redo:
            tops = np.append(0, np.cumsum(counts))
            parts, last = [], 0
            for s in np.unique(np.concatenate(redo)):
                a, b = tops[s], tops[s + 1]
                done = self._finish(flat[a:b].tolist())
                parts += [flat[last:a], np.array(done, np.int64)]
                counts[s], last = len(done), b
            flat = np.concatenate([*parts, flat[last:]])
        return flat, counts

    def _rank(self, cur: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(cur), _NONE), np.full(len(cur), -1, np.int64)
        inner = np.flatnonzero(seg[1:] == seg[:-1])
        rank[inner], made[inner] = self._look_up(cur[inner], cur[inner + 1])
        return rank, made

    def _rank_at(self, cur: np.ndarray, seg: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(at), _NONE), np.full(len(at), -1, np.int64)
        ok = at + 1 < len(cur)
        ok[ok] = seg[at[ok]] == seg[at[ok] + 1]
        rank[ok], made[ok] = self._look_up(cur[at[ok]], cur[at[ok] + 1])
        return rank, made

    def _expand(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary become the ids of their UTF-8 bytes."""
        odd = np.flatnonzero(flat >= self.size)
        if not len(odd):
            return flat, counts
        points, back = np.unique(flat[odd] - self.size, return_inverse=True)
        spelt = [self.byte[list(_utf8(int(cp)))] for cp in points]
        lens = np.ones(len(flat), np.int64)
        lens[odd] = np.array([len(x) for x in spelt])[back]
        seg = np.repeat(np.arange(len(counts)), counts)
        out = np.repeat(flat, lens)
        tops = np.cumsum(lens) - lens
        for k in range(4):
            has = odd[lens[odd] > k]
            out[tops[has] + k] = np.array([x[k] if len(x) > k else 0 for x in spelt])[back[lens[odd] > k]]
        return out, np.bincount(seg, weights=lens, minlength=len(counts)).astype(np.int64)

    def _encode_flat(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised parts, joined, and the end of each part's."""
        sizes = np.array([len(p) for p in parts])
        cp = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = len(cp)
        if not n:
            return np.empty(0, np.int64), np.zeros(len(parts), np.int64)
        kind = self.kind[cp]
        cut = np.empty(n, bool)
        cut[0] = True
        cut[1:] = ~self.beside[kind[:-1], kind[1:]]
        ends = np.cumsum(sizes)
        cut[(ends - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        lens = np.diff(np.append(starts, n))
        # equal segments once: grouped by hash, then compared character by character
        total = np.append(np.uint64(0), np.cumsum(mix64(cp.astype(np.uint64) + np.uint64(1)) * (np.uint64(2) * (np.arange(n, dtype=np.uint64) - np.repeat(starts, lens).astype(np.uint64)) + np.uint64(1)) , dtype=np.uint64))
        key = mix64(total[starts + lens] - total[starts] + lens.astype(np.uint64))
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        off = np.arange(n) - np.repeat(starts, lens)
        model = starts[first][back]
        same = lens[first][back] == lens
        ok = np.logical_and.reduceat(cp == cp[np.minimum(np.repeat(model, lens) + off, n - 1)], starts) & same
        if not ok.all():
            lone = np.flatnonzero(~ok)
            back = back.copy()
            back[lone] = len(first) + np.arange(len(lone))
            first = np.append(first, lone)
        ulen = lens[first]
        ustart = np.cumsum(ulen) - ulen
        pick = np.repeat(starts[first] - ustart, ulen) + np.arange(ulen.sum())
        flat, counts = self._merge(self.char[cp[pick]], ustart)
        flat, counts = self._expand(flat, counts)
        tops = np.cumsum(counts) - counts
        each = counts[back]
        stop = np.cumsum(each)
        ids = flat[np.repeat(tops[back] - (stop - each), each) + np.arange(stop[-1])]
        owner = np.searchsorted(starts, ends)  # segments before each part's end
        return ids, np.append(0, stop)[owner]

    def encode(self, texts: list[str | None], ends: bool = False) -> Iterator[np.ndarray]:
        """Ids of each text in order, with begin and end ids if `ends`. Nulls count as empty; an empty text has no ids of its own."""
        jobs: list[tuple[int, str, bool]] = []  # text, part, last of its text
        held = 0
        rest: list[np.ndarray] = []

        def flush() -> Iterator[np.ndarray]:
            ids, tops = self._encode_flat([p for _, p, _ in jobs])
            a = 0
            for (_, _, last), b in zip(jobs, tops):
                rest.append(ids[a:b])
                a = b
                if last:
                    body = np.concatenate(([np.array([self.bos])] if ends else []) + rest + ([np.array([self.eos])] if ends else [])).astype(np.uint32)
                    rest.clear()
                    yield body

        for i, text in enumerate(texts):
            plain = MARK + text.replace(" ", MARK) if text else ""
            at = 0
            while True:
                # a long text is cut before a space mark that follows another character: no piece spans that
                stop = len(plain)
                if stop - at > CHARS:
                    stop = plain.rfind(MARK, at + 1, at + CHARS)
                    while stop > at and plain[stop - 1] == MARK:
                        stop -= 1
                    stop = len(plain) if stop <= at else stop
                jobs.append((i, plain[at:stop], stop == len(plain)))
                held += stop - at
                at = stop
                if held >= CHARS:
                    yield from flush()
                    jobs, held = [], 0
                if at == len(plain):
                    break
        if jobs:
            yield from flush()

    # -- decoding ------------------------------------------------------------------------------

    def decode_bytes(self, lists: list[np.ndarray]) -> Iterator[bytes]:
        """The UTF-8 bytes that each list of ids decodes to, as the library's decode gives them."""
        lens = np.array([len(x) for x in lists], np.int64)
        ids = np.concatenate(lists).astype(np.int64) if lists else np.empty(0, np.int64)
        width = (self.spelt_at[1:] - self.spelt_at[:-1])[ids]
        stop = np.cumsum(width)
        raw = self.spelt[np.repeat(self.spelt_at[ids] - (stop - width), width) + np.arange(stop[-1] if len(stop) else 0)]
        tops, top = np.append(0, stop), 0
        for k, x in enumerate(lists):
            a, b = tops[top], tops[top + lens[k]]
            body = raw[a:b].tobytes()
            loud = np.flatnonzero(~self.silent[x[:64]]) if len(x) else []
            if not len(loud):
                loud = np.flatnonzero(~self.silent[x]) if len(x) else []
            if len(loud) and self.marked[x[loud[0]]]:
                body = body[1:]
            try:
                body.decode("utf-8")
            except UnicodeDecodeError:
                body = self._repaired(x)
            top += lens[k]
            yield body

    def _repaired(self, ids: np.ndarray) -> bytes:
        """Runs of byte pieces that aren't UTF-8 decode byte by byte to U+FFFD where they fail."""
        out, run, first = [], bytearray(), True
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                run += self.spelt[self.spelt_at[i] : self.spelt_at[i + 1]].tobytes()
                first = False
                continue
            while run:
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:k]).decode("utf-8").encode())
                        del run[:k]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�".encode())
                    del run[:1]
            if i is not None and not self.silent[i]:
                piece = self.spelt[self.spelt_at[i] : self.spelt_at[i + 1]].tobytes()
                out.append(piece[1:] if first and self.marked[i] else piece)
                first = False
        return b"".join(out)

    def decode(self, lists: list[np.ndarray]) -> list[str]:
        return [b.decode("utf-8") for b in self.decode_bytes(lists)]


_LOADED: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The tables of a model, loaded once a worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceCodec(path)
    return _LOADED[path]


def _batches(batch: pa.RecordBatch, text_col: str, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text: (id, token_ids array<int>), with begin and end ids. One pass, no shuffle.

    Null and empty texts give just the two ends; rows with null or repeated ids are kept as they are; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for part in _batches(batch, "text"):
                ids = [pa.array(x.astype(np.int32)) for x in c.encode(part.column(1).to_pylist(), ends=True)]
                offs = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.concat_arrays(ids) if ids else pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "token_ids"])

    source = docs.select(docs[id_col], docs[text_col])
    schema = T.StructType([source.schema[0], T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return in_batches(source, run, schema)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again: (id, n_tokens, ids_sha256, decoded_sha256).

    The hashes are of the ids as little-endian unsigned 32-bit integers and of the decoded text in UTF-8. Nulls count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for part in _batches(batch, "text"):
                keys, counts, sums, backs = part.column(0), [], [], []
                held: list[np.ndarray] = []
                size = 0

                def drain() -> None:
                    backs.extend(hashlib.sha256(b).hexdigest() for b in c.decode_bytes(held))
                    held.clear()

                for x in c.encode(part.column(1).to_pylist(), ends=True):
                    counts.append(len(x))
                    sums.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
                    held.append(x)
                    size += len(x)
                    if size >= CHARS:
                        drain()
                        size = 0
                drain()
                yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(backs, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(docs[id_col], docs[text_col])
    schema = T.StructType([source.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return in_batches(source, run, schema)
