"""Token ids as fixed-width bit-packed files: encode, pack, write in document order, read at random.

A file holds the ids of consecutive documents. Layout, little-endian::

    magic "MRTOK001"
    blocks   each BLOCK ids (the last one fewer), `bits` bits an id, the lowest bit first, padded to a byte
    footer   block offsets (n_blocks + 1, u64: byte positions from the start of the file)
             document ids (n_docs, i64), null flags (n_docs, u8), document starts (n_docs + 1, u64: ids before it in the file)
    tail     bits u32, block u32, n_docs u64, n_ids u64, footer position u64, magic

`bits` is the least width that holds every id of the vocabulary. A block offset and a multiplication find any id; a
range of ids is unpacked from its own blocks only, in numpy.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, LOWER, cut_text, hash_spans, in_batches, scratch_path, word_spans

MAGIC = b"MRTOK001"
BLOCK = 8192
_TAIL = struct.Struct("<IIQQQ8s")


# -- packing -----------------------------------------------------------------------------------


def bits_for(vocabulary: int) -> int:
    """Bits an id of a vocabulary of this size needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, `bits` bits each, the lowest bit first."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """`count` ids from the start-th on: each is cut from the eight bytes in which it begins."""
    padded = np.frombuffer(raw + b"\0" * 8, np.uint8)
    at = (np.arange(start, start + count, dtype=np.int64)) * bits
    word = np.zeros(count, np.uint64)
    for k in range((bits + 7 + 7) // 8):
        word |= padded[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


# -- files -------------------------------------------------------------------------------------


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system for a folder that all machines share (file, hdfs, s3, gs, abfs)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class TokenWriter:
    """Writes one file block by block under a name of its own, and moves it into place when closed: a retried task never leaves half a file."""

    def __init__(self, uri: str, bits: int):
        self.fs, self.path = _open(uri)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.draft"
        self.fs.create_dir(str(PurePosixPath(self.path).parent), recursive=True)
        self.out = self.fs.open_output_stream(self.draft)
        self.out.write(MAGIC)
        self.bits, self.at, self.n = bits, len(MAGIC), 0
        self.offsets, self.docs, self.starts = [self.at], [], [0]
        self.rest: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.n += len(ids)
        self.starts.append(self.n)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._drain(self.held - self.held % BLOCK)

    def _drain(self, count: int) -> None:
        ids = np.concatenate(self.rest)
        for a in range(0, count, BLOCK):
            raw = pack(ids[a : min(a + BLOCK, count)], self.bits)
            self.out.write(raw)
            self.at += len(raw)
            self.offsets.append(self.at)
        self.rest, self.held = [ids[count:]], len(ids) - count

    def close(self) -> None:
        if self.held:
            self._drain(self.held)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([0 if d is None else d for d in self.docs], "<i8").tobytes())
        self.out.write(np.array([d is None for d in self.docs], np.uint8).tobytes())
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(_TAIL.pack(self.bits, BLOCK, len(self.docs), self.n, self.at, MAGIC))
        self.out.close()
        self.fs.move(self.draft, self.path)


class TokenReader:
    """Random access to one file."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.bits, self.block, docs, self.n, at, magic = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        foot = io.BytesIO(self.file.read_at(size - _TAIL.size - at, at))
        self.offsets = np.frombuffer(foot.read(8 * (-(-self.n // self.block) + 1)), "<u8").astype(np.int64)
        ids = np.frombuffer(foot.read(8 * docs), "<i8")
        nulls = np.frombuffer(foot.read(docs), np.uint8)
        self.docs = [None if x else int(i) for i, x in zip(ids, nulls)]
        self.starts = np.frombuffer(foot.read(8 * (docs + 1)), "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start up to stop, from their own blocks only."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        a, b = int(self.offsets[first]), int(self.offsets[last + 1])
        raw = self.file.read_at(b - a, a)
        parts = []
        for k in range(first, last + 1):
            lo, hi = max(start, k * self.block), min(stop, (k + 1) * self.block)
            body = raw[self.offsets[k] - a : self.offsets[k + 1] - a]
            parts.append(unpack(body, self.bits, lo - k * self.block, hi - lo))
        return np.concatenate(parts)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


# -- encoding ----------------------------------------------------------------------------------


def _byte_symbols() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(rest)}


class _Growing:
    """An array that grows at its end."""

    def __init__(self, kind: type, room: int = 1 << 16):
        self.data, self.n = np.empty(room, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(self.n + len(values), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class _Known:
    """Slots of 64-bit keys: a large sorted run, and a small one that is merged in now and then."""

    def __init__(self) -> None:
        self.runs = [(np.empty(0, np.uint64), np.empty(0, np.int64))] * 2

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        for have, slots in self.runs:
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                out = np.where(have[at] == keys, slots[at], out)
        return out

    def add(self, keys: np.ndarray, slots: np.ndarray) -> None:
        large, small = self.runs
        small = tuple(np.concatenate(x) for x in zip(small, (keys, slots)))
        if len(small[0]) > 1 << 16:
            large, small = tuple(np.concatenate(x) for x in zip(large, small)), (np.empty(0, np.uint64), np.empty(0, np.int64))
            large = self._sorted(large)
        self.runs = [large, self._sorted(small)]

    @staticmethod
    def _sorted(run: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        order = np.argsort(run[0])
        return run[0][order], run[1][order]


#: Another order of the byte values, for a second hash of the same words.
SHUFFLED = np.random.default_rng(64).permutation(256).astype(np.uint8)


class WordEncoder:
    """Exact ids of the word tokenizer, each distinct word encoded once by the library.

    The tokenizer drops white space and splits before it merges, so that a text's ids are those of its words in a row; words
    are cut at ASCII white space only, found and told apart in numpy (by two 64-bit hashes). Words of Latin letters, with or without a tail
    of ASCII punctuation, are at once the pre-tokens of the library's own rules: its merge model gets them directly,
    lower-cased. All other words pass through its whole chain (normaliser, pre-tokenizer, special tokens).
    """

    #: Words, and bytes of words, remembered at most; then the memory starts anew.
    MOST, MOST_BYTES = 1 << 20, 1 << 25
    #: Letters that lower-case one to one and are in composed form, then punctuation without letters or digits.
    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.symbols = _byte_symbols()
        self._clear()
        self.fits = self._fits()

    def _fits(self) -> bool:
        """Whether the tokenizer has the rules that words in a row are encoded by; another one encodes whole texts by the library."""
        latin = "".join(chr(c) for c in [*range(33, 127), *range(161, 256)])
        probes = ["Hello, World. it's  9 DON'T\n\tx", " ".join(f"Ab{c} {c}Zé{c}{c} a{c}b" for c in latin), "ÀÉ naïve. Straße, x1 1x <0x41> ▁ 漢字 🙂", "\x0ba\x0cb\r\n", "the quick brown fox jumps, internationalization.", ""]
        try:
            with np.errstate(over="ignore"):
                return all(list(self._encode([p.encode()], [not OTHER.search(p)])[0]) == self.whole(p) for p in probes if p) and not self.whole(" \n")
        except (KeyError, IndexError, AttributeError):
            return False
        finally:
            self._clear()

    def _clear(self) -> None:
        self.checks = _Growing(np.uint64)
        self.known, self.held, self.words = _Known(), 0, 0
        self.flat, self.at = _Growing(np.uint32), _Growing(np.int64)
        self.at.extend(np.zeros(1, np.int64))

    def _part(self, part: str) -> list[int]:
        text = part if part.isascii() else part.encode().decode("latin-1").translate(self.symbols)
        return [t.id for t in self.model.tokenize(text)]

    def _learn(self, new: list[bytes]) -> np.ndarray:
        """Remember words; returns their slots."""
        fresh: list[int] = []
        lens = np.empty(len(new), np.int64)
        texts = [w.decode("utf-8", "surrogatepass") for w in new]
        plain = [self.PLAIN.fullmatch(t) for t in texts]
        odd = [t for t, m in zip(texts, plain) if m is None]
        whole = iter([e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)] if odd else [])
        tails: dict[str, list[int]] = {"": []}
        for i, m in enumerate(plain):
            if m is None:
                ids = next(whole)
            else:
                letters, tail = m.groups()
                if tail not in tails:
                    tails[tail] = self._part(tail)
                ids = self._part(letters.lower()) + tails[tail]
            fresh += ids
            lens[i] = len(ids)
        slots = np.arange(self.words, self.words + len(new))
        self.words += len(new)
        self.held += sum(map(len, new))
        self.at.extend(self.flat.n + np.cumsum(lens))
        self.flat.extend(np.array(fresh, np.uint32))
        return slots

    def _encode(self, raws: list[bytes], easy: list[bool]) -> list[np.ndarray]:
        """Ids of texts whose words fit a buffer."""
        if self.words > self.MOST or self.held > self.MOST_BYTES:
            self._clear()
        sizes = np.array([len(r) + 1 for r in raws])
        offsets = np.append(0, np.cumsum(sizes))
        buf = np.frombuffer(b" ".join(raws), np.uint8)
        lower = LOWER[buf]
        if not all(easy):
            lower = np.where(np.repeat(easy, sizes)[: len(buf)], lower, buf)
        starts, ends = word_spans(lower)
        # a stop or comma at the end of a word of letters is a pre-token of its own: cut it off, so that fewer words are distinct
        last, before = lower[ends - 1], lower[np.maximum(ends - 2, 0)]
        tail = np.flatnonzero(((last == 44) | (last == 46)) & (ends - starts > 1) & (before >= 97) & (before <= 122))
        if len(tail):
            cut = ends[tail] - 1
            starts, ends = np.insert(starts, tail + 1, cut), np.insert(ends, tail, cut)
        hashes, checks = hash_spans(lower, starts, ends), hash_spans(SHUFFLED[lower], starts, ends)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        slots = self.known.find(distinct)
        new = np.flatnonzero(slots < 0)
        old = np.flatnonzero(slots >= 0)
        if (checks != checks[first][back]).any() or (self.checks.data[slots[old]] != checks[first[old]]).any():
            # words of one hash that differ: the library encodes these texts
            return [np.array(self.whole(raw.decode("utf-8", "surrogatepass")), np.uint32) for raw in raws]
        if len(new):
            whole = lower.tobytes()
            slots[new] = self._learn([whole[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            self.known.add(distinct[new], slots[new])
            self.checks.extend(checks[first[new]])
        k = slots[back]
        lens = self.at.data[k + 1] - self.at.data[k]
        stop = np.append(0, np.cumsum(lens))
        ids = self.flat.data[np.repeat(self.at.data[k] - stop[:-1], lens) + np.arange(stop[-1])]
        cuts = stop[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def encode(self, texts: list[str | None], end: int) -> Iterator[np.ndarray]:
        """The ids of each text in order, with `end` at the end. Null counts as empty; a long text goes through in pieces."""
        close = np.array([end], np.uint32)
        parts: list[tuple[bytes, bool, bool]] = []  # a piece, whether it may be lower-cased, the last of its text
        held, rest = 0, []

        def flush() -> Iterator[np.ndarray]:
            for ids, (_, _, last) in zip(self._encode([p for p, _, _ in parts], [e for _, e, _ in parts]), parts):
                rest.append(ids)
                if last:
                    yield np.concatenate([*rest, close])
                    rest.clear()

        if not self.fits:
            yield from (np.append(np.array(self.whole(text), np.uint32), close) for text in texts)
            return
        for text in texts:
            text = text or ""
            raw = text.encode("utf-8", "surrogatepass")
            # A-Z may be lower-cased before anything else where no character combines (all are Latin-1) and no special token is near
            easy = "<|" not in text and not OTHER.search(text)
            pieces = list(cut_text(raw))
            for i, piece in enumerate(pieces):
                parts.append((piece, easy, i == len(pieces) - 1))
                held += len(piece) + 1
                if held >= CHUNK:
                    yield from flush()
                    parts, held = [], 0
        if parts:
            yield from flush()

    def whole(self, text: str | None) -> list[int]:
        """The library's ids of a whole text, to test against."""
        return self.tokenizer.encode(text or "", add_special_tokens=False).ids


#: Ids that are read at once, but for a longer document.
RUN = 1 << 18
OTHER = re.compile("[^\x00-\xff]")
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end: int = 1, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, append `end` to each document, and write packed files in ascending id order into a shared folder.

    Documents are dealt by ranges of id (one shuffle; equal ids by text), each range becomes one file. Returns, and runs, one row a
    file: (file, n_docs, n_ids, start), `start` being the ids of all files before it. Null ids come first, null texts count as empty.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.crc32(F.coalesce(docs[text_col], F.lit(""))).alias("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}.tok"
        writer = None
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256)
                for doc, ids in zip(rows.column(0).to_pylist(), e.encode(rows.column(1).to_pylist(), end)):
                    writer = writer or TokenWriter(f"{folder}/{name}", bits_for(max(e.size, end + 1)))
                    writer.add(doc, ids)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.n], pa.int64())], names=["part", "file", "n_docs", "n_ids"])

    ranged = source.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    made = in_batches(ranged.select("doc_id", "text"), run, "part int, file string, n_docs long, n_ids long").collect()  # one row a file
    rows, start = [], 0
    for r in sorted(made, key=lambda r: r.part):
        rows.append((r.file, r.n_docs, r.n_ids, start))
        start += r.n_ids
    return spark.createDataFrame(rows, "file string, n_docs long, n_ids long, start long")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """Per document of the files that write_tokens() lists: (doc_id, start, n_tokens, ids_crc32), each unpacked from its file."""
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = TokenReader(f"{folder}/{name}")
                a = 0
                while a < len(reader.docs):
                    # a run of documents, whose blocks are read and unpacked once
                    b = max(a + 1, min(a + 4096, int(np.searchsorted(reader.starts, reader.starts[a] + RUN, side="right")) - 1))
                    at = reader.starts[a : b + 1]
                    raw, cuts = memoryview(reader.ids(int(at[0]), int(at[-1])).astype("<u4").tobytes()), (4 * (at - at[0])).tolist()
                    sums = [zlib.crc32(raw[x:y]) for x, y in zip(cuts, cuts[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(reader.docs[a:b], pa.int64()), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    a = b

    return files.select("file", "start").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, vocabulary: str, end: int = 1) -> DataFrame:
    """Write all documents to packed files in the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, vocabulary, folder, end), folder)
