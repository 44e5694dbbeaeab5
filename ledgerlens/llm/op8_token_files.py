"""Token-ID files: patched frame-of-reference blocks with an index, written and read in doc_id order.

Documents are dealt out by ranges of doc_id and encoded in order; each task writes a chain of files, each
of at most ``file_tokens`` ids or one document. A file is one binary value of a Parquet table
(part, file, doc range, payload), so that executors write it with Spark's own committer to any store;
``export_files`` copies the payloads to single files where a local folder is wanted.

File layout, little-endian:

    magic "PFOR" | version u16 | block size u16 | documents u64 | ids u64 | blocks u64
    doc ids i64[documents] | null flags u8[documents] | ids of each document u64[documents]
    block starts u64[blocks + 1]            byte offsets into the body, the index for random access
    body: per block: minimum u32 | width u8 | exceptions u16 | packed values | places u16[] | rests u32[]

Each block subtracts its minimum and packs the low ``width`` bits; ``width`` is what holds the
``percentile`` share of its values. Values above keep their high bits in the block's exception list.

Texts are encoded in slices of SLICE bytes, a longer text in parts that end at white space (or one word), so
what a worker holds is bounded by that, by ``file_tokens`` and by its longest document.

A null text is empty and has the end id alone. A null doc_id sorts before all others; rows that share a
doc_id stay next to each other, in the order of their texts. Only doc_id and text are read, so other columns
may have any name; an empty table has no files.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, partitions, turn, written
from .pieces import Pieces

BLOCK = 512
PERCENTILE = 0.9
FILE_TOKENS = 1 << 20
MEMO_WORDS, WIDE = 800_000, 24
SLICE = 1 << 19
SPACES = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
GAP = re.compile(rb"[ \t\n\r\x0b\x0c]")
HEAD = struct.Struct("<4sHHQQQ")


class Words:
    """Encodes UTF-8 texts chunk by chunk, as the tokenizer splits at ASCII white space anyway; chunks are remembered.

    Holds for tokenizers whose normaliser and pre-tokenizer drop white space and look at nothing across it.
    Chunks of up to WIDE bytes are rows of an open-addressing table in arrays, found and compared by their
    bytes for a whole slice of texts at once; longer ones are encoded where they occur.
    """

    SLOTS = 1 << 21

    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path, words=True)
        self.forget()

    def forget(self) -> None:
        self.slots = np.full(self.SLOTS, -1, np.int32)
        self.n = self.n_ids = 0
        # pages of these are taken as they are written
        self.keys = np.zeros((MEMO_WORDS, WIDE // 8), np.uint64)
        self.start, self.count = np.zeros(MEMO_WORDS, np.int32), np.zeros(MEMO_WORDS, np.int32)
        self.ids = np.zeros(6 * MEMO_WORDS, np.uint32)

    @staticmethod
    def mixed(keys: np.ndarray) -> np.ndarray:
        h = np.zeros(len(keys), np.uint64)
        for j in range(keys.shape[1]):
            h = (h ^ keys[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def lookup(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it has none."""
        out = np.full(len(keys), -1, np.int64)
        todo, slot = np.arange(len(keys)), (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(todo):
            row = self.slots[slot]
            here = row >= 0
            todo, slot, row = todo[here], slot[here], row[here]
            same = (self.keys[row] == keys[todo]).all(axis=1)
            out[todo[same]] = row[same]
            todo, slot = todo[~same], (slot[~same] + 1) & (self.SLOTS - 1)
        return out

    def insert(self, keys: np.ndarray, hashes: np.ndarray, ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Rows of new, distinct keys."""
        n, m = len(keys), len(ids)
        while self.n + n > len(self.keys):
            self.keys, self.start, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.keys, self.start, self.count))
        while self.n_ids + m > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        rows = np.arange(self.n, self.n + n)
        self.keys[rows], self.start[rows], self.count[rows] = keys, start + self.n_ids, count
        self.ids[self.n_ids : self.n_ids + m] = ids
        self.n, self.n_ids = self.n + n, self.n_ids + m
        todo, slot = rows, (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.slots[slot] < 0)
            self.slots[slot[free]] = todo[free]
            left = self.slots[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & (self.SLOTS - 1)
        return rows

    def encode(self, texts: Iterable[bytes], end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text, with the end id; holds a slice of texts, or of one text, at a time."""
        end = np.array([end_id], np.uint32)
        held: list[bytes] = []
        closes: list[bool] = []
        whole: list[np.ndarray] = []
        size = 0

        def close() -> Iterator[np.ndarray]:
            for ids, last in zip(self._encode(held), closes, strict=True):
                whole.append(ids)
                if last:
                    yield np.concatenate((*whole, end))
                    whole.clear()
            held.clear()
            closes.clear()

        for text in texts:
            at = 0
            while True:
                to = len(text)
                if to - at > SLICE:  # no word goes on across white space
                    gap = GAP.search(text, at + SLICE)
                    to = gap.start() if gap else to
                held.append(text[at:to])
                closes.append(to == len(text))
                size += to - at + 1
                at = to
                if size > SLICE:
                    yield from close()
                    size = 0
                if at == len(text):
                    break
        if held:
            yield from close()

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        data = b"".join([(t if b"<|" in t else t.lower()) + b" " for t in texts])  # ASCII letters alone change
        raw = np.frombuffer(data + b" " * WIDE, np.uint8)
        word = ~SPACES[raw]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate(([0], edge))
        begin, size = edge[::2], edge[1::2] - edge[::2]
        last = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts]))  # words up to the end of each text
        start, count = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        ids = self.ids[:0]
        short = np.flatnonzero(size <= WIDE)
        if len(short):
            bytes_ = raw[begin[short][:, None] + np.arange(WIDE)]
            bytes_[np.arange(WIDE) >= size[short][:, None]] = 255  # never part of UTF-8
            keys = bytes_.view(np.uint64)
            hashes = self.mixed(keys)
            order = np.argsort(hashes)
            keys, hashes = keys[order], hashes[order]
            new = np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))  # equal keys are neighbours, but for a tie of hashes
            first = np.flatnonzero(new)
            if self.n + len(first) > MEMO_WORDS:
                self.forget()
            row = self.lookup(keys[first], hashes[first])
            miss = np.flatnonzero(row < 0)
            if len(miss):
                lone = {data[b : b + s]: i for i, b, s in zip(miss.tolist(), begin[short[order[first[miss]]]].tolist(), size[short[order[first[miss]]]].tolist(), strict=True)}
                at = np.fromiter(lone.values(), np.int64, len(lone))
                self.insert(keys[first[at]], hashes[first[at]], *self.pieces.flat([w.decode() for w in lone]))
                row[miss] = self.lookup(keys[first[miss]], hashes[first[miss]])
            row = row[np.cumsum(new) - 1]
            start[short[order]], count[short[order]] = self.start[row], self.count[row]
            ids = self.ids[: self.n_ids]
        if len(short) < len(begin):
            long = np.flatnonzero(size > WIDE)
            more, s, count[long] = self.pieces.flat([data[b : b + n].decode() for b, n in zip(begin[long].tolist(), size[long].tolist(), strict=True)])
            start[long] = s + len(ids)
            ids = np.concatenate((ids, more))
        ends = np.cumsum(count)
        out = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)]
        cuts = np.concatenate(([0], ends))[last].tolist()
        return [out[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


@cache
def words_of(path: str) -> Words:
    return Words(path)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width -> rows of BLOCK * width / 8 bytes."""
    rows = len(values)
    lanes = values.reshape(rows, BLOCK // 64, 64).transpose(2, 0, 1).astype(np.uint64)
    out = np.zeros((width, rows, BLOCK // 64), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.transpose(1, 2, 0)).astype("<u8").view(np.uint8).reshape(rows, -1)


def unpack_bits(packed: np.ndarray, width: int) -> np.ndarray:
    rows = len(packed)
    if not width:
        return np.zeros((rows, BLOCK), np.uint32)
    words = np.ascontiguousarray(packed).view("<u8").reshape(rows, BLOCK // 64, width).transpose(2, 0, 1)
    out = np.empty((64, rows, BLOCK // 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        x = words[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[word + 1] << np.uint64(64 - shift))
        out[j] = x & mask
    return np.ascontiguousarray(out.transpose(1, 2, 0)).reshape(rows, BLOCK)


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """Block starts (one more than blocks) and the body."""
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.zeros(1, np.uint64), b""
    full = np.full(blocks * BLOCK, ids[-1], np.uint32)  # the last block is filled up
    full[: len(ids)] = ids
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    at = np.partition(rest, int(np.ceil(percentile * BLOCK)) - 1, axis=1)[:, int(np.ceil(percentile * BLOCK)) - 1]
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.int64)
    bodies: list[bytes] = [b""] * blocks
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        part = rest[own]
        packed = pack_bits(part & np.uint32((1 << w) - 1), w) if w else np.zeros((len(own), 0), np.uint8)
        row, place = np.nonzero(part >> np.uint32(w)) if w < 32 else (np.zeros(0, int),) * 2
        high = (part[row, place] >> np.uint32(w)).astype("<u4")
        place = place.astype("<u2")
        cut = np.searchsorted(row, np.arange(len(own) + 1))
        for k, i in enumerate(own.tolist()):
            s, e = cut[k], cut[k + 1]
            bodies[i] = struct.pack("<IBH", int(low[i]), w, e - s) + packed[k].tobytes() + place[s:e].tobytes() + high[s:e].tobytes()
    starts = np.zeros(blocks + 1, np.uint64)
    starts[1:] = np.cumsum([len(b) for b in bodies])
    return starts, b"".join(bodies)


def unpack_blocks(starts: np.ndarray, body: bytes | memoryview, first: int, last: int) -> np.ndarray:
    """The values of blocks first..last-1, found through the index."""
    n = last - first
    out = np.empty((n, BLOCK), np.uint32)
    at = (starts[first:last] - np.uint64(0)).astype(np.int64)
    heads = [struct.unpack_from("<IBH", body, o) for o in at.tolist()]
    low, width, many = (np.array(x, np.int64) for x in zip(*heads, strict=True)) if n else (np.zeros(0, np.int64),) * 3
    raw = np.frombuffer(body, np.uint8)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        size = BLOCK * w // 8
        packed = raw[(at[own] + 7)[:, None] + np.arange(size)] if size else np.zeros((len(own), 0), np.uint8)
        out[own] = unpack_bits(packed, w)
    for i in np.flatnonzero(many).tolist():
        w, m = int(width[i]), int(many[i])
        o = int(at[i]) + 7 + BLOCK * w // 8
        places = np.frombuffer(body, "<u2", m, o)
        out[i, places] |= np.frombuffer(body, "<u4", m, o + 2 * m) << np.uint32(w)
    out += low.astype(np.uint32)[:, None]
    return out.ravel()


def write_file(doc_ids: list[int | None], ids: list[np.ndarray], percentile: float = PERCENTILE) -> bytes:
    """One file image."""
    sizes = np.array([len(x) for x in ids], "<u8")
    starts, body = pack_blocks(np.concatenate(ids), percentile)
    head = HEAD.pack(b"PFOR", 1, BLOCK, len(ids), int(sizes.sum()), len(starts) - 1)
    return head + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids) + sizes.tobytes() + starts.astype("<u8").tobytes() + body


class TokenFile:
    """Reads a file image: all documents, or single ones through the block index."""

    def __init__(self, data: bytes) -> None:
        magic, version, block, docs, self.n_ids, blocks = HEAD.unpack_from(data)
        if magic != b"PFOR" or version != 1 or block != BLOCK:
            raise ValueError("not a token file of this version")
        o = HEAD.size
        null = data[o + 8 * docs : o + 9 * docs]
        self.doc_ids = [None if z else x for x, z in zip(np.frombuffer(data, "<i8", docs, o).tolist(), null, strict=True)]
        o += 9 * docs
        self.sizes = np.frombuffer(data, "<u8", docs, o).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        o += 8 * docs
        self.starts = np.frombuffer(data, "<u8", blocks + 1, o)
        self.body = memoryview(data)[o + 8 * (blocks + 1) :]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; only its blocks are unpacked."""
        s, e = int(self.ends[k] - self.sizes[k]), int(self.ends[k])
        first = s // BLOCK
        return unpack_blocks(self.starts, self.body, first, -(-e // BLOCK))[s - first * BLOCK : e - first * BLOCK]

    def all(self) -> np.ndarray:
        return unpack_blocks(self.starts, self.body, 0, len(self.starts) - 1)[: self.n_ids]


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 1, percentile: float = PERCENTILE, file_tokens: int = FILE_TOKENS, encoder: Callable = words_of, folder: str | None = None) -> DataFrame:
    """The table of files (part, file, ids before it in the part, n_ids, payload), written to ``folder``.

    Without a folder it is written below the shared one, for as long as the application runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn("token files", words_of.cache_clear)
        part, words = TaskContext.get().partitionId(), encoder(tokenizer_path)
        held_docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = number = before = 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([write_file(held_docs, held, percentile)], pa.binary())], ["part", "file", "before", "n_ids", "payload"])

        for batch in batches:
            texts = (x.as_py() for x in batch["text"].cast(pa.binary()))
            for doc, ids in zip(batch["doc_id"].to_pylist(), words.encode(texts, end_id), strict=True):
                if held and size + len(ids) > file_tokens:
                    yield out()
                    held_docs, held, size, number, before = [], [], 0, number + 1, before + size
                held_docs.append(doc)
                held.append(ids)
                size += len(ids)
        if held:
            yield out()

    ranged = id_text(docs).repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    files = ranged.mapInArrow(run, "part long, file long, before long, n_ids long, payload binary")
    if folder is None:
        return written(files, "token-files")
    files.write.parquet(folder)
    return docs.sparkSession.read.schema(files.schema).parquet(folder)


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32.

    The ids before each part are summed on the driver: one number for each task that wrote, not for each document.
    """
    totals = dict(files.groupBy("part").agg(F.sum("n_ids")).collect())
    before, at = {}, 0
    for part in sorted(totals):
        before[part], at = at, at + totals[part]
    base = files.sparkSession.createDataFrame(list(before.items()), "part long, base long")
    rows = files.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("base"), "payload")  # as many rows as tasks that wrote

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch["base"].to_pylist(), batch["payload"], strict=True):
                f = TokenFile(data.as_py())
                raw = memoryview(f.all().astype("<u4").tobytes())
                ends = f.ends.tolist()
                starts = [0, *ends[:-1]]
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends, strict=True)]
                yield pa.record_batch([pa.array(f.doc_ids, pa.int64()), pa.array([base + s for s in starts], pa.int64()), pa.array(f.sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export_files(files: DataFrame, folder: str) -> int:
    """Copy the payloads to ``folder``/part-file.pfor, one at a time; the number of files."""
    from pathlib import Path

    n = 0
    for row in files.orderBy("part", "file").toLocalIterator():
        Path(folder, f"{row.part:08d}-{row.file:06d}.pfor").write_bytes(row.payload)
        n += 1
    return n
