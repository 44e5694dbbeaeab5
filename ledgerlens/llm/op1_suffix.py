"""Exact substring dedup over a distributed, sparse, front-coded suffix order.

Every 50-byte window has one anchor: the leftmost minimum of a hash over the 24-grams inside it.
Equal windows have equal anchors at equal places, so only the suffixes at anchors are sorted:

A  per document group: distinct anchor hashes, dealt out to hash buckets (6 bytes each)
B  per bucket: which hashes occur in two documents or more -> a bit mask back to each group
C  per group: suffixes at the surviving anchors as a sorted, front-coded run per bucket
D  per bucket: a loser tree merges the runs; the cached common prefixes (from front coding and from
   lost matches) decide most matches, and bytes below a known prefix are never compared again. The same
   prefixes cut the merged order into the stretches that share a window, and these give for each window the
   smallest document that has it -> a verdict per group
E  per group: bytes covered by windows of smaller documents are removed

The text is shuffled once (by group; the exchange is reused by A, C and E, which find the anchors anew rather
than move them), runs hold a repeated suffix once per group however often it occurs, and nothing is collected
to the driver. Groups and buckets grow in number with the bytes of the table, and go to four times as many
partitions, so that few partitions get several of them. A document, and the distinct contexts of one 24-gram,
are held by one task.

Nulls and empty texts have nothing to remove. A null doc_id counts as smaller than all others (and as the
smallest long). Rows that share a doc_id are one document for the comparison and give one result row each.
Only doc_id and text are read, and other columns may have any name.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, n_groups, text_bytes

LENGTH, GRAM = 50, 24
WINDOW = LENGTH - GRAM + 1
CHUNK = 1 << 19
FLUSH = 1 << 16  # suffixes judged at once, up to the end of a 24-gram
STOP = b"\xff"  # never part of UTF-8
C1, C2, C3, C4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
NONE = np.uint64(0xFFFFFFFF)
KEY_MASK = np.uint64((1 << 48) - 1)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes that start at each position."""
    x = b[:-1].astype(np.uint16) | (b[1:].astype(np.uint16) << np.uint16(8))
    x = x[:-2].astype(np.uint32) | (x[2:].astype(np.uint32) << np.uint32(16))
    x = x[:-4].astype(np.uint64) | (x[4:].astype(np.uint64) << np.uint64(32))
    n = len(b) - GRAM + 1
    h = x[:n] * C1
    h ^= h >> np.uint64(31)
    h += x[8 : 8 + n]
    h *= C2
    h ^= h >> np.uint64(29)
    h += x[16 : 16 + n]
    h *= C3
    h ^= h >> np.uint64(32)
    h *= C4
    h ^= h >> np.uint64(30)
    return h


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: hash, anchor, first and last window start."""
    out: list[tuple[np.ndarray, ...]] = []
    n = len(buf) - LENGTH + 1
    for s in range(0, max(n, 0), CHUNK):
        e = min(s + CHUNK, n)
        h = gram_hashes(buf[s : e + LENGTH - 1])
        m = (h & HIGH) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= WINDOW:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < WINDOW:
            m = np.minimum(m[: -(WINDOW - width)], m[WINDOW - width :])
        at = (m & LOW)[: e - s]
        i, j = np.searchsorted(ends, s, "right"), np.searchsorted(ends, e + LENGTH, "left") + 1
        for x in ends[i:j]:  # windows that cross the end of a document
            at[max(0, x - LENGTH + 1 - s) : max(0, x - s)] = NONE
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:], [len(at)])) - 1
        keep = at[first] != NONE
        first, last = first[keep], last[keep]
        a = at[first].astype(np.int64)
        out.append((h[a], a + s, first + s, last + s))
    if not out:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


class Group:
    """The documents of a group in one buffer, with their anchors."""

    def __init__(self, table: pa.Table) -> None:
        rows = sorted(zip(table["doc_id"].to_pylist(), text_bytes(table["text"]), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        self.ids = [r[0] for r in rows]
        self.texts = [r[1] for r in rows]
        self.data = b"".join(self.texts)
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64) if rows else np.zeros(0, np.int64)
        self.order = np.array([-(1 << 63) if x is None else x for x in self.ids], np.int64)
        self.h, self.a, self.p1, self.p2 = anchors(np.frombuffer(self.data, np.uint8), self.ends)
        self.doc = np.searchsorted(self.ends, self.p1, "right")

    def keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (bucket, hash), whether two documents here have it, and each anchor's place among them."""
        bucket = (self.h & LOW) % np.uint64(buckets)
        order = np.lexsort((self.h & KEY_MASK, bucket))
        b, k, o = bucket[order], (self.h & KEY_MASK)[order], self.order[self.doc][order]
        new = np.concatenate(([True], (b[1:] != b[:-1]) | (k[1:] != k[:-1]))) if len(b) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        many = np.minimum.reduceat(o, at) != np.maximum.reduceat(o, at) if len(at) else np.zeros(0, bool)
        place = np.empty(len(b), np.int64)
        place[order] = np.cumsum(new) - 1
        return b[at].astype(np.int64), k[at], many, place

    def suffixes(self, buckets: int, masks: dict[int, bytes]) -> tuple[np.ndarray, list[tuple[int, bytes]], np.ndarray, np.ndarray]:
        """The surviving anchors, their distinct (bucket, suffix) in order, each anchor's suffix, the least document of a suffix."""
        b, _, _, place = self.keys(buckets)
        wanted = np.zeros(len(b), bool)
        lo, hi = bounds(b)
        for s, e in zip(lo, hi, strict=True):
            if m := masks.get(int(b[s])):
                wanted[s:e] = np.unpackbits(np.frombuffer(m, np.uint8), count=e - s).astype(bool)
        at = np.flatnonzero(wanted[place]) if len(b) else np.zeros(0, np.int64)
        data, seen, number = self.data, {}, []
        for bucket, a, p1, p2 in zip(b[place[at]].tolist(), self.a[at].tolist(), self.p1[at].tolist(), self.p2[at].tolist(), strict=True):
            number.append(seen.setdefault((bucket, data[a : p2 + LENGTH] + STOP + data[p1:a][::-1]), len(seen)))
        ordered = sorted(seen)
        rank = np.empty(len(seen), np.int64)
        for i, x in enumerate(ordered):
            rank[seen[x]] = i
        number = rank[np.array(number, np.int64)] if number else np.zeros(0, np.int64)
        least = np.full(len(seen), (1 << 63) - 1, np.int64)
        np.minimum.at(least, number, self.order[self.doc[at]])
        return at, ordered, number, least


def bounds(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return first, np.concatenate((first[1:], [len(sorted_values)]))


def pack_run(keys: list[bytes], least: np.ndarray) -> bytes:
    """Front coding: shared prefix with the key before, rest length, rests."""
    n, wide = len(keys), max(map(len, keys)) + 1
    m = np.frombuffer(b"".join(k.ljust(wide, b"\0") for k in keys), np.uint8).reshape(n, wide)
    size = np.fromiter(map(len, keys), np.int64, n)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.minimum((m[1:] != m[:-1]).argmax(axis=1), np.minimum(size[1:], size[:-1]))
    rest = b"".join(k[i:] for k, i in zip(keys, lcp.tolist(), strict=True))
    raw = struct.pack("<I", n) + lcp.astype(np.uint8).tobytes() + (size - lcp).astype(np.uint8).tobytes() + least.astype("<i8").tobytes() + rest
    return zstandard.ZstdCompressor(level=1).compress(raw)


def read_run(blob: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(prefix shared with the key before, key, least document) in order."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<I", raw)[0]
    lcp, more = raw[4 : 4 + n], raw[4 + n : 4 + 2 * n]
    least = np.frombuffer(raw, "<i8", n, 4 + 2 * n).tolist()
    at, key = 4 + 10 * n, b""
    for p, m, d in zip(lcp, more, least, strict=True):
        key = key[:p] + raw[at : at + m]
        at += m
        yield p, key, d


def merge(runs: list[Iterator[tuple[int, bytes, int]]]) -> Iterator[tuple[int, bytes, int, int]]:
    """Loser tree over sorted runs: (prefix shared with the output before, key, least document, run).

    ``lcp[r]`` is the prefix that run r's head shares with the last output. The longer one wins without
    a look at the bytes; on a tie bytes are compared from there on, and the loser keeps what was found.
    """
    k = len(runs)
    key: list[bytes] = [b""] * k
    lcp, doc = [-1] * k, [0] * k
    for r, it in enumerate(runs):
        if (x := next(it, None)) is not None:
            lcp[r], key[r], doc[r] = 0, x[1], x[2]

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        la, lb = lcp[a], lcp[b]
        if la > lb:
            return a, b
        if lb > la:
            return b, a
        if la < 0:
            return a, b
        x, y = key[a], key[b]
        if x == y:
            lcp[b] = len(x)
            return a, b
        n, i = min(len(x), len(y)), la
        while i < n and x[i] == y[i]:
            i += 1
        if i < n and x[i] > y[i] or i == n and len(x) > n:
            lcp[a] = i
            return b, a
        lcp[b] = i
        return a, b

    losers = [0] * max(k, 1)
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    win = winners[1] if k > 1 else 0
    while k and lcp[win] >= 0:
        yield lcp[win], key[win], doc[win], win
        x = next(runs[win], None)
        if x is None:
            lcp[win] = -1
        else:
            lcp[win], key[win], doc[win] = x
        node = (k + win) >> 1
        while node:
            o = losers[node]
            lo, lw = lcp[o], lcp[win]
            if lo > lw:
                losers[node], win = win, o
            elif lo == lw and lw >= 0:
                win, losers[node] = play(win, o)
            node >>= 1


def window_minima(keys: list[bytes], shared: list[int], docs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes in merged order: how many pieces each has, their lengths in windows, the least document of each.

    ``shared``: the prefix that a suffix shares with the one before, as the merge found it. A window that
    starts ``o`` bytes before the anchor is equal for two suffixes if they share LENGTH - o bytes after the
    anchor and o bytes before it. The first are neighbours in the merged order with no smaller ``shared``
    between them; the others are so in the order of what comes before the anchor. Each window start thus
    cuts both orders into stretches, and a pair of stretches is one window.
    """
    n, many = len(keys), LENGTH - GRAM + 1
    data = np.frombuffer(b"".join(keys), np.uint8)
    size = np.fromiter(map(len, keys), np.int64, n)
    end = np.cumsum(size)
    right = np.flatnonzero(data == STOP[0]) - (end - size)
    left = size - right - 1
    before = np.full((n, 32), STOP[0], np.uint8)
    row = np.repeat(np.arange(n), left)
    at = np.arange(len(row)) - np.repeat(np.cumsum(left) - left, left)
    before[row, at] = data[np.repeat(end - left, left) + at]
    lcp, least = np.array(shared, np.int64), np.array(docs, np.int64)
    new_block = lcp < GRAM
    new_block[0] = True
    block = np.cumsum(new_block)
    order = np.lexsort((*before.view(">u8").astype(np.uint64).T[::-1], block))
    ranked = before[order]
    differs = ranked[1:] != ranked[:-1]
    same = np.zeros(n, np.int64)
    same[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), many)
    same[1:][block[order][1:] != block[order][:-1]] = -1
    same[0] = -1
    found = np.empty((many, n), np.int64)  # by offset, largest first: the order of window starts
    valid = np.empty((many, n), bool)
    for j in range(many):
        o = many - 1 - j
        valid[j] = (left >= o) & (right >= LENGTH - o)
        by_left = np.empty(n, np.int64)
        by_left[order] = np.cumsum(same < o)
        use = np.flatnonzero(valid[j])
        pair = np.cumsum(new_block | (lcp < LENGTH - o))[use] * (n + 1) + by_left[use]
        place = np.argsort(pair, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(pair[place]) != 0))) if len(use) else place
        if len(use):
            found[j, use[place]] = np.repeat(np.minimum.reduceat(least[use[place]], first), np.diff(np.concatenate((first, [len(use)]))))
    key, j = np.nonzero(valid.T)
    doc = found[j, key]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new)
    return np.bincount(key[first], minlength=n), np.diff(np.concatenate((first, [len(key)]))), doc[first]


def judge(runs: list[bytes]) -> list[bytes]:
    """Merge the runs of a bucket; per run, for each of its suffixes (count, least document) pairs over its windows."""
    counts: list[list[np.ndarray]] = [[] for _ in runs]
    pieces: list[list[np.ndarray]] = [[] for _ in runs]
    docs: list[list[np.ndarray]] = [[] for _ in runs]
    keys: list[bytes] = []
    shared: list[int] = []
    least: list[int] = []
    owner: list[int] = []
    number: list[int] = []

    def flush() -> None:
        if not keys:
            return
        n, size, doc = window_minima(keys, shared, least)
        start = np.cumsum(n) - n
        run = np.array(owner)
        order = np.argsort(run, kind="stable")
        own = np.array(number)[order]
        for part, r in zip(np.split(own, np.flatnonzero(np.diff(run[order])) + 1), np.unique(run).tolist(), strict=True):
            m = n[part]
            at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[part], m)
            counts[r].append(m)
            pieces[r].append(size[at])
            docs[r].append(doc[at])
        for held in (keys, shared, least, owner, number):
            held.clear()

    for lcp, key, d, run in merge([read_run(x) for x in runs]):
        if keys and lcp == len(key) == len(keys[-1]):
            least[-1] = min(least[-1], d)
        else:
            if lcp < GRAM and len(keys) >= FLUSH:
                flush()
            keys.append(key)
            shared.append(lcp)
            least.append(d)
        owner.append(run)
        number.append(len(keys) - 1)
    flush()
    pack = zstandard.ZstdCompressor(level=1).compress
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return [pack(struct.pack("<II", len(c), len(p)) + c.astype(np.uint8).tobytes() + p.astype(np.uint8).tobytes() + d.astype("<i8").tobytes()) for c, p, d in zip(map(joined, counts), map(joined, pieces), map(joined, docs), strict=True)]


def read_verdict(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = struct.unpack_from("<II", raw)
    return np.frombuffer(raw, np.uint8, n, 8).astype(np.int64), np.frombuffer(raw, np.uint8, m, 8 + n).astype(np.int64), np.frombuffer(raw, "<i8", m, 8 + n + m)


A_SCHEMA = "bucket long, g long, keys binary, many binary"
B_SCHEMA = "g long, bucket long, mask binary"
C_SCHEMA = "bucket long, g long, mask binary, run binary"
D_SCHEMA = "g long, bucket long, mask binary, verdict binary"
E_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed binary"


def _table(schema: pa.Schema, columns: list[list]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed.

    ``removed``: the removed runs as little-endian (start, end) pairs of unsigned 64-bit byte offsets.
    """
    groups = buckets = n_groups(docs)
    parts = 4 * groups
    spread = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    texts = id_text(docs).withColumn("g", F.pmod(spread, F.lit(groups))).repartition(parts, "g")
    schemas = [_arrow(x) for x in (A_SCHEMA, B_SCHEMA, C_SCHEMA, D_SCHEMA, E_SCHEMA)]

    def distinct(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        g = key[0].as_py()
        b, k, many, _ = Group(table).keys(buckets)
        rows: list[list] = [[], [], [], []]
        for s, e in zip(*bounds(b), strict=True):
            for col, x in zip(rows, (int(b[s]), g, np.ascontiguousarray(k[s:e].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes(), np.packbits(many[s:e]).tobytes()), strict=True):
                col.append(x)
        return _table(schemas[0], rows)

    def screen(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blobs, sizes = table["keys"].to_pylist(), []
        for x in blobs:
            sizes.append(len(x) // 6)
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
        keys = wide.view("<u8").ravel()
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(table["many"].to_pylist(), sizes, strict=True)]).astype(bool)
        order = np.argsort(keys)
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        found = many[order]
        found[1:] |= same
        found[:-1] |= same
        wanted = np.empty(len(keys), bool)
        wanted[order] = found
        # a hash that two documents of one group have is wanted by every group that has it: it is found by 'same' there
        rows: list[list] = [[], [], []]
        at = 0
        for g, n in zip(table["g"].to_pylist(), sizes, strict=True):
            if (m := wanted[at : at + n]).any():
                for col, x in zip(rows, (g, key[0].as_py(), np.packbits(m).tobytes()), strict=True):
                    col.append(x)
            at += n
        return _table(schemas[1], rows)

    def runs(key: tuple[pa.Scalar, ...], table: pa.Table, masks: pa.Table) -> pa.Table:
        rows: list[list] = [[], [], [], []]
        if table.num_rows and masks.num_rows:
            mask = dict(zip(masks["bucket"].to_pylist(), masks["mask"].to_pylist(), strict=True))
            _, ordered, _, least = Group(table).suffixes(buckets, mask)
            for s, e in zip(*bounds(np.array([x[0] for x in ordered], np.int64)), strict=True):
                for col, x in zip(rows, (ordered[s][0], key[0].as_py(), mask[ordered[s][0]], pack_run([x[1] for x in ordered[s:e]], least[s:e])), strict=True):
                    col.append(x)
        return _table(schemas[2], rows)

    def verdicts(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _table(schemas[3], [table["g"].to_pylist(), table["bucket"].to_pylist(), table["mask"].to_pylist(), judge(table["run"].to_pylist())])

    def remove(key: tuple[pa.Scalar, ...], table: pa.Table, more: pa.Table) -> pa.Table:
        group = Group(table)
        diff = np.zeros(len(group.data) + 1, np.int32)
        if more.num_rows:
            found = dict(zip(more["bucket"].to_pylist(), zip(more["mask"].to_pylist(), more["verdict"].to_pylist(), strict=True), strict=True))
            at, ordered, number, _ = group.suffixes(buckets, {b: m for b, (m, _) in found.items()})
            counts, pieces, least = (np.concatenate(x) for x in zip(*(read_verdict(found[ordered[s][0]][1]) for s, _ in zip(*bounds(np.array([x[0] for x in ordered], np.int64)), strict=True)), strict=True)) if ordered else (np.zeros(0, np.int64),) * 3
            offset = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
            many = counts[number]
            owner = np.repeat(np.arange(len(at)), many)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            piece = offset[number][owner] + within
            size = pieces[piece] if len(piece) else piece
            total = np.cumsum(size) - size
            lead = total - np.repeat(total[np.cumsum(many) - many], many) if len(piece) else total
            start = group.p1[at][owner] + lead
            gone = least[piece] < group.order[group.doc[at]][owner] if len(piece) else np.zeros(0, bool)
            np.add.at(diff, start[gone], 1)
            np.add.at(diff, (start + size)[gone] + LENGTH - 1, -1)
        mask = np.cumsum(diff[:-1]) > 0
        rows: list[list] = [[], [], [], [], [], []]
        s = 0
        for doc, text, e in zip(group.ids, group.texts, group.ends.tolist(), strict=True):
            m = mask[s:e]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], m.view(np.int8), [0]))))
            if len(edge):
                cut = edge.tolist()
                kept = b"".join(text[a:b] for a, b in zip([0, *cut[1::2]], [*cut[::2], len(text)], strict=True))
            else:
                kept = text
            for col, x in zip(rows, (doc, len(text), int(m.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge.astype("<u8").tobytes()), strict=True):
                col.append(x)
            s = e
        return _table(schemas[4], rows)

    by_group = texts.groupBy("g")
    seen = by_group.applyInArrow(distinct, A_SCHEMA).repartition(parts, "bucket")
    masks = seen.groupBy("bucket").applyInArrow(screen, B_SCHEMA).repartition(parts, "g")
    sorted_ = by_group.cogroup(masks.groupBy("g")).applyInArrow(runs, C_SCHEMA).repartition(parts, "bucket")
    merged = sorted_.groupBy("bucket").applyInArrow(verdicts, D_SCHEMA).repartition(parts, "g")
    return by_group.cogroup(merged.groupBy("g")).applyInArrow(remove, E_SCHEMA)


#: All windows as bytes; for the small tables of the SQL check.
SUFFIX_SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, array_slice(h, i + 1, i + {LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(n - {LENGTH - 1})) AS i FROM d WHERE n >= {LENGTH})),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
gone AS (SELECT w.doc_id, i FROM w JOIN f USING (s) WHERE first < w.doc_id),
cut AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM gone),
num AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM cut),
span AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM num GROUP BY doc_id, k),
edge AS (SELECT doc_id, 0 AS a, 0 AS b FROM d UNION ALL SELECT doc_id, a, b FROM span),
kept AS (SELECT doc_id, b AS s, lead(a) OVER (PARTITION BY doc_id ORDER BY a, b) AS e FROM edge),
text_ AS (SELECT d.doc_id, string_agg(hex(array_slice(h, s + 1, coalesce(e, n))), '' ORDER BY s) AS t FROM kept JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce((SELECT sum(b - a) FROM span WHERE span.doc_id = d.doc_id), 0)::BIGINT AS n_removed,
       (SELECT count(*) FROM span WHERE span.doc_id = d.doc_id)::BIGINT AS n_spans, sha256(unhex(text_.t)) AS kept_sha256
FROM d JOIN text_ USING (doc_id)
"""
