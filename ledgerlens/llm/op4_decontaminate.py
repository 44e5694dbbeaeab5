"""Benchmark decontamination: item-sized windows, SimHash with multi-index blocks, exact verification.

A document is contaminated by an item if some window with as many words as the item has a 64-bit SimHash
of its words within ``radius`` of the item's, and a weighted (multiset) Jaccard similarity of word shingles
of at least ``threshold`` with it. Shingles have five words, or all words of a shorter item. Words are
lower-cased, ASCII punctuation separates them. A document shorter than the item is one window.

1  Windows: one at the threshold holds at least 2ct / (1 + t) places of the item's c shingles, so only starts
   of windows that hold as many for some item of their size are fingerprinted. No other window can pass
   step 3; ``prune=False`` fingerprints all of them and finds the same.
2  Fingerprints of a stretch of windows come from running bit counts. Item fingerprints are cut into
   radius // 3 + 1 blocks (four at least), and every block is listed under all values at two bits or less from its own: two
   fingerprints within the radius cannot differ in three bits or more of every block, so the lists of a
   window's own values hold every item of its size within the radius. These alone are candidates.
3  The shingle similarity of each candidate with its window is computed exactly.

Similar texts have near fingerprints, not surely so: of edits that leave a similarity of 0.8 to 0.85, the
README gives the share whose best windows lie within the radius.

Items are read in blocks of at most ``block_items`` items and ``block_bytes`` bytes (or one item), each
sent with the tasks of one pass; from the second on, a pass reads what the one before wrote.

Null and empty texts are clean, items that are null or have no words match nothing. doc_id is carried,
never compared; every row is judged by itself, and repeated rows alike. Of several items, the most similar,
then the smallest item_id is named (a null item_id comes last); repeated items count once. Other columns of
both tables are carried or ignored under any name.
"""

from __future__ import annotations

import math
import string
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positional, turn, written

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 17
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
TABLE = bytes(ord(" ") if chr(i) in string.punctuation else i for i in range(256))
PRIME = np.uint64(0x9E3779B97F4A7C15)
STRETCH = 1 << 13  # windows fingerprinted at once
FLIPS = 2  # bits by which a block may differ

Item = tuple[int | None, str]


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(TABLE).split()


def shingles(words: list[bytes], size: int) -> Counter:
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def similarity(a: Counter, b: Counter) -> float:
    """Multiset Jaccard."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def rolling_fingerprints(words: list[bytes], size: int) -> np.ndarray:
    """The SimHash of each window of ``size`` words: bits set in over half of the words' hashes."""
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], "<u8")
    counts = np.zeros((len(words) + 1, 64), np.int32)
    np.cumsum(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int32, out=counts[1:])
    over = (counts[size:] - counts[:-size]) * 2 > size
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


class HammingIndex:
    """Fingerprints of items by size; finds all within the radius through blocks."""

    def __init__(self, fingerprints: np.ndarray, sizes: list[int], radius: int) -> None:
        self.fingerprints, self.radius = fingerprints, radius
        self.rank = {size: i for i, size in enumerate(sorted(set(sizes)))}
        ranks = np.array([self.rank[x] for x in sizes], np.int64)
        cuts = np.linspace(0, 64, max(4, radius // (FLIPS + 1) + 1) + 1).astype(int).tolist()
        self.blocks = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []
        for at, width in self.blocks:
            own = ranks << width | self.part(fingerprints, at, width)
            flips = [sum(1 << b for b in bits) for n in range(min(FLIPS, width) + 1) for bits in combinations(range(width), n)]
            keys = (own[:, None] ^ np.array(flips, np.int64)).ravel()
            order = np.argsort(keys, kind="stable")
            self.lists.append((keys[order], (order // len(flips)).astype(np.int32)))

    @staticmethod
    def part(fingerprints: np.ndarray, at: int, width: int) -> np.ndarray:
        return (fingerprints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)

    def near(self, fingerprints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``fingerprints``, item) for all items of this size within the radius."""
        if size not in self.rank:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = []
        for (at, width), (keys, items) in zip(self.blocks, self.lists, strict=True):
            own = self.rank[size] << width | self.part(fingerprints, at, width)
            first, last = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            n = last - first
            window = np.repeat(np.arange(len(own)), n)
            item = items[np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
            close = np.bitwise_count(fingerprints[window] ^ self.fingerprints[item]) <= self.radius
            found.append(window[close] << 32 | item[close])
        both = np.unique(np.concatenate(found))
        return both >> 32, both & 0xFFFFFFFF


class Index:
    """A block of items: vocabulary, shingles, and the index of their fingerprints."""

    def __init__(self, items: list[Item], radius: int = RADIUS, threshold: float = THRESHOLD, prune: bool = True) -> None:
        self.threshold, self.prune = threshold, prune
        self.items = [(i, w) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, _ in self.items]
        self.sizes = [len(w) for _, w in self.items]
        self.kinds = [min(SHINGLE, n) for n in self.sizes]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted(set(self.kinds)):
            own = [n for n, kind in enumerate(self.kinds) if kind == k]
            keys = [self.keys(np.fromiter(map(self.vocabulary.get, self.items[n][1]), np.int64, self.sizes[n]), k) for n in own]
            key, item = np.concatenate(keys), np.repeat(np.array(own), [len(x) for x in keys])
            order = np.lexsort((item, key))
            key, item = key[order], item[order]
            first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (item[1:] != item[:-1]))))
            count = np.diff(np.concatenate((first, [len(key)])))
            key, item = key[first], item[first]
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            self.shingles[k] = key[at], np.concatenate((at, [len(key)])), item, count
        fingerprints = np.array([int(rolling_fingerprints(w, len(w))[0]) for _, w in self.items], np.uint64)
        self.index = HammingIndex(fingerprints, self.sizes, radius)

    @staticmethod
    def keys(ids: np.ndarray, k: int) -> np.ndarray:
        n = len(ids) - k + 1
        out = np.zeros(max(n, 0), np.uint64)
        for j in range(k):
            out = out * PRIME + ids[j : j + n].astype(np.uint64) + np.uint64(1)
        return out

    def held(self, words: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """item -> (place, shingle, how often the item has it) of the words' shingles that it has, in order."""
        ids = np.fromiter(map(self.vocabulary.get, words, (-1 for _ in words)), np.int64, len(words))
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, (known, starts, items, counts) in self.shingles.items():
            n = len(ids) - k + 1
            if n < 1:
                continue
            good = np.ones(n, bool)
            for j in range(k):
                good &= ids[j : j + n] >= 0
            at = np.flatnonzero(good)
            if not len(at):
                continue
            keys = np.zeros(len(at), np.uint64)
            for j in range(k):
                keys = keys * PRIME + ids[at + j].astype(np.uint64) + np.uint64(1)
            place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            found = known[place] == keys
            for p, key in zip(at[found].tolist(), place[found].tolist(), strict=True):
                for e in range(starts[key], starts[key + 1]):
                    out[int(items[e])].append((p, key, int(counts[e])))
        return out

    def spans(self, item: int, places: list[int], n_words: int) -> Iterator[tuple[int, int]]:
        """Stretches of starts (both ends in) whose window has enough ``places`` of the item's shingles."""
        k, size = self.kinds[item], self.sizes[item]
        all_, wide = size - k + 1, min(size, n_words) - k + 1
        need = max(1, math.ceil(self.threshold * (all_ + wide) / (1 + self.threshold) - 1e-9))
        for a, b in zip(places, places[need - 1 :], strict=False):
            first, last = max(0, b - wide + 1), min(a, max(0, n_words - size))
            if first <= last:
                yield first, last

    def stretches(self, held: dict[int, list[tuple[int, int, int]]], n_words: int) -> Iterator[tuple[int, int, int]]:
        """(size, first, last) of the starts to fingerprint, apart from each other."""
        if not self.prune:
            yield from ((size, 0, max(0, n_words - size)) for size in sorted(set(self.sizes)) if n_words)
            return
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, places in held.items():
            spans[self.sizes[item]] += self.spans(item, [p for p, *_ in places], n_words)
        for size, own in spans.items():
            begin = end = None
            for first, last in sorted(own):
                if end is not None and first <= end + 1:
                    end = max(end, last)
                    continue
                if end is not None:
                    yield size, begin, end
                begin, end = first, last
            if end is not None:
                yield size, begin, end

    def candidates(self, words: list[bytes], size: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
        """(item, starts) within the radius among the windows from ``first`` to ``last``."""
        for s in range(first, last + 1, STRETCH):
            e = min(last + 1, s + STRETCH)
            wide = min(size, len(words))
            window, item = self.index.near(rolling_fingerprints(words[s : e - 1 + wide], wide), size)
            order = np.argsort(item, kind="stable")
            window, item = window[order] + s, item[order]
            cuts = np.flatnonzero(np.diff(item)) + 1
            if len(item):
                yield from zip(item[np.concatenate(([0], cuts))].tolist(), np.split(window, cuts), strict=True)

    def scores(self, item: int, held: list[tuple[int, int, int]], n_words: int, starts: np.ndarray) -> Iterator[tuple[float, int]]:
        """(similarity, start) of the item with the windows at ``starts``, by counts carried along."""
        k = self.kinds[item]
        wide = min(self.sizes[item], n_words) - k + 1
        sizes = self.sizes[item] - k + 1 + wide
        seen: Counter = Counter()
        both = 0
        add = drop = bisect_left(held, (int(starts[0]),))
        for start in starts.tolist():
            while add < len(held) and held[add][0] < start + wide:
                _, key, wanted = held[add]
                seen[key] += 1
                both += seen[key] <= wanted
                add += 1
            while drop < add and held[drop][0] < start:
                _, key, wanted = held[drop]
                both -= seen[key] <= wanted
                seen[key] -= 1
                drop += 1
            yield both / (sizes - both), start

    def match(self, text: str) -> tuple[int | None, float, int] | None:
        """(item_id, similarity, number of items) of a contaminated text."""
        words = words_of(text)
        held = self.held(words)
        best: dict[int, tuple[float, int]] = {}
        for size, first, last in self.stretches(held, len(words)):
            for item, starts in self.candidates(words, size, first, last):
                if item in held:  # an item without any shingle of the text has a similarity of 0
                    score, start = max(self.scores(item, held[item], len(words), starts), key=lambda x: (x[0], -x[1]))
                    if score >= self.threshold and score > best.get(item, (0.0, 0))[0]:
                        best[item] = score, start
        found = []
        for item, (_, start) in best.items():  # by the words themselves
            k, size = self.kinds[item], self.sizes[item]
            if (score := similarity(shingles(words[start : start + size], k), shingles(self.items[item][1], k))) >= self.threshold:
                found.append((-score, self.ids[item] is None, self.ids[item] or 0, item))
        if not found:
            return None
        score, _, _, item = min(found)
        return self.ids[item], -score, len(found)


def blocks_of(benchmark: DataFrame, block_items: int, block_bytes: int) -> Iterator[list[Item]]:
    """The distinct items, in order of item_id, in bounded blocks; the driver holds one at a time."""
    block: list[Item] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        more = len(row.text.encode("utf-8", "surrogatepass"))
        if block and (len(block) >= block_items or size + more > block_bytes):
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += more
    if block:
        yield block


LEAK = "struct<item_id:bigint,similarity:double,n_items:bigint>"


def _matcher(sent, radius: int, threshold: float):
    held: dict[int, Index] = {}
    name = f"decontamination {uuid.uuid4()}"  # each block's index is on its own
    kind = pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("n_items", pa.int64())])

    @F.arrow_udf(LEAK)
    def match(texts: pa.Array) -> pa.Array:
        turn(name, held.clear)
        if 0 not in held:
            held[0] = Index(sent.value, radius, threshold)
        found = (held[0].match(x.as_py()) if x.is_valid else None for x in texts)
        return pa.array([None if f is None else dict(zip(("item_id", "similarity", "n_items"), f, strict=True)) for f in found], kind)

    return match


def _better(a, b):
    """Of two leaks, either of them null: the better one with the number of items of both."""
    first = (a["similarity"] > b["similarity"]) | ((a["similarity"] == b["similarity"]) & (b["item_id"].isNull() | F.coalesce(a["item_id"] <= b["item_id"], F.lit(False))))
    top = F.when(first, a).otherwise(b)
    both = F.struct(top["item_id"].alias("item_id"), top["similarity"].alias("similarity"), (a["n_items"] + b["n_items"]).alias("n_items"))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def marked(rows: DataFrame, text: str, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` with ``leak`` (null: clean): one pass for each block, so that a task holds one block's index."""
    names = rows.columns
    rows = rows.select(*names, F.lit(None).cast(LEAK).alias("leak"))
    for n, block in enumerate(blocks_of(benchmark, block_items, block_bytes)):
        if n:
            rows = written(rows, "decontaminate-pass")
        sent = rows.sparkSession.sparkContext.broadcast(block)  # at most block_bytes of texts, or one item
        got = rows.select(*names, "leak", _matcher(sent, radius, threshold)(F.col(text)).alias("more"))
        rows = got.select(*names, _better(F.col("leak"), F.col("more")).alias("leak"))
    return rows


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, contaminated, item_id, similarity, n_items."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = marked(rows, "text", benchmark, **options)
    return found.select("doc_id", F.col("leak").isNotNull().alias("contaminated"), "leak.item_id", "leak.similarity", F.coalesce("leak.n_items", F.lit(0).cast("long")).alias("n_items"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows and columns of ``docs`` that no item contaminates."""
    rows, at = positional(docs)
    found = marked(rows, at["text"], benchmark, **options)
    return found.filter("leak is null").drop("leak").toDF(*docs.columns)
