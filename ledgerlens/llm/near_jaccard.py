"""Pairs of documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

1  Each distinct set has 24 band keys of four min-hashes and a signature of all 96, a byte each. Sets that
   share a band key are in one bucket; a pair at similarity 0.8 shares none with probability
   (1 - 0.8^4)^24, some 3 in a million, and a pair above it more rarely still.
2  Stars: the first set of each bucket is its hub, and every other set that may be within the threshold of it
   is a candidate. It has then met all of its bucket and leaves it, and buckets whose sets are all linked are
   done. STARS such rounds link what is near a common centre, which is most.
3  Prefixes: of the sets still in open buckets, shingles are counted and ordered by how rare they are. Sets
   within the threshold share one of the rarest (1 - t) of each; and if the first shingle they share is at
   places i and j of this order, at most min(|a| - i, |b| - j) + 1 are shared, which rules most pairs out
   that have only common passages in common. Sets with a rare shingle in common are the new buckets, and
   growing numbers of hubs (HUBS, then GROWTH times as many, ...) meet the rest until all have met or are
   linked. This step leaves out no pair.
4  The shingles of candidates are compared exactly: the text of a hub is read once for up to SPOKES texts of
   others. Only texts of candidates move.

A task holds hubs alone and streams the rest. A signature that agrees in fewer than AGREE of 96 places rules a
pair out; one at 0.8 does so with a probability below one in a million. No pair is linked without the exact
comparison. 64-bit hashes of shingles stand for the shingles.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmap import bitmap
from .common import partitions, turn, written

WORDS, BANDS, EACH = 5, 24, 4
PLACES = BANDS * EACH
AGREE, SPOKES = 55, 256
STARS, HUBS, GROWTH = 2, 16, 16
_R = np.random.default_rng(5)
_XOR = _R.integers(0, 1 << 63, (PLACES, 1)).astype(np.uint64)
_MUL = _R.integers(0, 1 << 63, (PLACES, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)

def sketch(hashes: np.ndarray) -> tuple[bytes | None, int, list[int], bytes]:
    """(digest, size, band keys, signature) of a document's shingle hashes; null digest without shingles."""
    grams = np.unique(hashes)
    if not len(grams):
        return None, 0, [], b""
    least = np.full(PLACES, (1 << 64) - 1, np.uint64)
    for s in range(0, len(grams), 1 << 10):
        least = np.minimum(least, ((grams[None, s : s + (1 << 10)] ^ _XOR) * _MUL).min(axis=1))
    keys = [xxhash.xxh64_intdigest(part.tobytes(), band) for band, part in enumerate(least.reshape(BANDS, EACH))]
    return xxhash.xxh3_128_digest(grams.tobytes()), len(grams), np.array(keys, np.uint64).view(np.int64).tolist(), least.astype(np.uint8).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted arrays without repeats."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PLACES)


def _meet(batches: Iterator[pa.RecordBatch], hubs: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, digest): candidates (hub, hub_node, digest, node), and the rows that were no hub.

    ``comp`` names what a set is known to be linked with; for candidates it stands as the node.
    ``pos`` is the place of the key in the set's order; what comes after it bounds what two sets share.
    """
    key, seen, share = None, 0, threshold / (1 + threshold)
    digest: list[bytes] = []
    size, comp, left_over = (np.zeros(0, np.int64) for _ in range(3))
    sig = np.zeros((0, PLACES), np.uint8)
    for x in batches:
        keys, sizes, comps, places = (x[c].to_numpy() for c in ("key", "size", "comp", "pos"))
        over = sizes - places + 1
        digests, sigs = x["digest"].to_pylist(), _signatures(x["sig"])
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])).tolist() if len(keys) else []
        out: list[tuple] = []
        left: list[np.ndarray] = []
        for s, e in zip(cuts, cuts[1:], strict=False):
            if keys[s] != key:
                key, seen = keys[s], 0
                digest, size, comp, left_over, sig = [], sizes[:0], comps[:0], over[:0], sigs[:0]
            if len(digest) < hubs:
                to = min(e, s + hubs - len(digest))
                digest = digest + digests[s:to]
                size, comp, left_over, sig = (np.concatenate(p) for p in ((size, sizes[s:to]), (comp, comps[s:to]), (left_over, over[s:to]), (sig, sigs[s:to])))
            step = max(1, (1 << 24) // (PLACES * len(digest)))
            for a in range(s, e, step):
                b = min(e, a + step)
                fits = np.minimum(over[a:b, None], left_over) >= share * (sizes[a:b, None] + size) - 1e-9
                fits &= (comps[a:b, None] != comp) & (seen + np.arange(a - s, b - s)[:, None] > np.arange(len(digest)))
                row, hub = np.nonzero(fits)
                close = np.empty(len(row), bool)
                for c in range(0, len(row), 1 << 17):
                    close[c : c + (1 << 17)] = (sigs[a + row[c : c + (1 << 17)]] == sig[hub[c : c + (1 << 17)]]).sum(axis=1) >= AGREE
                out += [(digest[h], int(comp[h]), digests[a + r], int(comps[a + r])) for r, h in zip(row[close].tolist(), hub[close].tolist(), strict=True)]
            first = s + max(0, min(hubs - seen, e - s))
            left.append(np.arange(first, e))
            seen += e - s
        rest = x.take(pa.array(np.concatenate(left))) if left else x
        nulls = lambda n, kind: pa.nulls(n, kind)
        yield pa.record_batch([*(rest[c] for c in _MET[:6]), nulls(len(rest), pa.binary()), nulls(len(rest), pa.int64())], _MET)
        if out:
            h, hn, d, n = zip(*out, strict=True)
            yield pa.record_batch([nulls(len(out), pa.int64()), pa.array(d, pa.binary()), pa.array(n, pa.int64()), nulls(len(out), pa.int64()), nulls(len(out), pa.binary()), nulls(len(out), pa.int64()), pa.array(h, pa.binary()), pa.array(hn, pa.int64())], _MET)


_MET = ["key", "digest", "node", "size", "sig", "pos", "hub", "hub_node"]
MET = "key long, digest binary, node long, size long, sig binary, pos long, hub binary, hub_node long"


def _compare(batches: Iterator[pa.RecordBatch], hashes: Callable[[bytes], np.ndarray], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, salt, spoke), each hub's own text first: links (a, b) of nodes.

    What the task's links connect already is not compared again, so it gives fewer links than it has nodes.
    """
    grams = np.zeros(0, np.uint64)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    turn("near copies")
    for x in batches:
        a, b = [], []
        for spoke, hub_node, node, text in zip(x["spoke"].to_pylist(), x["hub_node"].to_pylist(), x["node"].to_pylist(), x["text"].cast(pa.binary()), strict=True):
            if not spoke:
                grams = np.unique(hashes(text.as_py()))
            elif (one := find(hub_node)) != (other := find(node)) and similarity(grams, np.unique(hashes(text.as_py()))) >= threshold:
                parent[one] = other
                a.append(hub_node)
                b.append(node)
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def texts_of(digests: DataFrame, nodes: DataFrame, sketches: DataFrame) -> DataFrame:
    """(digest, text): one text for each of the digests; others do not move."""
    wanted = written(digests.join(nodes.select("digest", "row"), "digest"), "jaccard-wanted")
    passes = bitmap(wanted.select("row"), "row")
    return written(sketches.filter(passes(F.xxhash64("row"))).select("row", "text").join(wanted, "row").select("digest", "text"), "jaccard-texts")


def verified(candidates: DataFrame, nodes: DataFrame, sketches: DataFrame, hashes: Callable[[bytes], np.ndarray], threshold: float) -> DataFrame:
    """(a, b): nodes of the candidates whose sets are within the threshold."""
    texts = texts_of(candidates.select(F.col("hub").alias("digest")).union(candidates.select("digest")).distinct(), nodes, sketches)
    salts = candidates.groupBy("hub").agg(F.count("*").alias("n")).select("hub", F.ceil(F.col("n") / SPOKES).alias("salts"))
    salted = candidates.join(salts, "hub").withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("salts")))
    spokes = salted.join(texts, "digest").select("hub", "salt", F.lit(True).alias("spoke"), "hub_node", "node", "text")
    heads = salted.groupBy("hub", "salt").agg(F.max("hub_node").alias("hub_node")).join(texts.withColumnRenamed("digest", "hub"), "hub").select("hub", "salt", F.lit(False).alias("spoke"), "hub_node", F.col("hub_node").alias("node"), "text")
    placed = heads.unionByName(spokes).repartition(partitions(candidates.sparkSession), "hub", "salt").sortWithinPartitions("hub", "salt", "spoke")
    return placed.mapInArrow(lambda it: _compare(it, hashes, threshold), "a long, b long")


def by_rare_shingles(rows: DataFrame, nodes: DataFrame, sketches: DataFrame, hashes: Callable[[bytes], np.ndarray], threshold: float) -> DataFrame:
    """``rows`` dealt out anew: a row for each of a set's rarest shingles that another set has too, with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            turn("near copies")
            for digest, text in zip(x["digest"].to_pylist(), x["text"].cast(pa.binary()), strict=True):
                grams = np.unique(hashes(text.as_py()))
                yield pa.record_batch([pa.array([digest] * len(grams), pa.binary()), pa.array(grams.view(np.int64), pa.int64())], ["digest", "key"])

    members = written(rows.dropDuplicates(["digest"]).select("digest", "node", "size", "sig", "comp"), "jaccard-open")
    shingles = written(texts_of(members.select("digest"), nodes, sketches).mapInArrow(run, "digest binary, key long"), "jaccard-shingles")
    counts = shingles.groupBy("key").agg(F.count("*").alias("n"))
    placed = shingles.join(counts, "key").withColumn("pos", F.row_number().over(Window.partitionBy("digest").orderBy("n", "key")).cast("long"))
    prefix = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
    return placed.filter("n > 1").join(members, "digest").filter(F.col("pos") <= prefix).select("key", "digest", "node", "size", "sig", "pos", "comp")


def links(sketches: DataFrame, edges: DataFrame, contracted: Callable[[DataFrame], DataFrame], hashes: Callable[[bytes], np.ndarray], threshold: float) -> DataFrame:
    """Edges (a, b) between fingerprints that connect what ``edges`` do, equal sets, and sets at ``threshold`` or more.

    ``sketches``: row (unique), fp, text, digest, size, bands, sig. ``contracted`` gives an edge from each node to the
    least one it reaches; ``hashes`` gives the shingle hashes of a text. What is known to be linked counts as one
    node: it is not compared, links are found between such nodes alone, and each step contracts its own.
    """
    some = sketches.filter("digest is not null")
    nodes = written(some.groupBy("digest").agg(F.min("fp").alias("node"), F.min("row").alias("row"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "jaccard-sets")
    equal = some.select("digest", "fp").distinct().join(nodes.select("digest", "node"), "digest").filter("fp <> node").select(F.col("fp").alias("a"), F.col("node").alias("b"))
    edges = contracted(edges.unionByName(equal))

    def still_open(rows: DataFrame) -> DataFrame:
        """``rows`` with the node of all they are linked with (comp), of buckets that hold several such nodes."""
        known = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        comps = written(rows.join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "jaccard-labelled")
        open_ = comps.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
        return written(comps.join(open_, "key", "left_semi"), "jaccard-buckets")

    keyed = nodes.select("digest", F.explode("bands").alias("key"))
    shared = keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1").drop("n")
    rows = still_open(shared.join(nodes.select("digest", "node", "size", "sig"), "digest").withColumn("pos", F.lit(1).cast("long")))
    for step in itertools.count():
        if not rows.limit(1).count():
            return edges
        if step == STARS:
            rows = written(by_rare_shingles(rows, nodes, sketches, hashes, threshold), "jaccard-buckets")
        hubs = 1 if step < STARS else HUBS * GROWTH ** (step - STARS)
        placed = rows.repartition(partitions(sketches.sparkSession), "key").sortWithinPartitions("key", "digest")
        met = written(placed.mapInArrow(lambda it, n=hubs: _meet(it, n, threshold), MET), "jaccard-met")
        candidates = written(met.filter("hub is not null").select("hub", "hub_node", "digest", "node").dropDuplicates(["hub", "digest"]), "jaccard-candidates")
        if candidates.limit(1).count():
            new = contracted(written(verified(candidates, nodes, sketches, hashes, threshold), "jaccard-links"))
            # the ends of new edges are the least of their group until now, so none of them is an "a" yet
            moved = edges.join(new.select(F.col("a").alias("b"), F.col("b").alias("to")), "b", "left").select("a", F.coalesce("to", "b").alias("b"))
            edges = written(moved.unionByName(new), "jaccard-known")
        rest = met.filter("hub is null").drop("hub", "hub_node")
        if not rest.limit(1).count():
            return edges
        rows = still_open(rest)
