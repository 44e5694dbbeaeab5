"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint has 64 bits over word shingles. Each bit position gets one of the 31 non-zero vectors of
F2^(r+1); table v keeps the positions whose vector has an odd product with v. Any r positions span at
most r dimensions, so some v is orthogonal to all of them: fingerprints at distance r or less agree in
all kept bits of at least one table. No pair is lost, whatever the fingerprints look like.

Distinct fingerprints alone go to the tables (copies are one row), a bucket returns the edges of a
spanning forest of its links (fewer than it has members, never all pairs), and a bucket above
``bucket_limit`` is dealt out again, as often as it takes, by covering masks over the bits that its members
do not share yet. With fewer than 2^radius of these a bucket is no longer dealt out: it has at most as many
distinct members as these bits have values.

Components are those of fingerprints, and take the smallest doc_id of their rows. Nulls are empty texts; a
text without words has fingerprint zero and is linked like any other. A null doc_id is kept and never names
a component others are in (one without any doc_id has a null component_id). Rows that share a doc_id are
linked as one. Only doc_id and text are read, and other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_jaccard
from .common import checkpointed, id_text, partitions, positional, text_bytes, turn, written

BITS = 64
BUCKET_LIMIT = 1 << 18
DENSE = 1500


def shingle_hashes(text: bytes, words_each: int, seed: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; A-Z are lower-cased."""
    words = text.lower().split()  # of bytes: ASCII letters, and [\x20\x09-\x0D]
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    n = len(words) - words_each + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    digest = xxhash.xxh64_intdigest
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends[words_each - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for s in range(0, len(hashes), 1 << 14):
        part = np.unpackbits(hashes[s : s + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_each: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("near copies")
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), words_each, seed)) for t in batch["text"].cast(pa.binary())]
            yield pa.record_batch([batch["doc_id"], pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], ["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def sketches(docs: DataFrame, words_each: int = 4, seed: int = 42) -> DataFrame:
    """``fingerprints`` with the text and the sketch of each row's set of five-word shingles, and a number for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("near copies")
        for batch in batches:
            fps, found = [], []
            for t in batch["text"].cast(pa.binary()):
                t = t.as_py()
                fps.append(fingerprint(shingle_hashes(t, words_each, seed)))
                found.append(near_jaccard.sketch(shingle_hashes(t, near_jaccard.WORDS, seed)))
            digest, size, bands, sig = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.record_batch([batch["doc_id"], pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64()), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary()), batch["text"]], ["doc_id", "fp", "digest", "size", "bands", "sig", "text"])

    rows = id_text(docs).mapInArrow(run, "doc_id long, fp long, digest binary, size long, bands array<long>, sig binary, text string")
    return rows.withColumn("row", F.monotonically_increasing_id())  # fixed by writing it


def covering_masks(radius: int, within: int = (1 << BITS) - 1) -> list[int]:
    """Masks such that any two values at distance ``radius`` or less inside ``within`` agree on one of them."""
    top = 1 << (radius + 1)
    places = [i for i in range(BITS) if within >> i & 1]
    out = []
    for v in range(1, top):
        mask = 0
        for j, i in enumerate(places):
            if ((j % (top - 1) + 1) & v).bit_count() & 1:
                mask |= 1 << i
        out.append(mask)
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, radius: int, shared: int = 0) -> list[tuple[int, int]]:
    """Index pairs at distance ``radius`` or less that connect what such pairs connect; at most len(fps) - 1 of them."""
    parent = list(range(len(fps)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, int]] = []

    def link(a: int, b: int) -> None:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))

    def dense(at: np.ndarray) -> None:
        part = fps[at]
        for i in range(len(at) - 1):
            near = np.flatnonzero(np.bitwise_count(part[i + 1 :] ^ part[i]) <= radius)
            for j in near.tolist():
                link(int(at[i]), int(at[i + 1 + j]))

    def split(at: np.ndarray, shared: int) -> None:
        if len(at) <= DENSE or shared == (1 << BITS) - 1:
            dense(at)
            return
        for mask in covering_masks(radius, ~shared & ((1 << BITS) - 1)):
            if not mask:
                dense(at)
                return
            key = fps[at] & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    split(at[part], shared | mask)

    split(np.arange(len(fps)), shared)
    return out


def _buckets(batches: Iterator[pa.RecordBatch], radius: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shared, key): links (a, b) of each bucket, or its rows again (linked null) if it is to be dealt out."""
    names = ["a", "b", "shared", "fp", "rep"]
    held: list[tuple[np.ndarray, ...]] = []
    held_rows, current, spilling = 0, None, False

    def again(shared, fp, rep):
        none = pa.nulls(len(fp), pa.int64())
        return pa.record_batch([none, none, pa.array(np.full(len(fp), shared), pa.int64()), pa.array(fp, pa.int64()), pa.array(rep, pa.int64())], names)

    def close() -> Iterator[pa.RecordBatch]:
        fp, rep = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(fp) > 1 and (pairs := forest(fp.view(np.uint64), radius, current[0] & (1 << BITS) - 1)):
            i, j = np.array(pairs).T
            none = pa.nulls(len(i), pa.int64())
            yield pa.record_batch([pa.array(rep[i], pa.int64()), pa.array(rep[j], pa.int64()), none, none, none], names)

    for x in batches:
        shared, key, fp, rep = (x[n].to_numpy() for n in ("shared", "key", "fp", "rep"))
        cuts = np.flatnonzero((shared[1:] != shared[:-1]) | (key[1:] != key[:-1])) + 1
        begin, end = np.concatenate(([0], cuts)).astype(np.int64), np.concatenate((cuts, [len(shared)])).astype(np.int64)
        if not len(shared):
            continue
        # buckets of one row inside the batch have no links
        several = (end - begin > 1) | (begin == 0) | (end == len(shared))
        for s, e in zip(begin[several].tolist(), end[several].tolist(), strict=True):
            k = (int(shared[s]), int(key[s]))
            if current != k:
                if held:
                    yield from close()
                held, held_rows, spilling, current = [], 0, False, k
            if spilling:
                yield again(k[0], fp[s:e], rep[s:e])
                continue
            held.append((fp[s:e], rep[s:e]))
            held_rows += e - s
            if held_rows > limit and BITS - (k[0] & (1 << BITS) - 1).bit_count() >= 1 << radius:
                for f, r in held:
                    yield again(k[0], f, r)
                held, spilling = [], True
            elif e < len(shared):
                yield from close()
                held, current = [], None
    if held:
        yield from close()


def _deal(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Each row under the covering masks over the bits that its bucket does not share."""
    for x in batches:
        shared, fp, rep = (x[n].to_numpy() for n in ("shared", "fp", "rep"))
        for s in np.unique(shared).tolist():
            own = shared == s
            for mask in covering_masks(radius, ~s & (1 << BITS) - 1):
                to = np.full(int(own.sum()), s | signed(mask))
                yield pa.record_batch([pa.array(to, pa.int64()), pa.array(fp[own] & to, pa.int64()), pa.array(fp[own], pa.int64()), pa.array(rep[own], pa.int64())], ["shared", "key", "fp", "rep"])


def links(reps: DataFrame, radius: int = 4, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) between representatives that connect all distinct fingerprints within ``radius``.

    ``reps``: fp long (distinct), rep long. A bucket is known by the bits that its members share and their values.
    """
    spark = reps.sparkSession
    tables = F.explode(F.array(*[F.lit(signed(m)) for m in covering_masks(radius)]))
    rows = reps.select("fp", "rep", tables.alias("shared")).select("shared", F.col("fp").bitwiseAND(F.col("shared")).alias("key"), "fp", "rep")
    edges = None
    while True:
        placed = rows.repartition(partitions(spark), "shared", "key").sortWithinPartitions("shared", "key", "fp")
        done = written(placed.mapInArrow(lambda it: _buckets(it, radius, bucket_limit), "a long, b long, shared long, fp long, rep long"), "simhash-buckets")
        found = done.filter("a is not null").select("a", "b")
        edges = found if edges is None else edges.unionByName(found)
        large = done.filter("a is null")
        if not large.limit(1).count():
            return edges
        # buckets of several tables can share the same bits: they are one bucket
        rows = large.select("shared", "fp", "rep").mapInArrow(lambda it: _deal(it, radius), "shared long, key long, fp long, rep long").distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """An edge (a, b) from each node of ``edges`` to the least node it reaches, by alternating stars.

    Each round links every node to the least of its neighbourhood, until nothing changes; the number of
    rounds is logarithmic in the longest path. Rows are distinct edges, so a hub is joined, never gathered
    in one row, and a join makes as many rows as it reads edges. A node that is the least itself has no edge.
    """
    now = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # read twice below
        large = checkpointed(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        now = checkpointed(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("a"), F.col("v").alias("b"))
        before = state


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` reaches, where that is another one."""
    return contracted(edges).select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_groups(docs: DataFrame, words_each: int = 4, seed: int = 42, radius: int = 4, bucket_limit: int = BUCKET_LIMIT, jaccard: float | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    With ``jaccard``, documents whose five-word shingles are at least so similar are linked as well.
    """
    fps = written((fingerprints if jaccard is None else sketches)(docs, words_each, seed), "simhash")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    nodes = reps.select("fp", F.col("fp").alias("rep"))
    edges = links(nodes, radius, bucket_limit)
    if jaccard is not None:
        edges = near_jaccard.links(fps, edges, contracted, lambda t: shingle_hashes(t, near_jaccard.WORDS, seed), jaccard)
    # rows that share a doc_id are linked as one, whatever their texts
    repeated = fps.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("doc_id", "lo")
    edges = edges.unionByName(fps.join(repeated, "doc_id").filter("fp <> lo").select(F.col("fp").alias("a"), F.col("lo").alias("b")))
    found = components(edges)
    labels = reps.join(found, reps["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    named = labels.groupBy("c").agg(F.min("least").alias("component_id"))
    out = fps.select("doc_id", "fp").join(labels.join(named, "c").select("fp", "component_id"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows and columns of ``docs`` whose doc_id names its group; of rows that share it, one stays.

    Which of several rows with the kept doc_id stays: the one with the smallest text. Rows without a
    doc_id stay only in groups that have no doc_id at all, one for each fingerprint.
    """
    rows, at = positional(docs)
    plain, id_, text = rows.columns, F.col(at["doc_id"]).cast("long"), F.coalesce(F.col(at["text"]).cast("string"), F.lit(""))
    groups = written(near_groups(docs, **options), "simhash-groups")
    named = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    kept = rows.select("*", id_.alias("id")).join(named, "id", "left_semi")
    several = groups.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if several.limit(1).count():
        repeated = several.filter("doc_id is not null").select(F.col("doc_id").alias("id"))
        first = kept.join(repeated, "id", "left_semi").groupBy("id").agg(F.min_by(F.struct(*plain), text).alias("row"))
        lone = groups.filter("doc_id is null and component_id is null").select("fingerprint").distinct()
        marked = rows.filter(id_.isNull()).withColumn("fingerprint", fingerprint_of(**{k: v for k, v in options.items() if k in ("words_each", "seed")})(text))
        alone = marked.join(lone, "fingerprint", "left_semi").groupBy("fingerprint").agg(F.min_by(F.struct(*plain), text).alias("row"))
        kept = kept.join(repeated, "id", "left_anti").select(*plain).unionByName(first.select("row.*")).unionByName(alone.select("row.*"))
    return kept.select(*plain).toDF(*docs.columns)


def fingerprint_of(words_each: int = 4, seed: int = 42):
    """A column function: text -> 16 hex digits."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([f"{fingerprint(shingle_hashes(t, words_each, seed)):016x}" for t in text_bytes(texts)], pa.string())

    return run
