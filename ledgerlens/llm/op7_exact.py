"""Exact dedup: binary-fuse filters over immutable snapshots, exact buckets behind them.

A snapshot is a written table of distinct normalised texts (digest, bucket, keeper, size of its group) with
one static binary-fuse filter per digest bucket. A new batch is first grouped by digest itself (partial
aggregation: a hot text is one row per task). Its distinct digests meet the filter of their bucket:

* negatives are proven new, as the filter has no false negatives: they are appended to the next snapshot and
  meet no stored text,
* positives join the exact bucket by the full digest, and their normalised bytes are compared. What the
  bucket has raises the size of the stored group and may take its place as keeper; the rest is appended.

``exact_groups`` runs a table as a sequence of such batches.

Texts are equal when identical after deleting [\\x20\\x09-\\x0D]; null counts as empty. Of equal texts the
row with the most code points, then the smallest doc_id stays; a null doc_id is larger than all others.
Rows that share a doc_id are one row each, and all but the first of them are dropped with the group. Only
doc_id and text are read, so other columns may have any name; an empty table has no groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitmap import bitmap
from .common import id_text, partitions, size_in_bytes, written

SPACE = " \t\n\x0b\x0c\r"
BUCKET_BYTES = 64 << 20  # of texts: their digests are what a task holds


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class FuseFilter:
    """A static three-wise binary-fuse filter with 16-bit fingerprints (about 9 bits each 8 bits of key space)."""

    def __init__(self, seed: int, segment: int, count: int, table: np.ndarray) -> None:
        self.seed, self.segment, self.count, self.table = seed, segment, count, table

    @staticmethod
    def places(h: np.ndarray, segment: int, count: int) -> np.ndarray:
        """Three places in consecutive segments."""
        high = (h >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)
        base = high * np.uint64(segment)
        m = np.uint64(segment - 1)
        return np.stack([base + (h & m), base + np.uint64(segment) + ((h >> np.uint64(18)) & m), base + np.uint64(2 * segment) + ((h >> np.uint64(36)) & m)]).astype(np.int64)

    @staticmethod
    def prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32)) ^ (h >> np.uint64(48))) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """``keys``: 64-bit, distinct after np.unique. Peeling in rounds; another seed if it gets stuck."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))
        count = max(1, -(-int(max(n, 1) * factor) // segment) - 2 + (n < 100) * 2)
        for seed in range(1, 200):
            h = mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            at = cls.places(h, segment, count)
            size = (count + 2) * segment
            degree = np.bincount(at.ravel(), minlength=size)
            held = np.zeros(size, np.int64)
            for row in at:
                np.bitwise_xor.at(held, row, np.arange(n))
            alive = np.ones(n, bool)
            rounds: list[tuple[np.ndarray, np.ndarray]] = []
            single = np.flatnonzero(degree == 1)
            while len(single):
                key, first = np.unique(held[single], return_index=True)
                slot = single[first]
                good = alive[key]
                key, slot = key[good], slot[good]
                if not len(key):
                    break
                rounds.append((key, slot))
                alive[key] = False
                touched = at[:, key].ravel()
                np.subtract.at(degree, touched, 1)
                for row in at:
                    np.bitwise_xor.at(held, row[key], key)
                touched = np.unique(touched)
                single = touched[degree[touched] == 1]
            if not alive.any():
                table, prints = np.zeros(size, np.uint16), cls.prints(h)
                for key, slot in reversed(rounds):
                    table[slot] = 0
                    p = at[:, key]
                    table[slot] = prints[key] ^ table[p[0]] ^ table[p[1]] ^ table[p[2]]
                return cls(seed, segment, count, table)
            count += max(1, count // 20)
        raise ValueError("no seed found")

    def has(self, keys: np.ndarray) -> np.ndarray:
        h = mix(keys.astype(np.uint64), self.seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        a, b, c = self.places(h, self.segment, self.count)
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == self.prints(h)

    def pack(self) -> bytes:
        return np.array([self.seed, self.segment, self.count], "<u8").tobytes() + self.table.astype("<u2").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> FuseFilter:
        seed, segment, count = np.frombuffer(data, "<u8", 3).tolist()
        return cls(seed, segment, count, np.frombuffer(data, "<u2", -1, 24))


def normalised(col: str = "text"):
    """The text without [\\x20\\x09-\\x0D]."""
    return F.translate(col, SPACE, "")


def keys_of(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests.to_pylist()), ">u8").astype(np.uint64)


def build_filters(snapshot: DataFrame) -> DataFrame:
    """bucket, filter: one static filter for each bucket of a snapshot."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "filter": pa.array([FuseFilter.build(keys_of(table["digest"])).pack()], pa.binary())})

    return snapshot.select("bucket", "digest").groupBy("bucket").applyInArrow(run, "bucket long, filter binary")


def screen(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows of a grouped batch with ``maybe``: false is a proof that the snapshot lacks the digest."""
    schema = "bucket long, digest binary, chars long, doc_id long, n long, maybe boolean"

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        maybe = FuseFilter.unpack(right["filter"][0].as_py()).has(keys_of(left["digest"])) if right.num_rows and left.num_rows else np.zeros(left.num_rows, bool)
        return left.append_column("maybe", pa.array(maybe))

    flat = batch.select("bucket", "digest", "best.chars", doc_id_of(F.col("best")).alias("doc_id"), "n")
    found = flat.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(run, schema)
    return found.select("bucket", "digest", rank().alias("best"), "n", "maybe")


def rank() -> Column:
    """Of two rows the one to keep has the larger: most code points, then a doc_id at all, then the smallest."""
    return F.struct("chars", F.col("doc_id").isNotNull().alias("named"), F.bitwise_not("doc_id").alias("order"))


def doc_id_of(best: Column) -> Column:
    return F.bitwise_not(best["order"])


def group(rows: DataFrame) -> DataFrame:
    """Of rows (digest, bucket, doc_id, chars): one per digest with the best and the number of rows."""
    return rows.groupBy("bucket", "digest").agg(F.max(rank()).alias("best"), F.count("*").alias("n"))


def exact_groups(docs: DataFrame, batches: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    buckets = max(partitions(spark), -(-size_in_bytes(docs) // BUCKET_BYTES))
    texts = id_text(docs)
    digest = F.unhex(F.sha2(normalised(), 256))
    rows = texts.select("doc_id", digest.alias("digest"), F.char_length("text").cast("long").alias("chars"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets))).withColumn("batch", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(batches)))
    rows = written(rows, "exact-digests")
    stored = written(group(rows.filter("batch = 0")), "exact-snapshot")
    for k in range(1, batches):
        stored = written(with_batch(texts, stored, group(rows.filter(F.col("batch") == k))), "exact-snapshot")
    keep = stored.select("digest", doc_id_of(F.col("best")).alias("keep_id"), F.col("n").alias("group_size"))
    out = rows.join(keep, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "chars")
    return single(out).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def with_batch(texts: DataFrame, stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The snapshot after ``batch``: only what passes the filter meets what is stored."""
    screened = written(screen(batch, build_filters(stored)), "exact-batch")
    hits = checked(texts, stored, screened.filter("maybe"))
    both = stored.join(hits.select("digest", F.col("best").alias("new_best"), F.col("n").alias("new_n")), "digest", "left")
    grown = both.select("bucket", "digest", F.greatest("best", "new_best").alias("best"), (F.col("n") + F.coalesce("new_n", F.lit(0))).alias("n"))
    fresh = screened.filter("not maybe").unionByName(screened.filter("maybe").join(hits.select("digest"), "digest", "left_anti"))
    return grown.unionByName(fresh.select("bucket", "digest", "best", "n"))


def single(out: DataFrame) -> DataFrame:
    """Where rows share the keeper's doc_id, one of them alone is kept: the longest, then any of equals."""
    several = out.filter("kept").groupBy("digest").count().filter("count > 1")
    if not several.limit(1).count():
        return out
    within = Window.partitionBy("digest").orderBy(F.desc("kept"), F.desc("chars"))
    twice = out.filter("kept").join(several, "digest", "left_semi").withColumn("kept", F.row_number().over(within) == 1)
    return out.join(several, "digest", "left_anti").unionByName(twice).unionByName(out.filter("not kept").join(several, "digest", "left_semi"))


def checked(texts: DataFrame, stored: DataFrame, positives: DataFrame) -> DataFrame:
    """The positives that the exact buckets have, by digest and by the normalised bytes of both keepers.

    Texts of other documents stay where they are: a bitmap of the keepers' doc_ids, of 8 MB at most however
    many there are, lets the keepers pass (and few others, or more of them beyond some millions of keepers).
    A pair of different texts with one SHA-256 would stop the job rather than join two groups.
    """
    both = written(positives.select("bucket", "digest", "best", "n").join(stored.select("bucket", "digest", F.col("best").alias("old")), ["bucket", "digest"]), "exact-hits")
    wanted = both.select(doc_id_of(F.col("best")).alias("at"), F.col("digest").alias("want")).unionByName(both.select(doc_id_of(F.col("old")).alias("at"), F.col("digest").alias("want")))
    passes = bitmap(wanted.select("at"), "at")
    content = texts.filter(passes(F.xxhash64("doc_id"))).select("doc_id", normalised().alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))
    found = content.join(wanted.hint("merge"), content["doc_id"].eqNullSafe(wanted["at"]) & (content["digest"] == wanted["want"]))
    same = found.groupBy("want").agg(F.min("content").alias("lo"), F.max("content").alias("hi"))
    equal = same.select(F.when(F.col("lo") == F.col("hi"), F.col("want")).otherwise(F.raise_error(F.lit("different texts with one SHA-256"))).alias("digest"))
    return both.drop("old").join(equal, "digest")
