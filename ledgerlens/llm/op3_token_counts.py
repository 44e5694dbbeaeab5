"""Token counts through a digest cache.

content digest + tokenizer version digest -> stored count. Texts whose digest is not in the cache are
encoded once per digest, however many documents have them, and appended; counts then join back by digest.

The normalised content is the text itself with null as empty: anything more would change counts. The
version is the digest of the tokenizer's bytes, so a changed file never meets old counts.

The library encodes each distinct piece between safe cuts once per worker: before a single space with
non-space characters on both sides, where the byte-level split pattern always starts anew. A worker takes
about SLICE characters at once (a longer text in stretches between cuts) and remembers pieces of up to
MEMO_LENGTH characters, MEMO_PIECES of them, so its memory has a bound unless one piece alone exceeds it.

Nulls are empty texts with no tokens. doc_id is carried, and compared only to find one row of each missing
digest: null or repeated ids give one row each. Only doc_id and text are read, so other columns may have any
name; an empty table gives no rows and an empty cache.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import bitmap
from .common import id_text, turn, written
from .pieces import Pieces

MEMO_PIECES, MEMO_PARTS, MEMO_LENGTH = 300_000, 50_000, 64
SLICE = 1 << 19
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
CUT = re.compile(r"(?<=\S) (?=\S)")
CACHE_SCHEMA = "digest binary, version string, n_tokens long"


@cache
def version_of(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def stretches(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in stretches of about ``size`` characters that begin at safe cuts."""
    at = 0
    while len(text) - at > size and (cut := CUT.search(text, at + size - 1)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Counter:
    """Counts tokens of whole texts, with remembered pieces."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.known: dict[str, int] = {}
        self.cuts = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.sizes = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]  # its merges may cross spaces
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            setup = json.loads(Path(path).read_text())
            if setup.get("normalizer") is None and setup.get("pre_tokenizer") == BYTE_LEVEL and setup["model"]["type"] == "BPE":
                parts: dict = {}
                model = Pieces(path, words=False)
                self.cuts = True

                def sizes(texts: list[str]) -> list[int]:
                    if len(parts) > MEMO_PARTS:
                        parts.clear()
                    return [len(x) // 4 for x in model.encode(texts, parts, MEMO_LENGTH)]

                self.sizes = sizes
            else:
                self.sizes = lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def count(self, texts: Iterable[str]) -> list[int]:
        """Tokens of each text, a slice at a time."""
        out: list[int] = []
        held: list[str] = []
        owner: list[int] = []
        size = 0

        def close() -> None:
            for i, n in zip(owner, self._count(held), strict=True):
                out[i] += n
            held.clear()
            owner.clear()

        for i, text in enumerate(texts):
            out.append(0)
            for part in stretches(text) if self.cuts else (text,):
                held.append(part)
                owner.append(i)
                size += len(part) + 256
                if size > SLICE:
                    close()
                    size = 0
        close()
        return out

    def _count(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return self.sizes(texts) if texts else []
        # a stretch that begins at a cut begins with its space, and so has no other cut there
        split = [CUT.split(t) for t in texts]
        first = {p[0] for p in split}
        rest = set().union(*(p[1:] for p in split))
        if len(self.known) + len(first) + len(rest) > MEMO_PIECES:
            self.known.clear()
        known = self.known
        all_ = first | {" " + x for x in rest}
        new = [x for x in all_ if x not in known]
        long = {}
        for s in range(0, len(new), 4096):
            part = new[s : s + 4096]
            for x, n in zip(part, self.sizes(part), strict=True):
                (known if len(x) <= MEMO_LENGTH else long)[x] = n
        count = lambda x: long[x] if len(x) > MEMO_LENGTH else known[x]
        spaced = {x: count(" " + x) for x in rest}
        return [count(p[0]) + sum(map(spaced.__getitem__, p[1:])) for p in split]


@cache
def counter_of(path: str) -> Counter:
    return Counter(path)


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """digest, text -> digest, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("token counts", counter_of.cache_clear)
        counter = counter_of(path)
        for batch in batches:
            counts = counter.count(x.as_py() for x in batch["text"])
            yield pa.record_batch([batch["digest"], pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def read_cache(spark: SparkSession, cache_dir: str) -> DataFrame:
    """The stored counts; a cache that does not exist yet is empty."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_dir)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_dir: str, limit: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, content digest; the cache grows by the misses."""
    spark, version = docs.sparkSession, version_of(tokenizer_path)
    texts, digest = id_text(docs), F.unhex(F.sha2("text", 256)).alias("digest")
    keyed = written(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest), "token-digests")
    stored = read_cache(spark, cache_dir).filter(F.col("version") == version).select("digest", "n_tokens").dropDuplicates(["digest"])
    # one document of each missing digest; hot digests meet as partial minima, texts move by doc_id only, and
    # with a warm cache hardly any do
    chosen = keyed.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("at")).join(stored, "digest", "left_anti")
    chosen = written(chosen, "token-misses")
    passes = bitmap(chosen.select("at"), "at")
    source = texts.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at"), "text").filter(passes(F.xxhash64("at"))).select("at", digest, "text")
    # the misses grow with the table, so neither side is broadcast
    misses = source.join(chosen.hint("merge"), ["at", "digest"]).dropDuplicates(["at", "digest"]) if has_repeats(keyed) else source.join(chosen.select("at").hint("merge"), "at", "left_semi")
    encode_counts(misses, tokenizer_path).select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_dir)
    counts = read_cache(spark, cache_dir).filter(F.col("version") == version).select("digest", "n_tokens")
    if counts.groupBy("digest").count().filter("count > 1").limit(1).count():  # two runs appended the same
        counts = counts.dropDuplicates(["digest"])
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("digest")).alias("digest"))


def has_repeats(keyed: DataFrame) -> bool:
    """Whether some doc_id (nulls as one) has several rows."""
    return bool(keyed.groupBy("doc_id").count().filter("count > 1").limit(1).count())
