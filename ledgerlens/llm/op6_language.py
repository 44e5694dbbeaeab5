"""Language ID with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from a hash of the seed and its code point, so that every
letter of every script has its own. A trigram binds its letters: the first rotated twice, the second once,
the third as it is, multiplied. A document bundles (adds) its trigrams' vectors, a language bundles the
documents it learned from, each scaled to length one. The language with the highest cosine wins; ties go to
the first name. The vectors depend on ``seed`` alone.

Letters are lower-cased; everything else separates words (and takes part in trigrams as one sign). Learning
reads the documents with crc32(doc_id as text) mod 3 other than 1 and a language, about ``per_lang`` of each
language, chosen by a hash of doc_id: one row of ``dimensions`` sums for each language goes to the driver.

A null text, or one without letters, is ``und`` with score 0, as is everything if nothing was learned. A
null doc_id is not held out and teaches nothing. Rows that share a doc_id give one row each. Long texts are
taken in pieces of PIECE characters. Other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, positional, turn

UNKNOWN = "und"
DIMENSIONS = 1024
PER_LANG = 3000
SEED = 20
NOISE, ENOUGH = 3.0, 40
PIECE, SLICE = 1 << 19, 256  # characters and texts at once
WIDTH = 21  # bits of a code point


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_vectors(points: np.ndarray, seed: int, dimensions: int) -> np.ndarray:
    """A row of +1 and -1 for each code point (0: no letter); 64 of them from each hash."""
    words = -(-dimensions // 64)
    h = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(words, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return bits[:, :dimensions].astype(np.int8) * np.int8(2) - np.int8(1)


def trigram_vectors(trigrams: np.ndarray, seed: int, dimensions: int) -> np.ndarray:
    parts = np.stack([trigrams >> 2 * WIDTH, trigrams >> WIDTH & (1 << WIDTH) - 1, trigrams & (1 << WIDTH) - 1])
    points, at = np.unique(parts, return_inverse=True)
    v = letter_vectors(points, seed, dimensions)
    first, second, third = at.reshape(3, -1)
    return np.roll(v, 2, axis=1)[first] * np.roll(v, 1, axis=1)[second] * v[third]


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(texts, pieces) of PIECE characters or so together; a piece has the sign before and after it at its ends."""
    owner: list[int] = []
    part: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        t = t.lower()
        for s in range(0, len(t), PIECE):
            owner.append(i)
            part.append((t[s - 1] if s else " ") + t[s : s + PIECE] + (t[s + PIECE] if s + PIECE < len(t) else " "))
            size += len(part[-1])
            if size >= PIECE:
                yield owner, part
                owner, part, size = [], [], 0
    if owner:
        yield owner, part


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram, count) in order of text, and whether each text has letters.

    A trigram is three code points in one number, 0 for what is no letter; the middle one is a letter. A
    text of several pieces may have a trigram more than once.
    """
    out = []
    has = np.zeros(len(texts), bool)
    for owner, part in _pieces(texts):
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(letters()[points], points, 0)
        met = np.zeros(0x110000, bool)
        met[points] = True
        met[0] = True
        present = np.flatnonzero(met)
        short = np.zeros(0x110000, np.int32)
        short[present] = np.arange(len(present))
        codes, bits = short[points].astype(np.int64), max(1, int(len(present) - 1).bit_length())
        sizes = np.array([len(p) for p in part])
        inner = codes > 0
        inner[np.cumsum(sizes) - 1] = inner[np.cumsum(sizes) - sizes] = False
        middle = np.flatnonzero(inner)
        key = np.sort(np.repeat(owner, sizes)[middle] << 3 * bits | codes[middle - 1] << 2 * bits | codes[middle] << bits | codes[middle + 1])
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        own, low = key[first], (1 << bits) - 1
        has[np.unique(own >> 3 * bits)] = True
        tri = present[own >> 2 * bits & low] << 2 * WIDTH | present[own >> bits & low] << WIDTH | present[own & low]
        out.append((own >> 3 * bits, tri, np.diff(np.concatenate((first, [len(key)])))))
    doc, tri, n = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return doc, tri, n, has


class Profiles:
    """Bundles documents; holds the vectors of the trigrams met."""

    LIMIT, STEP = 20_000, 4096

    def __init__(self, seed: int, dimensions: int) -> None:
        self.seed, self.dimensions = seed, dimensions
        self.vectors = np.zeros((self.LIMIT, dimensions), np.int8)
        self.forget()

    def forget(self) -> None:
        self.keys = self.place = np.zeros(0, np.int64)

    def rows(self, trigrams: np.ndarray) -> np.ndarray:
        """The rows of distinct trigrams, at most STEP of them."""
        at = np.searchsorted(self.keys, trigrams)
        if len(self.keys):
            near = np.minimum(at, len(self.keys) - 1)
            new = trigrams[self.keys[near] != trigrams]
        else:
            new = trigrams
        if len(new):
            if len(self.keys) + len(new) > self.LIMIT:
                self.forget()
                return self.rows(trigrams)
            to = len(self.keys) + np.arange(len(new))
            self.vectors[to] = trigram_vectors(new, self.seed, self.dimensions)
            keys, place = np.concatenate((self.keys, new)), np.concatenate((self.place, to))
            order = np.argsort(keys, kind="stable")
            self.keys, self.place = keys[order], place[order]
            at = np.searchsorted(self.keys, trigrams)
        return self.place[at]

    def bundle(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the texts scaled to length one, and whether they have letters."""
        doc, tri, n, has = trigram_counts(texts)
        out = np.zeros((len(texts), self.dimensions), np.float64)
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        for i in np.flatnonzero(has).tolist():
            for s in range(cut[i], cut[i + 1], self.STEP):
                e = min(s + self.STEP, cut[i + 1])
                own, many = tri[s:e], n[s:e]
                if (own[1:] <= own[:-1]).any():  # the end of one piece and the start of the next
                    own, at = np.unique(own, return_inverse=True)
                    many = np.bincount(at, many)
                out[i] += many.astype(np.float32) @ self.vectors[self.rows(own)].astype(np.float32)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1)).astype(np.float32), has


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prototypes: np.ndarray  # rows of length one
    seed: int
    dimensions: int

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        langs: list[str] = []
        scores: list[float] = []
        for s in range(0, len(texts), SLICE):
            a, b = self._predict([t or "" for t in texts[s : s + SLICE].to_pylist()])
            langs += a
            scores += b
        return langs, scores

    def _predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        vectors, has = _profiles(self.seed, self.dimensions).bundle(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        cosine = vectors @ self.prototypes.T
        best = cosine.argmax(axis=1)
        top = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(float)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, top, 0.0).tolist()


@cache
def _profiles(seed: int, dimensions: int) -> Profiles:
    return Profiles(seed, dimensions)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def learn(docs: DataFrame, per_lang: int = PER_LANG, seed: int = SEED, dimensions: int = DIMENSIONS) -> Model:
    """Learn from ``docs`` (doc_id, text, lang): bounded to about ``per_lang`` documents of each language."""
    id_ = F.col("doc_id").cast("long")
    rows = docs.select(id_.alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter((remainder(id_) != 1) & F.col("lang").isNotNull())
    counts = dict(rows.groupBy("lang").count().collect())
    languages = tuple(sorted(counts))
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / counts[lang]))).otherwise(share)
    chosen = rows.filter((F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < share * float(1 << 30)) & F.col("text").isNotNull())
    place = {lang: i for i, lang in enumerate(languages)}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("language", _profiles.cache_clear)
        sums = {}
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE):
                part = batch.slice(s, SLICE)
                vectors, has = _profiles(seed, dimensions).bundle(part["text"].to_pylist())
                for lang, v, h in zip(part["lang"].to_pylist(), vectors, has, strict=True):
                    if not h:
                        continue
                    sums[lang] = sums.get(lang, 0) + np.rint(v.astype(np.float64) * (1 << 24)).astype(np.int64)  # whole numbers: the sum has no order
        for lang, v in sums.items():
            yield pa.record_batch([pa.array(np.full(dimensions, place[lang]), pa.int64()), pa.array(np.arange(dimensions), pa.int64()), pa.array(v, pa.int64())], ["lang", "i", "x"])

    prototypes = np.zeros((len(languages), dimensions))
    for row in chosen.select("text", "lang").mapInArrow(partial, "lang long, i long, x long").groupBy("lang", "i").agg(F.sum("x").alias("x")).toLocalIterator():
        prototypes[row.lang, row.i] = row.x
    size = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return Model(languages, (prototypes / np.where(size > 0, size, 1)).astype(np.float32), seed, dimensions)


def predictor(model: Model):
    """A column function: text -> struct<lang string, score double>."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        turn("language", _profiles.cache_clear)
        langs, scores = model.predict(texts)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predict


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = model or learn(docs)
    out = id_text(docs).select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), predictor(model)("text").alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep(docs: DataFrame, model: Model | None = None, languages: Collection[str] | None = None, noise: float = NOISE, letters_needed: int = ENOUGH) -> DataFrame:
    """The rows and columns of ``docs`` in a recognised language, one of ``languages`` if these are given.

    Without letters no language is recognised. The cosine of unrelated vectors has a standard deviation of
    1 / sqrt(dimensions), so a text of ``letters_needed`` letters or more that is no nearer to any prototype
    than ``noise`` of these is in none of the learned languages. Shorter texts get the benefit of the doubt.
    """
    model = model or learn(docs)
    rows, at = positional(docs)
    text = F.col(at["text"]).cast("string")
    marked = rows.select("*", predictor(model)(text).alias("p"))
    good = F.col("p.lang") != UNKNOWN
    if model.languages:
        strange = (F.col("p.score") < noise / math.sqrt(model.dimensions)) & (F.char_length(text) >= letters_needed) & (F.char_length(F.regexp_replace(text, r"\P{L}", "")) >= letters_needed)
        good &= ~strange
    if languages is not None:
        good &= F.col("p.lang").isin(*languages)
    return marked.filter(good).drop("p").toDF(*docs.columns)
