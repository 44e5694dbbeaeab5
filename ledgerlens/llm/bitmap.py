"""Bitmaps of keys: a Bloom filter of bounded size, sent to the tasks, that keeps rows without a partner from moving."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 26  # 8 MB
SHIFTS = (0, 17, 37)


def bitmap(keys: DataFrame, column: str):
    """A column function over xxhash64(key): false only for keys that ``column`` of ``keys`` does not have.

    16 bits a key, MOST_BITS at most: beyond some millions of keys more rows pass that have no partner, and
    in the end all of them do, as they would without a bitmap. Nothing but speed depends on it.
    """
    spark, bits = keys.sparkSession, 1 << 16
    n = keys.count()
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    h = F.xxhash64(column)
    places = F.explode(F.array(*[F.shiftright(h, s).bitwiseAND(F.lit(bits - 1)) for s in SHIFTS]))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    words = keys.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(bit).alias("x"))
    table = np.zeros(bits // 64, np.int64)
    for batch in words.toArrow().to_batches():  # a row for each 64 bits at most
        table[batch["word"].to_numpy()] = batch["x"].to_numpy()
    sent = spark.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def passes(hashes: pa.Array) -> pa.Array:
        h, held, out = hashes.to_numpy(zero_copy_only=False), sent.value, True
        for shift in SHIFTS:
            p = (h >> shift) & (bits - 1)
            out = out & ((held[p >> 6] >> (p & 63)) & 1).astype(bool)
        return pa.array(out)

    return passes
