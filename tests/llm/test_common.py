"""Helpers of the text operators."""

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import common
from ledgerlens.llm.bitmap import bitmap


def test_one_operator_remembers_at_a_time():
    gone = []
    common.turn("a", lambda: gone.append("a"))
    common.turn("a", lambda: gone.append("a again"))
    assert gone == []
    common.turn("b")
    common.turn("c", lambda: gone.append("c"))
    common.turn("a", lambda: gone.append("a"))
    assert gone == ["a", "c"]
    common.turn("none")


def test_batches_are_smaller_unless_the_session_says_so(spark):
    before = spark.conf.get(common.BATCH_ROWS)
    try:
        spark.conf.set(common.BATCH_ROWS, "10000")
        common.small_batches(spark)
        assert spark.conf.get(common.BATCH_ROWS) == "1000"
        spark.conf.set(common.BATCH_ROWS, "77")
        common.small_batches(spark)
        assert spark.conf.get(common.BATCH_ROWS) == "77"
    finally:
        spark.conf.set(common.BATCH_ROWS, before)


def test_bitmaps_keep_what_they_must(spark, monkeypatch):
    keys = spark.range(0, 4000, 7).select(F.when(F.col("id") != 14, F.col("id")).alias("k"))  # one null
    all_ = spark.range(4000).select(F.when(F.col("id") != 14, F.col("id")).alias("k"))
    for most in (1 << 26, 1 << 16):
        monkeypatch.setattr("ledgerlens.llm.bitmap.MOST_BITS", most)
        passes = bitmap(keys, "k")
        got = {x.k for x in all_.filter(passes(F.xxhash64("k"))).collect()}
        assert got >= {None, *(set(range(0, 4000, 7)) - {14})} and len(got) < 1200
    none = bitmap(keys.limit(0), "k")
    assert all_.filter(none(F.xxhash64("k"))).count() == 0


def test_positional_names(spark):
    df = spark.createDataFrame([(1, "x", np.int64(2).item())], "doc_id long, text string, c0 long")
    rows, at = common.positional(df)
    assert rows.columns == ["c0", "c1", "c2"] and at == {"doc_id": "c0", "text": "c1", "c0": "c2"}
