"""Projections local to a transaction or to a (key, value) pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WRITES = ("append", "w", "insert", "delete", "init")


def writes(mops: DataFrame) -> DataFrame:
    return mops.filter(F.col("f").isin(*WRITES))


def ext_reads(mops: DataFrame) -> DataFrame:
    """(index, type, k, v): keys that a transaction reads before it does anything else with them."""
    first = mops.filter("k is not null").groupBy("index", "type", "k").agg(F.min_by(F.struct("f", "v"), "mop_idx").alias("m"))
    return first.filter("m.f = 'r'").select("index", "type", "k", F.col("m.v").alias("v"))


def ext_writes(mops: DataFrame) -> DataFrame:
    """(index, type, k, v): the last write of each key."""
    return mops.filter("f = 'w'").groupBy("index", "type", "k").agg(F.max_by("v", "mop_idx").alias("v"))


def ext_state_writes(mops: DataFrame) -> DataFrame:
    """(index, type, k, state, v): last change of each key by insert, w, delete or init; a delete leaves it dead."""
    changes = mops.filter("f in ('insert', 'w', 'delete', 'init')")
    last = changes.groupBy("index", "type", "k").agg(F.max_by(F.struct("f", "v"), "mop_idx").alias("m"))
    dead = F.col("m.f") == "delete"
    return last.select("index", "type", "k", F.when(dead, "dead").otherwise("live").alias("state"), F.when(~dead, F.col("m.v")).alias("v"))


def ext_index(external: DataFrame) -> DataFrame:
    """(k, v, n, first index): how many committed operations touch a version."""
    return external.filter("type = 'ok'").groupBy("k", "v").agg(F.count("*").alias("n"), F.min("index").alias("first_index"))


def ext_keys(mops: DataFrame) -> DataFrame:
    """(index, k): keys an operation touches from outside: reads and writes if ok, writes if info (P5)."""
    reads = ext_reads(mops).filter("type = 'ok'").select("index", "k")
    return reads.union(ext_writes(mops).filter("type in ('ok', 'info')").select("index", "k")).distinct()


def failed_writes(mops: DataFrame) -> DataFrame:
    """(k, v, writer): what aborted transactions wrote."""
    return writes(mops).filter("type = 'fail'").groupBy("k", "v").agg(F.max("index").alias("writer"))


def intermediate_writes(mops: DataFrame) -> DataFrame:
    """(k, v, writer): writes that the same transaction replaced; of all operation types, the latest wins."""
    w = Window.partitionBy("index", "k").orderBy("mop_idx")
    return writes(mops).withColumn("next", F.lead("mop_idx").over(w)).filter("next is not null").groupBy("k", "v").agg(F.max("index").alias("writer"))


def mop_positions(mops: DataFrame) -> DataFrame:
    """(index, f, k, v, mop_idx): the first place of equal micro-operations."""
    return mops.groupBy("index", "f", "k", "v").agg(F.min("mop_idx").alias("mop_idx"))


def element_frequencies(mops: DataFrame) -> DataFrame:
    """(index, mop_idx, k, element, n): how often each element occurs in a read."""
    return mops.filter("f = 'r' and vs is not null").select("index", "mop_idx", "k", F.explode("vs").alias("element")).groupBy("index", "mop_idx", "k", "element").agg(F.count("*").alias("n"))
