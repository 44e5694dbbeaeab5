"""Workload generators: random transactions as DataFrames."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import uniform
from ..functions.ordered import running_sum
from ..sources.history import from_rows, mop


def register_txns(spark: SparkSession, txns: int, seed: int = 0, key_dist: str = "exponential", base: float = 2.0, key_count: int | None = None, min_length: int = 1, max_length: int = 4, max_writes_per_key: int = 256) -> DataFrame:
    """(index, type, process, mop_idx, f, k, v): random reads and writes.

    Keys are drawn exponentially (each next slot ``base`` times likelier), uniformly or by Zipf from
    ``key_count`` live slots. A slot's key retires after a number of writes that is drawn anew for each key,
    up to ``max_writes_per_key`` and inversely likely to its size, and its k-th write has value k, so values
    are unique for each key. All by hashes of positions: no state, any order.
    """
    slots = key_count or {"exponential": 10, "uniform": 3, "zipf": 10}[key_dist]
    u = lambda *salt: uniform(F.lit(str(seed)), *salt)
    at = lambda salt: u(F.lit(salt), F.col("index").cast("string"), F.col("mop_idx").cast("string"))
    length = (F.lit(min_length) + F.floor(u(F.lit("length"), F.col("index").cast("string")) * (max_length - min_length + 1))).cast("int")
    rows = spark.range(txns).select(F.col("id").alias("index")).withColumn("mop_idx", F.explode(F.sequence(F.lit(0), length - 1)))
    if key_dist == "exponential":
        slot = F.floor(F.log(at("slot") * (base**slots - 1) + 1) / F.log(F.lit(base)))
    elif key_dist == "uniform":
        slot = F.floor(at("slot") * slots)
    else:
        weights = [1 / (i + 1) for i in range(slots)]
        slot, left = F.lit(slots - 1), 1.0
        for i in range(slots - 1, 0, -1):
            left -= weights[i] / sum(weights)
            slot = F.when(at("slot") < left, i - 1).otherwise(slot)
    rows = rows.select("index", "mop_idx", F.least(slot.cast("long"), F.lit(slots - 1).cast("long")).alias("slot"), (at("kind") < 0.5).alias("writes"))
    rows = rows.withColumn("w", F.col("writes").cast("long"))
    # a read is of the key that the next write of its slot goes to
    rows = running_sum(rows, "slot", ["slot", "index", "mop_idx"], "w", "nth").withColumn("place", F.col("nth") - F.col("w"))
    most = rows.groupBy("slot").agg(F.max("place").alias("most"))
    drawn = most.select("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most"))).alias("epoch"))
    size = F.floor(F.pow(F.lit(float(max_writes_per_key + 1)), u(F.lit("writes"), F.col("slot").cast("string"), F.col("epoch").cast("string"))))
    ends = running_sum(drawn.withColumn("size", F.least(F.greatest(size, F.lit(1)), F.lit(max_writes_per_key)).cast("long")), "slot", ["slot", "epoch"], "size", "end")
    begin = F.col("end") - F.col("size")
    places = ends.join(most, "slot").filter(begin <= F.col("most")).select("slot", "epoch", begin.alias("begin"), F.explode(F.sequence(begin, F.col("end") - 1)).alias("place"))
    rows = rows.join(places, ["slot", "place"])
    return rows.select("index", F.lit("invoke").alias("type"), (F.col("index") % 5).alias("process"), "mop_idx", F.when(F.col("writes"), "w").otherwise("r").alias("f"), (F.col("slot") + slots * F.col("epoch")).cast("string").alias("k"), F.when(F.col("writes"), F.col("place") - F.col("begin") + 1).alias("v"))


def list_txns(spark: SparkSession, txns: int, **options) -> DataFrame:
    """The same with appends for writes."""
    return register_txns(spark, txns, **options).withColumn("f", F.when(F.col("f") == "w", "append").otherwise("r"))


def operations(mops: DataFrame) -> DataFrame:
    """Invocations with nested values."""
    value = F.transform(F.sort_array(F.collect_list(F.struct("mop_idx", F.struct("f", "k", "v").alias("m")))), lambda x: x["m"])  # one transaction
    out = mops.groupBy("index", "type", "process").agg(value.alias("short"))
    full = F.transform("short", lambda x: F.struct(x["f"].alias("f"), x["k"].alias("k"), x["v"].alias("v"), F.lit(None).cast("array<bigint>").alias("vs"), F.lit(None).cast("struct<kind:string,a:bigint,b:bigint>").alias("pred"), F.lit(None).cast("map<string,bigint>").alias("seen")))
    return out.select("index", F.lit(0).cast("long").alias("time"), "type", "process", F.lit("txn").alias("f"), full.alias("value"))


def predicate_history(spark: SparkSession, keys: int = 9, txns: int = 30, min_length: int = 1, max_length: int = 4, seed: int = 0) -> DataFrame:
    """A closed universe: init, then one change of each key (k mod 3: insert, w or delete) among reads.

    A transaction has min_length + rand(max_length) micro-operations, which can exceed max_length.
    """
    r = random.Random(seed)
    live = [k for k in range(keys) if k % 3]
    ops = [{"type": "invoke", "f": "init", "value": [mop("init", str(k), 0) for k in live]}]
    changes = [mop("insert", str(k), k) if k % 3 == 0 else mop("w", str(k), k) if k % 3 == 1 else mop("delete", str(k)) for k in range(keys)]
    r.shuffle(changes)
    while changes or len(ops) <= txns:
        value = []
        for _ in range(min_length + r.randrange(max_length)):
            kind = r.random()
            if kind < 0.4 and changes:
                value.append(changes.pop())
            elif kind < 0.7:
                value.append(mop("r", str(r.randrange(keys))))
            else:
                value.append(mop("rp", pred=r.choice([("true",), ("=", r.randrange(keys)), ("mod", 2, r.randrange(2))])))
        ops.append({"type": "invoke", "process": len(ops) % 5, "value": value})
    return from_rows(spark, ops)
