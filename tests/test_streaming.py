"""Streaming detectors against their batch forms."""

from pyspark.sql import functions as F

from ledgerlens.operators import detectors
from ledgerlens.streaming import incremental

SCHEMA = "index long, type string, f string, k string, v long, vs array<long>, mop_idx int, time timestamp"


def test_streams_find_what_batches_find(spark, tmp_path):
    rows = [(1, "fail", "append", "x", 1, None, 0), (2, "ok", "r", "x", None, [1, 2], 0), (3, "ok", "append", "x", 2, None, 0), (4, "ok", "r", "x", None, [2, 2], 0), (5, "info", "r", "y", None, [3, 3, 3], 0)]
    batch = spark.createDataFrame(rows, SCHEMA.replace(", time timestamp", "")).withColumn("time", F.timestamp_seconds(F.col("index") * 10))
    batch.write.parquet(str(tmp_path / "in"))

    def run(make, name):
        stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return {tuple(r) for r in spark.table(name).collect()}

    assert run(incremental.aborted_reads, "aborted") == {(r["index"], r.k, r.v, r.writer) for r in detectors.g1a_list(batch).collect()} == {(2, "x", 1, 1)}
    assert run(incremental.repeated_elements, "repeated") == {(4, "x", 1), (5, "y", 2)}
    assert incremental.outcome_rates(batch).agg(F.sum("n")).first()[0] == 5
