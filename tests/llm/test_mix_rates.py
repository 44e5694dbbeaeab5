"""Sources that are repeated more often than one Poisson draw can carry."""

import math
from collections import Counter

from pyspark.sql import functions as F

from ledgerlens.llm import op5_mix as op5


def test_a_source_of_one_row_in_a_large_table(spark):
    n = 4000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") == 5, None).when(F.col("id") == 6, "one").otherwise("big").alias("source"))
    got = op5.mix(docs).select("doc_id", "source", "copy", "mix_key").collect()
    rate = n / 3
    for at in (5, 6):
        copies = sorted(x["copy"] for x in got if x.doc_id == at)
        assert copies == list(range(1, len(copies) + 1)) and abs(len(copies) - rate) < 6 * math.sqrt(rate)
    assert len({x.mix_key for x in got}) == len(got) and Counter(x.source for x in got)["big"] > 0
    again = op5.mix(docs.repartition(5)).select("doc_id", "source", "copy", "mix_key").collect()
    assert again == got


def test_large_rates_have_the_poissons_mean_and_variance(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    n = [c for _, c in op5.mix(docs, epochs=1500.0).groupBy("doc_id").count().collect()]
    mean = sum(n) / len(n)
    assert len(n) == 300 and abs(mean - 1500) < 12 and 1000 < sum((x - mean) ** 2 for x in n) / len(n) < 2100


def test_the_sql_draws_large_rates_the_same(spark):
    import duckdb

    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") == 6, "one").otherwise("big").alias("source"), F.lit(1).alias("n_chars"))
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = sorted(con.sql(f"SELECT doc_id, copy, mix_key FROM ({op5.MIX_SQL})").fetchall())
    got = sorted(map(tuple, op5.mix(docs).select("doc_id", "copy", "mix_key").collect()))
    assert got == want and sum(d == 6 for d, _, _ in got) > 600
