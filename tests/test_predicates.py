"""Predicate reads against unseen keys: every pair, whoever makes it, and no task that makes them all."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import detectors, edges, predicates, versions

SCHEMA = "index long, type string, process long, mop_idx int, f string, k string, v long, pred struct<kind:string,a:long,b:long>, seen map<string,long>"


def _mops(spark, readers=60, keys=40):
    """Keys with one even version each, which every reader misses but for one of them; a deleted key each reader after it depends on."""
    even = ("mod", 2, 0)
    rows = [(0, "ok", 0, i, "init", str(i), 2 * i, None, None) for i in range(keys)]
    rows += [(1, "ok", 0, 0, "delete", "3", None, None, None)]
    rows += [(10 + i, "ok", 0, 0, "rp", None, None, even, {str(i % keys): 2 * (i % keys)}) for i in range(readers)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


@pytest.mark.parametrize("few", [0, 1000])
@pytest.mark.parametrize("block", [4, 2048])
def test_every_unseen_pair(spark, monkeypatch, few, block):
    monkeypatch.setattr(predicates, "BLOCK", block)
    reads = spark.createDataFrame([(i, 0, {"kind": "=", "a": i % 2, "b": None} if i % 3 else None, [str(j) for j in range(i % 5)]) for i in range(30)], "index long, mop_idx int, pred struct<kind:string,a:long,b:long>, names array<string>")
    rows = spark.createDataFrame([({"kind": "=", "a": p, "b": None} if p < 2 else None, str(k), 10 * k) for p in range(3) for k in range(9)], "pred struct<kind:string,a:long,b:long>, k string, v long")
    got = sorted((r["index"], r.k, r.v) for r in predicates.unseen(reads, rows, few).collect())
    assert got == sorted((i, str(k), 10 * k) for i in range(30) for k in range(9) if k >= i % 5)


def test_one_predicate_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(predicates, "CELL", 300)
    mops = _mops(spark)
    states = versions.state_versions(mops)
    tasks = lambda rows: rows.select(F.spark_partition_id()).distinct().count()
    assert tasks(detectors.predicate_read_miss(mops, states)) > 4
    sets = edges.predicate_sets(mops, states)
    mops = mops.filter("f <> 'rp'").unionByName(mops.filter("f = 'rp'").withColumn("seen", F.expr("cast(map() as map<string, bigint>)")))
    assert detectors.predicate_read_miss(mops, states).count() == 60 * 39
    assert sorted((r["index"], r.k) for r in sets.rows().filter("k = '3'").collect()) == sorted((10 + i, "3") for i in range(60))


def test_pairs_are_never_shuffled(spark):
    """What reads meet is as large as versions and predicates; joins of it with versions come before reads."""
    mops = _mops(spark)
    states = versions.state_versions(mops)
    sets = edges.predicate_sets(mops, states)
    for facts in (edges.predicate_wrp(states, sets), edges.predicate_rwp(states, sets)):
        plan = facts._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Join" in line or "Aggregate" in line for line in plan[: plan.index("Generate inline")].splitlines()[-4:])
    assert edges.predicate_wrp(states, sets).filter("src = 1").count() == 58
