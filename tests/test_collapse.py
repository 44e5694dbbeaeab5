"""Stretches contracted on their own give what following every path gives."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import graph


def _by_hand(edges, keep):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = set()
    for a in keep:
        todo, seen = [a], set()
        while todo:
            for w in out.get(todo.pop(), ()):
                if w in keep:
                    found.add((a, w))
                elif w not in seen:
                    seen.add(w)
                    todo.append(w)
    return found


@pytest.mark.parametrize("stretch", [1, 40])
def test_stretches(spark, stretch):
    rng = random.Random(stretch)
    edges = sorted({(a, max(0, a + rng.randint(-9, 12))) for a in range(120) for _ in range(2)} | {(50, 51), (51, 50), (3, 3)})
    keep = {v for v in range(140) if rng.random() < 0.4}
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], graph.EDGES)
    got = graph.collapse(df, spark.createDataFrame([(v,) for v in keep], "vertex long"), stretch=stretch).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == _by_hand(edges, keep)


def test_long_ways_take_few_rounds(spark, monkeypatch):
    """A way of thousands of steps is contracted in its stretches: what is left to follow are their ends."""
    monkeypatch.setattr(graph, "_in_bounds", lambda n, rounds: pytest.fail("too many rounds") if n > 12 else None)
    way = spark.range(2000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).alias("rels"))
    keep = spark.createDataFrame([(0,), (700,), (2000,)], "vertex long")
    assert {tuple(r) for r in graph.collapse(way, keep, stretch=250).collect()} == {(0, 700), (700, 2000)}
