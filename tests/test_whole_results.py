"""Results that nothing is left out of."""

import pytest

import __spark_entry__ as entry
from ledgerlens.functions.ordered import pinned
from ledgerlens.operators import graph
from ledgerlens.plans import catalogue

SF = "/root/testdata/sf0.001"


def vertices(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "vertex long")


def test_reachable_is_not_cut(spark):
    pairs = [tuple(x) for x in catalogue._list_edges(spark, SF).select("src", "dst").collect()]
    want = {min(a for a, _ in pairs)}
    while more := {b for a, b in pairs if a in want} - want:
        want |= more
    got = [x.vertex for x in entry.queries()["reachable"](spark, SF).collect()]
    assert set(got) == want and len(got) == len(want) and max(want) >= 2000


def test_long_chains_are_followed_or_reported(spark):
    n = 20
    chain = pinned(graph.from_map(spark, {i: [i + 1] for i in range(n)}).coalesce(1))
    assert {r[0] for r in graph.reachable(chain, vertices(spark, 0)).collect()} == set(range(n + 1))
    assert {tuple(r) for r in graph.collapse(chain, vertices(spark, 0, n)).collect()} == {(0, n)}
    with pytest.raises(RuntimeError):
        graph.reachable(chain, vertices(spark, 0), rounds=3)
    with pytest.raises(RuntimeError):
        graph.collapse(chain, vertices(spark, 0, n), rounds=3)
