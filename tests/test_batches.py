"""Small groups come to Python in batches, whole and unmixed."""

import pandas as pd

from ledgerlens.operators import graph, search
from ledgerlens.plans import check


def test_groups_of_a_batch():
    pdf = pd.DataFrame({"k": ["b", "a", "b", "c"], "v": [1, 2, 3, 4], "batch": [0, 0, 0, 0]})
    assert list(graph.each_group(pdf, "k")) == [("b", {"v": [1, 3]}), ("a", {"v": [2]}), ("c", {"v": [4]})]
    assert list(graph.each_group(pdf.head(0), "k")) == []


def test_many_components_take_few_calls(spark):
    """Two hundred components: each has its own cycle, and Python is not called for each."""
    rings = [(10 * i + j, 10 * i + (j + 1) % 3, 1) for i in range(200) for j in range(3)]
    edges = spark.createDataFrame(rings, graph.EDGES)
    found = {r["scc"]: (r["size"], r["cycle"]) for r in search.plain_cycles(edges).collect()}
    assert found == {10 * i: (3, [10 * i, 10 * i + 1, 10 * i + 2, 10 * i]) for i in range(200)}
    calls = graph.in_batches(edges.selectExpr("src div 10 as scc", "src", "dst", "rels"), "scc", lambda pdf: pd.DataFrame({"rows": [len(pdf)], "groups": [pdf["scc"].nunique()]}), "rows long, groups long").collect()
    assert len(calls) <= 2 and sum(r["groups"] for r in calls) == 200 and sum(r["rows"] for r in calls) == 600


def test_cycles_of_versions_key_by_key(spark):
    rows = [(str(k), a, b) for k in range(40) for a, b in ((1, 2), (2, 1 if k % 2 else 3))]
    found = check.cyclic_versions(spark.createDataFrame(rows, "k string, v1 long, v2 long")).collect()
    assert sorted((r["k"], r["first"], r["n"], r["vs"]) for r in found) == sorted((str(k), 1, 2, [1, 2]) for k in range(1, 40, 2))
