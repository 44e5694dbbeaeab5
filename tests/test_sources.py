"""Histories from files and text, real-time order, rendering, generators, and the catalogue against DuckDB."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import expressions as ex
from ledgerlens.functions import models
from ledgerlens.functions.ordered import running_max
from ledgerlens.operators import edges, generators, render, versions
from ledgerlens.plans import catalogue, check
from ledgerlens.sources import edn, history
from ledgerlens.sources.shorthand import list_txn

EDN = """; two clients
{:index 10, :time 0, :type :invoke, :process 2, :f :txn, :value [[:append 9 2] [:r [:anti 1] nil]]}
{:index 11 :time 5 :type :ok :process 2 :f :txn :value [[:append 9 2] [:r [:anti 1] [1 2]]]}
{:index 12 :type :info :process :nemesis :f :start :value nil}
{:index 13 :type :ok :process 1 :f :txn :value [[:rp [:mod 2 1] {:x 3}] [:rp :true {}] [:delete :y]]}
"""


def test_edn(spark, tmp_path):
    (tmp_path / "h.edn").write_text(EDN)
    ops = edn.read_edn(spark, str(tmp_path / "h.edn"))
    h = history.History.of(ops).clients()
    assert [r["index"] for r in h.ops.orderBy("index").collect()] == [10, 11, 13]
    mops = {(r["index"], r.mop_idx): r for r in h.mops.collect()}
    assert mops[11, 1].vs == [1, 2] and mops[11, 1].k == "[anti 1]" and mops[10, 1].vs is None
    assert mops[13, 0].pred.kind == "mod" and mops[13, 0].seen == {"x": 3} and mops[13, 1].pred.kind == "true"
    with pytest.raises(ValueError):
        list(edn.parse("{:a [1 2}"))
    history.check_schema(ops)
    with pytest.raises(history.HistoryError):
        history.check_schema(ops.withColumn("index", F.col("index").cast("string")))
    assert history.mixed_key_types(h.mops.filter("k is not null")).count() == 1
    ops.write.parquet(str(tmp_path / "p"))
    ops.write.json(str(tmp_path / "j"))
    assert history.read_parquet(spark, str(tmp_path / "p")).count() == history.read_json(spark, str(tmp_path / "j")).count() == 4


def brute_realtime(ops):
    """(type, process) events in order -> edges between completion positions."""
    spans, open_ = [], {}
    for i, (kind, p) in enumerate(ops):
        if kind == "invoke":
            open_[p] = i
        else:
            spans.append((open_.pop(p), i, kind))
    oks = [s for s in spans if s[2] == "ok"]
    return {(a[1], b[1]) for a in oks for b in spans if a[1] < b[0] and not any(a[1] < c[0] and c[1] < b[0] for c in oks)}


def test_realtime_order(spark):
    r = random.Random(1)
    ops, busy = [], set()
    for _ in range(160):
        p = r.randrange(6)
        if p in busy:
            ops.append((r.choice(["ok", "ok", "ok", "fail", "info"]), p))
            busy.discard(p)
        else:
            ops.append(("invoke", p))
            busy.add(p)
    df = spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate(ops)], "index long, type string, process long")
    got = {(x.src, x.dst) for x in edges.realtime_facts(history.pair_index(df)).collect()}
    assert got == brute_realtime(ops)
    assert edges.realtime_facts(history.pair_index(df.limit(0))).count() == 0
    rows = history.pair_index(df).filter("comp is not null").withColumn("k", F.lit("x"))
    assert {(x.a_comp, x.b_comp) for x in versions.reduced_order(rows, ["k"]).collect()} == got


def test_running_max(spark):
    r = random.Random(2)
    data = [(i, r.randrange(1000)) for i in r.sample(range(500), 200)]
    df = spark.createDataFrame(data, "at long, v long").repartition(3)
    best, want, before = None, {}, {}
    for at, v in sorted(data):
        before[at] = best
        best = v if best is None else max(best, v)
        want[at] = best
    assert {x["at"]: x.m for x in running_max(df, ["at"], "v", "m").collect()} == want
    assert {x["at"]: x.m for x in running_max(df, ["at"], "v", "m", strictly_before=True).collect()} == before


def test_expressions(spark):
    df = spark.createDataFrame([([1, 2], [1, 2, 3]), ([2], [1, 2]), ([], [1])], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(ex.is_prefix(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    p = spark.createDataFrame([("mod", 2, 1, "live", -3), ("mod", 2, 1, "dead", None), ("=", 3, None, "live", 3), ("true", None, None, "unborn", None), ("true", None, None, "live", None)], "kind string, a long, b long, state string, v long")
    assert [r[0] for r in p.select(ex.matches(F.col("kind"), F.col("a"), F.col("b"), F.col("state"), F.col("v"))).collect()] == [True, False, True, False, True]
    assert spark.range(1).select(ex.relation_names(F.lit(5)), ex.html_escaped(F.lit('<a&"'))).first()[:] == ("ww,rw", "&lt;a&amp;&quot;")


def test_rendering(spark, tmp_path):
    ops = history.from_rows(spark, [list_txn("ax1ry1"), list_txn("ax2ay1"), list_txn("rx12ry1"), list_txn("rx2")]).coalesce(1)
    h = history.History.of(ops)
    result = check.check_list_append(h, ["read-committed"])
    from ledgerlens.operators import graph

    pairs = edges.edge_union(result.facts)
    dot = render.dots(graph.component_edges(pairs, graph.components(pairs)), h.mops).first().dot
    assert dot.startswith("digraph") and 'T0 -> T1 [label="ww"' in dot and "append x 1 | r y [1]" in dot
    assert render.dots(graph.component_edges(pairs, graph.components(pairs)), h.mops, limit=10).count() == 0
    page = render.incompatible_pages(result.anomalies["incompatible-order"], h.mops).first()
    assert page.k == "x" and page.html.count("<tr>") == 2
    assert render.save(result.cycles.select("type", F.lit("text").alias("text")), "type", "text", str(tmp_path / "out"), "txt") >= 1
    render.write_cycles(spark.createDataFrame([("G0", "b"), ("G0", "a"), ("G1c", "c")], "type string, text string"), str(tmp_path / "cycles"))
    assert "#1\na" in spark.read.text(str(tmp_path / "cycles"), wholetext=True).filter("type = 'G0'").first().value
    assert '"serializable"' in render.lattice_dot(models.MODELS)


def test_generators(spark):
    for dist in ("exponential", "uniform", "zipf"):
        rows = generators.register_txns(spark, 500, seed=53, key_dist=dist, max_writes_per_key=20)
        assert rows.filter("f = 'w'").groupBy("k", "v").count().filter("count > 1").count() == 0
        assert rows.filter("f = 'w'").groupBy("k").count().agg(F.max("count")).first()[0] <= 20
        assert rows.groupBy("index").count().agg(F.min("count"), F.max("count")).first()[:] == (1, 4)
    ops = generators.operations(generators.list_txns(spark, 20, seed=1))
    assert ops.count() == 20 and {m.f for r in ops.collect() for m in r.value} <= {"append", "r"}
    pred = history.History.of(generators.predicate_history(spark, seed=4)).mops
    changed = pred.filter("f in ('insert', 'w', 'delete')").groupBy("k").count()
    assert changed.count() == 9 and changed.filter("count > 1").count() == 0


def test_catalogue_against_duckdb(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "conversations"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("explode_mops", "ext_reads", "g1a_list", "dirty_update", "incompatible_order", "edge_union", "realtime_edges", "linearizable_versions", "scc_members", "pred_vset", "pred_rwp", "monotonic_edges", "impossible_models", "boundary"):
        got = catalogue.queries()[name](spark, d)
        want = con.sql(catalogue.oracle_sql()[name])
        cols = sorted(want.columns)
        order = [want.columns.index(c) for c in cols]
        assert sorted(got.columns) == cols
        assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, (tuple(r[i] for i in order) for r in want.fetchall()))), name
