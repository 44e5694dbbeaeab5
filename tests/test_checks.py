"""End-to-end checks of small histories with known verdicts."""

import pytest

from ledgerlens.functions.ordered import pinned
from ledgerlens.plans import check
from ledgerlens.sources.history import History, HistoryError, from_rows, mop
from ledgerlens.sources.shorthand import list_txn, pair, register_txn


def history(spark, ops):
    return History.of(pinned(from_rows(spark, ops).coalesce(1)))


def pairs(*ops):
    """Each invocation right before its completion, or all invocations first."""
    return [x for o in ops for x in pair(o)]


def overlapping(*ops):
    both = [pair(o) for o in ops]
    return [b[0] for b in both] + [b[1] for b in both]


def L(text, **kw):
    return list_txn(text, **kw)


LIST = {
    "G0": ([L("ax1ay1"), L("ax2ay2"), L("rx12ry21")], ["read-uncommitted"], {"G0"}, {"read-uncommitted"}),
    "G1a": ([L("ax1", type="fail"), L("rx1")], ["read-committed"], {"G1a", "empty-transaction-graph"}, {"read-committed"}),
    "G1c": ([L("ax1ry1"), L("ax2ay1"), L("rx12ry1")], ["read-committed"], {"G1c"}, {"read-committed"}),
    "G1b": (pairs(L("ax1ax2"), L("rx1")), ["strict-serializable"], {"G1b", "G-single-item"}, {"read-committed"}),
    "G-single": ([L("ax1ay1"), L("ax2ry"), L("rx12")], ["serializable"], {"G-single-item"}, {"consistent-view", "repeatable-read"}),
    "G2": ([L("ax1ry"), L("ay1rx")], ["serializable"], {"G2-item"}, {"repeatable-read"}),
    "strong SI": (pairs(*(L(t, process=i) for i, t in enumerate(["ax1", "ax2", "rx1", "rx12"]))), ["strong-snapshot-isolation"], {"G-single-item-realtime"}, {"strong-snapshot-isolation"}),
    "strong session SI": (pairs(L("ax1", process=0), L("ax2", process=1), L("rx1", process=1), L("rx12", process=2)), ["strong-session-snapshot-isolation"], {"G-single-item-process"}, {"strong-session-snapshot-isolation"}),
    "contradictory": ([L("ax1ry1"), L("ax2"), L("ax3ay1"), L("rx13"), L("rx123")], ["read-committed"], {"G1c", "incompatible-order"}, {"read-committed"}),
    "dirty update": ([L("ax1", type="fail"), L("ax2"), L("rx12")], ["read-committed"], {"G1a", "dirty-update"}, {"read-committed"}),
    "duplicates": ([L("ax1ry1"), L("ax2ay1"), L("rx121")], ["read-committed"], {"G1c", "duplicate-elements"}, {"read-uncommitted"}),
    "internal": ([L("ax1ax2ax4"), L("ax3rx1234")], None, {"internal"}, {"read-uncommitted"}),
    "unobserved": (overlapping(L("ax1ay1", process=0), L("ax2ay2", process=1), L("ax3ay3", process=2), L("rx12", process=3), L("ry2", process=4)), ["serializable"], {"G-single-item", "G0"}, {"read-uncommitted"}),
    "nonadjacent": (overlapping(L("ax1", process=0), L("rx1ry", process=1), L("ay1", process=2), L("ry1rx", process=3)), ["snapshot-isolation"], {"G-nonadjacent-item"}, {"snapshot-isolation", "repeatable-read"}),
    "no nonadjacent": ([L("rx5ay1"), L("ryaz2"), L("rzat3"), L("rtau4"), L("ruax5")], ["snapshot-isolation"], set(), set()),
    "lost update": (overlapping(L("ax0", process=0), L("rx0ax1", process=1), L("rx0ax2", process=2)), ["serializable"], {"G2-item", "lost-update"}, {"update-atomic", "cursor-stability"}),
    "future read": ([L("rx1ax1")], ["read-committed"], {"future-read", "empty-transaction-graph"}, {"read-committed"}),
    "valid": ([L("ax1"), L("rx1ax2"), L("rx12")], ["serializable"], set(), set()),
}


@pytest.mark.parametrize("name", LIST)
def test_list_append(spark, name):
    ops, wanted, types, is_not = LIST[name]
    got = check.check_list_append(history(spark, ops), wanted, () if wanted else ["internal"]).verdict()
    assert set(got.get("anomaly_types", ())) == types
    assert set(got.get("not", ())) == is_not


def test_witness_and_explanation(spark):
    from pyspark.sql import functions as F

    from ledgerlens.operators.explain import explained_steps, rendered

    h = history(spark, [L("ax1ry1"), L("ax2ay1"), L("rx12ry1")])
    result = check.check_list_append(h, ["read-committed"])
    case = result.cycles.filter("type = 'G1c'").first()
    assert case.cycle == [0, 1, 0] and case.steps == ["ww", "wr"]
    cycles = result.cycles.filter("type = 'G1c'").select(F.lit(0).alias("cycle_id"), "cycle")
    steps = explained_steps(cycles, result.facts).orderBy("step").collect()
    assert [(s.src, s.dst, s.k, s.v1, s.v2) for s in steps] == [(0, 1, "x", 1, 2), (1, 0, "y", 1, None)]
    text = rendered(cycles, result.facts, h.ops).first().text
    assert text.splitlines() == [
        "Let:", "  T1 = op 0", "  T2 = op 1", "", "Then:",
        "  - T1 < T2, because T2 appended 2 after T1 appended 1 to x.",
        "  - However, T2 < T1, because T1 saw what T2 wrote: 1 of key y: a contradiction!",
    ]


def test_list_validation(spark):
    with pytest.raises(HistoryError, match="duplicate-appends"):
        check.check_list_append(history(spark, pairs(L("ax1"), L("ax1", process=1))))
    with pytest.raises(HistoryError, match="unexpected-txn-micro-op-types"):
        check.check_list_append(history(spark, [register_txn("wx1")]))


def test_garbage_types_and_orders(spark):
    from ledgerlens.operators import detectors
    from ledgerlens.sources.history import History

    with pytest.raises(HistoryError, match="garbage-elements"):
        check.check_list_append(history(spark, [L("ax1"), L("rx12")]))
    h = history(spark, [L("ax1"), L("ax2"), L("rx12"), L("rx21")])
    with pytest.raises(HistoryError, match="no-total-state-order"):
        detectors.require_total_order(h.mops)
    detectors.require_total_order(h.mops.filter("index <> 3"))
    with pytest.raises(HistoryError, match="unexpected-types"):
        check.check_list_append(History(h.ops, h.mops.withColumn("k", h.mops["index"])))


def test_all_transactions_of_a_lost_update(spark):
    from ledgerlens.operators import detectors

    h = history(spark, overlapping(L("ax0", process=0), *(L(f"rx0ax{i}", process=i) for i in range(1, 6))))
    got = detectors.lost_update_txns(h.mops, "cast(vs as string)").collect()
    assert len(got) == 5 and {x.n for x in got} == {5} and len({x.index for x in got}) == 5


def test_output_folder(spark, tmp_path):
    h = history(spark, [L("ax1ry1"), L("ax2ay1"), L("ax3"), L("rx12ry1"), L("rx13")])
    result = check.check_list_append(h, ["read-committed"])
    result.write(str(tmp_path))
    texts = [p.read_text() for p in tmp_path.glob("cycles/type=*/part-*.txt")]
    assert texts and all(t.startswith("#1\nLet:") and "a contradiction!" in t for t in texts)
    for kind in ("cycle-graphs", "component-graphs"):
        assert any("digraph G" in p.read_text() for p in tmp_path.glob(f"{kind}/*/part-*.txt"))
    assert any("<table>" in p.read_text() for p in tmp_path.glob("incompatible-orders/k=x/page=1/part-*.txt"))


def test_a_step_without_a_reason_is_an_error(spark):
    from ledgerlens.operators.explain import explained_steps

    h = history(spark, [L("ax1ry1"), L("ax2ay1"), L("rx12ry1")])
    result = check.check_list_append(h, ["read-committed"])
    cycles = spark.createDataFrame([(1, [0, 1, 2, 0])], "cycle_id int, cycle array<long>")
    with pytest.raises(Exception, match="nothing explains"):
        explained_steps(cycles, result.facts).collect()


def R(text, **kw):
    return register_txn(text, **kw)


def test_registers(spark):
    run = lambda ops, models=("strict-serializable",), **kw: check.check_rw_register(history(spark, ops), models, **kw).verdict()
    types = lambda v: set(v.get("anomaly_types", ()))
    g0 = run(pairs(R("wx1wy2"), R("wx2wy1", process=1), R("rx2"), R("ry2", process=1)), ["serializable"], sequential_keys=True)
    assert types(g0) == {"G0"}
    assert types(run([R("rx1"), R("wx1", type="fail")], ["read-committed"])) == {"G1a", "empty-transaction-graph"}
    assert types(run([R("wx1wx2"), R("rx1")], ["read-committed"])) == {"G1b", "empty-transaction-graph"}
    assert types(run([R("wx1ry1"), R("wy1rx1")], ["read-committed"])) == {"G1c"}
    assert types(run([R("rx_ry1"), R("wy1wx2")], ["serializable"])) == {"G-single-item"}
    wfr = [R("ry1wx1wy2"), R("rx1ry1")]
    assert run(wfr, ["serializable"]) == {"valid": True}
    assert types(run(wfr, ["serializable"], wfr_keys=True)) == {"G-single-item"}
    assert types(run([R("rx_wx1"), R("rx_wx2")], ["serializable"])) >= {"lost-update"}
    assert "cyclic-versions" in types(run([R("wx1"), R("wx2"), R("rx1")], ["read-uncommitted"], sequential_keys=True))
    order = spark.createDataFrame([(0, 2), (1, 1)], "index long, position long")
    ext = [R("rx_wy2"), R("wx3wy4", process=1)]
    assert run(ext, ["serializable"]) == {"valid": True}
    assert types(run(ext, ["serializable"], transaction_order=order)) == {"G-single-item"}


def P(*mops, **kw):
    return {"type": "ok", "process": 0, "f": "txn", "value": list(mops)} | kw


def test_closed_predicates(spark):
    run = lambda ops, models=("serializable",): check.check_closed_predicate(history(spark, ops), models).verdict()
    types = lambda v: set(v.get("anomaly_types", ()))
    all_ = ("true",)
    seen = [P(mop("insert", "x", 1), mop("rp", pred=all_, seen={"x": 1, "y": 2})), P(mop("insert", "y", 2), mop("rp", pred=all_, seen={"x": 1, "y": 2}))]
    assert types(run(seen)) == {"G1c"}
    unseen = [P(mop("insert", "x", 1), mop("rp", pred=all_, seen={"x": 1})), P(mop("insert", "y", 2), mop("rp", pred=all_, seen={"y": 2}), process=1)]
    assert "G2" in types(run(unseen))
    init = [P(mop("init", "5", 3), f="init"), P(mop("rp", pred=("mod", 2, 1), seen={})), P(mop("rp", pred=("=", 3), seen={}))]
    got = run(init)
    assert "predicate-read-miss" in types(got) and "serializable" in got["not"]
    delete = [P(mop("init", "x", 0), mop("init", "y", 0), f="init"), P(mop("delete", "x"), mop("r", "y")), P(mop("delete", "y"), mop("r", "x"), process=1)]
    assert types(run(delete)) == {"G1c"}
    multi = [P(mop("init", "x", 1), mop("init", "y", 2), f="init"), P(mop("delete", "x"), mop("delete", "y")), P(mop("rp", pred=("true",), seen={"x": 1}), process=1)]
    assert "G-single" in types(run(multi))


def test_predicate_reads_are_explained(spark, tmp_path):
    ops = [P(mop("insert", "x", 2), mop("rp", pred=("mod", 2, 0), seen={"x": 2})), P(mop("insert", "y", 4), mop("rp", pred=("mod", 2, 0), seen={"y": 4}), process=1)]
    result = check.check_closed_predicate(history(spark, ops), ("serializable",))
    result.write(str(tmp_path))
    text = "".join(p.read_text() for p in tmp_path.glob("cycles/*/part-*.txt"))
    assert "the predicate read of" in text and "(value mod 2 = 0)" in text and "met key y" in text and "would change with 4" in text


def test_generic_checker_on_monotonic_keys(spark):
    reads = [{"x": 0, "y": 0}, {"x": 1, "y": 0}, {"x": 1, "y": 1}, {"x": 0, "y": 1}]
    ops = [P(*[mop("r", k, v) for k, v in r.items()], process=i) for i, r in enumerate(reads)]
    h = history(spark, ops)
    result = check.check_graph(h, check.monotonic_analyzer(h.mops.select("index", "k", "v")))
    assert result.verdict() == {"valid": False, "scc_count": 1}
    cycle = result.cycles.first().cycle
    edges = {(f.src, f.dst) for f in result.facts.collect()}
    assert cycle[0] == cycle[-1] and len(set(cycle)) == len(cycle) - 1 > 1 and set(zip(cycle, cycle[1:])) <= edges
    from pyspark.sql import functions as F

    from ledgerlens.operators.explain import rendered

    text = rendered(result.cycles.select(F.lit(1).alias("cycle_id"), "cycle"), result.facts, h.ops, "monotonic").first().text
    assert "observed" in text and "higher value" in text and "appended" not in text
    good = check.check_graph(h, check.process_analyzer)
    assert good.verdict()["valid"] == "unknown"
    ordered = history(spark, ops[:3])
    assert check.check_graph(ordered, check.monotonic_analyzer(ordered.mops.select("index", "k", "v")), check.realtime_analyzer).verdict()["valid"] is True
