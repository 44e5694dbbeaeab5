"""Graph operators and the cycle search against brute force."""

import itertools
import random

import pytest

from ledgerlens.functions import models
from ledgerlens.functions import relations as rel
from ledgerlens.operators import graph, search

B = rel.BITS


def edges_of(spark, triples):
    return spark.createDataFrame([(a, b, r) for a, b, r in triples], graph.EDGES).coalesce(1)


def rows(df):
    return {tuple(r) for r in df.collect()}


def brute_components(pairs):
    reach = {v: {v} for p in pairs for v in p}
    for _ in reach:
        for a, b in pairs:
            for v in reach:
                if a in reach[v]:
                    reach[v] |= reach[b]
    return {(v, min(w for w in reach if v in reach[w] and w in reach[v])) for v in reach if sum(v in reach[w] and w in reach[v] for w in reach) > 1}


def test_components_three_ways(spark):
    r = random.Random(7)
    pairs = {(a, b) for _ in range(70) if (a := r.randrange(60)) != (b := min(59, max(0, a + r.choice([1, 2, 3, 5, -1, -4]))))}
    df = edges_of(spark, [(a, b, 1) for a, b in pairs])
    want = brute_components(pairs)
    assert {(v, p[0]) for p in graph.tarjan(pairs) if len(p) > 1 for v in p} == want
    assert rows(graph.components(df)) == want
    assert rows(graph.components(df, island_edges=1)) == want
    assert rows(graph.coloured(df)) == want
    assert rows(graph.components(edges_of(spark, [(1, 2, 1), (2, 3, 1)]))) == set()


@pytest.mark.parametrize("shape", ["ring", "rings with a tail", "two rings that meet", "random"])
def test_components_of_chains(spark, shape):
    r = random.Random(8)
    ring = lambda *vs: list(zip(vs, [*vs[1:], vs[0]]))
    pairs = {
        "ring": ring(*range(40)),
        "rings with a tail": ring(*range(9)) + ring(20, 22, 21) + [(8, 30), (30, 31), (31, 32), (32, 20), (40, 41)],
        "two rings that meet": ring(5, 6, 7, 0, 8) + ring(0, 1, 2, 3) + ring(10, 11),
        "random": [(a, b) for _ in range(90) if (a := r.randrange(70)) != (b := r.randrange(70))],
    }[shape]
    assert rows(graph.coloured(edges_of(spark, [(a, b, 1) for a, b in pairs]))) == brute_components(set(pairs))


def test_link_variants(spark):
    none = edges_of(spark, [(1, 2, 1)])
    some = spark.createDataFrame([(3,), (4,)], "vertex long")
    assert rows(graph.link_to_all(none, 9, some, 2)) == {(1, 2, 1), (9, 3, 2), (9, 4, 2)}
    assert rows(graph.link_all_to(none, some, 9, 2)) == {(1, 2, 1), (3, 9, 2), (4, 9, 2)}
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 7)], "k string, src long")
    b = spark.createDataFrame([("x", 3), ("y", 8), ("z", 9)], "k string, dst long")
    assert rows(graph.link_all_to_all(none, a, b, ["k"], 4)) == {(1, 2, 1), (1, 3, 4), (2, 3, 4), (7, 8, 4)}
    assert graph.to_map(graph.link_to_all(none, 9, some)) == {1: [2], 9: [3, 4]}
    with pytest.raises(ValueError):
        graph.to_map(graph.link_to_all(none, 9, some), most=2)


def test_algebra(spark):
    a = edges_of(spark, [(1, 2, 1), (2, 3, 2), (2, 2, 4)])
    assert rows(graph.composition(a, edges_of(spark, [(2, 9, 1), (3, 1, 1)]))) == {(1, 9, 0), (2, 1, 0), (2, 9, 0)}
    assert rows(graph.extension(a, edges_of(spark, [(3, 1, 1)]))) == {(1, 2, 1), (2, 3, 2), (2, 2, 4), (2, 1, 0)}
    assert rows(graph.without_self_edges(a)) == {(1, 2, 1), (2, 3, 2)}
    assert rows(graph.union(a, edges_of(spark, [(1, 2, 4)]))) == {(1, 2, 5), (2, 3, 2), (2, 2, 4)}
    assert rows(graph.project(a, 3)) == {(1, 2, 1), (2, 3, 2)}
    assert rows(graph.unlink(a, edges_of(spark, [(2, 2, 0)]))) == {(1, 2, 1), (2, 3, 2)}
    keep = spark.createDataFrame([(1,), (2,)], "vertex long")
    assert rows(graph.induced(a, keep).select("src", "dst", "rels")) == {(1, 2, 1), (2, 2, 4)}
    assert rows(graph.map_vertices(a, spark.createDataFrame([(3, 2)], "vertex long, to long"))) == {(1, 2, 1), (2, 2, 6)}
    assert rows(graph.from_map(spark, {1: [2, 3]})) == {(1, 2, 0), (1, 3, 0)}
    chain = edges_of(spark, [(1, 2, 1), (2, 3, 1), (3, 4, 1), (5, 1, 1)])
    assert {r[0] for r in rows(graph.reachable(chain, spark.createDataFrame([(2,)], "vertex long")))} == {2, 3, 4}
    assert rows(graph.collapse(chain, spark.createDataFrame([(5,), (4,), (1,)], "vertex long"))) == {(5, 1), (1, 4)}


def find(name, triples):
    g = search.graph_of((a, b, rel.mask(*r.split())) for a, b, r in triples)
    return search.Search(g, timeout_s=30).find(search.SPECS[name])


@pytest.mark.parametrize(
    ("name", "triples", "cycle"),
    [
        ("G0", [(0, 1, "ww"), (1, 0, "ww")], {0, 1}),
        ("G0", [(0, 1, "ww"), (1, 0, "wr")], None),
        ("G1c", [(0, 1, "ww"), (1, 2, "wr"), (2, 0, "ww")], {0, 1, 2}),
        ("G1c", [(0, 1, "ww"), (1, 0, "ww")], None),
        ("G-single-item", [(0, 1, "rw"), (1, 0, "ww")], {0, 1}),
        ("G-single-item", [(0, 1, "rw"), (1, 0, "rw")], None),
        ("G-nonadjacent-item", [(0, 1, "rw"), (1, 2, "ww"), (2, 3, "rw"), (3, 0, "wr")], {0, 1, 2, 3}),
        ("G-nonadjacent-item", [(0, 1, "rw"), (1, 2, "rw"), (2, 0, "wr")], None),
        ("G2-item", [(0, 1, "rw"), (1, 2, "rw"), (2, 0, "wr")], {0, 1, 2}),
        ("G2", [(0, 1, "rwp"), (1, 0, "rw")], {0, 1}),
        ("G0-process", [(0, 1, "ww"), (1, 0, "process")], {0, 1}),
        ("G1c-realtime", [(0, 1, "wr"), (1, 0, "realtime")], {0, 1}),
        # two loops that share a vertex: no simple cycle has both a wr and a realtime edge
        ("G1c-realtime", [(0, 1, "wr"), (1, 0, "ww"), (0, 2, "realtime"), (2, 0, "ww")], None),
        # one edge counts as one of its relations
        ("G1c-realtime", [(0, 1, "realtime wr"), (1, 0, "ww")], None),
    ],
)
def test_specs(name, triples, cycle):
    got = find(name, triples)
    assert (set(got) if got else None) == cycle


def brute_cycles(g):
    out = []

    def go(path):
        for w in g[path[-1]]:
            if w == path[0]:
                out.append([*path, w])
            elif w not in path and w > path[0]:
                go([*path, w])

    for v in g:
        go([v])
    return out


def fits(spec, g, cycle):
    """Whether some choice of one relation for each edge satisfies the spec."""
    options = [[b for b in B.values() if g[a][c] & b & (spec.legal | spec.rw)] for a, c in zip(cycle, cycle[1:])]
    for steps in itertools.product(*options):
        rws = [bool(s & spec.rw) for s in steps]
        n = sum(rws)
        if spec.mode is None and n or spec.mode == search.ONE and n != 1 or spec.mode in (search.APART, search.TWO) and n < 2:
            continue
        if spec.mode == search.APART and any(a and b for a, b in zip(rws, [*rws[1:], rws[0]])):
            continue
        if all(any(s & w for s in steps) for w in spec.wants):
            return True
    return False


def test_search_finds_what_brute_force_finds():
    r = random.Random(3)
    for _ in range(150):
        n = r.randint(2, 5)
        triples = [(a, b, 1 << r.randrange(8) | (1 << r.randrange(8) if r.random() < 0.3 else 0)) for a in range(n) for b in range(n) if a != b and r.random() < 0.5]
        g = search.graph_of(triples)
        s = search.Search(g, timeout_s=60)
        all_cycles = brute_cycles(g)
        for name, spec in search.SPECS.items():
            want = [c for c in all_cycles if fits(spec, g, c) and s.fits(spec, c)]
            got = s.find(spec)
            assert bool(got) == bool(want), (name, triples)
            if got:
                assert fits(spec, g, search.canonical_cycle(got))


def test_existence():
    g = search.graph_of([(0, 1, B["ww"]), (1, 0, B["rw"])])
    assert [(m, p) for m, p in search.existence_cases(g)][:2] == [("PL-SI", [0]), ("PL-2.99", [0, 1])]
    found = search.Search(g).all()
    assert [t for t, _, _ in found] == ["G-single-item"]


def composed(a, b):
    return {x: {z: 0 for y in ys for z in b.get(y, ())} for x, ys in a.items()}


def test_the_doubled_graph_stands_for_the_extension():
    r = random.Random(9)
    for _ in range(300):
        n = r.randint(2, 7)
        g = search.graph_of([(a, b, 1 << r.choice([0, 1, 2])) for a in range(n) for b in range(n) if a != b and r.random() < 0.3])
        d, w = search.masked(g, rel.DATA), search.masked(g, rel.ANY_RW)
        whole = {x: {**d.get(x, {}), **composed(d, w).get(x, {})} for x in g}
        for ys in list(whole.values()):
            for y in ys:
                whole.setdefault(y, {})
        assert search.smallest_extended(d, w) == search.smallest_component(whole)


def test_all_against_every_simple_cycle():
    """The whole search of a component: types by brute force, in the order and with the omissions that the search promises."""
    r = random.Random(10)
    for _ in range(120):
        n = r.randint(2, 5)
        without = r.choice([rel.PROCESS, rel.REALTIME])  # a check takes one order between transactions
        bits = [b for b in B.values() if b != without]
        g = search.graph_of([(a, b, r.choice(bits) | (r.choice(bits) if r.random() < 0.3 else 0)) for a in range(n) for b in range(n) if a != b and r.random() < 0.5])
        s = search.Search(g, timeout_s=None)
        every = brute_cycles(g)
        there = {name for name, spec in search.SPECS.items() if any(fits(spec, g, c) and s.fits(spec, c) for c in every)}
        got = s.all()
        found, specs = set(), [spec for t, spec, _ in got if not t.endswith("-cycle-exists")]
        for t, spec, cycle in got:
            if not t.endswith("-cycle-exists"):
                assert spec in there and fits(search.SPECS[spec], g, cycle)
                found |= {t, spec}
        left_out = models.all_implied_anomalies(found)
        assert all(name in specs or name in left_out for name in there)
        ruled_out = models.anomalies_to_impossible_models(found)
        assert {spec for t, spec, _ in got if t.endswith("-cycle-exists")} == {m for m, _ in search.existence_cases(g) if m not in ruled_out}


def test_steps_bound_the_search_and_leave_the_proof():
    """A long ring of anti-dependencies in noise: no simple cycle is found in time, but the model is ruled out."""
    ring, r = 300, random.Random(11)
    triples = []
    for a in range(ring):  # every second edge an anti-dependency
        triples.append((a, (a + 1) % ring, B["rw"] if a % 2 else B["wr"]))
    extra = ring
    for a in range(ring):
        for _ in range(8):  # transactions that read and write around each key
            triples += [(a, extra, B["wr"]), (extra, (a + 1) % ring, B["rw"])]
            extra += 1
    r.shuffle(triples)
    got = search.Search(search.graph_of(triples), timeout_s=None, steps_most=20_000).all()
    types = [t for t, _, _ in got]
    assert "cycle-search-timeout" in types and any(t.startswith("PL-SI") or t.startswith("G-nonadjacent") for t in types)
    again = search.Search(search.graph_of(triples), timeout_s=None, steps_most=20_000).all()
    assert again == got


def test_budget_degrades():
    ticks = itertools.count(step=10)
    g = search.graph_of([(a, (a + 1) % 400, B["rw"]) for a in range(400)])
    got = search.Search(g, timeout_s=1, clock=lambda: next(ticks)).all()
    types = [t for t, _, _ in got]
    assert "cycle-search-timeout" in types and any(t.startswith("G") for t in types)


def test_relations():
    assert rel.names(rel.mask("ww", "rwp")) == ["ww", "rwp"]
    assert rel.explained(rel.WR | rel.WW, "register") == rel.WR and rel.explained(rel.WR | rel.WW) == rel.WW
    assert search.ORDER[:5] == ("G-single-item", "G0", "G-nonadjacent-item", "G-single-item-process", "G1c") and len(search.ORDER) == 24
