"""The four checks: list append, read-write registers, closed predicates, and any graph.

A check reads a history and gives the anomalies found, each as the DataFrame of its proofs, and the
verdict against the consistency models asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..functions.ordered import pinned
from ..functions.shared import together
from ..operators import detectors, edges, explain, graph, render, search, txn, validate, versions
from ..sources.history import History, pair_index

Analyzer = Callable[[History], "Analysis"]


@dataclass(frozen=True)
class Analysis:
    """What an analyzer finds: edge facts, and anomalies by type."""

    facts: DataFrame
    anomalies: dict[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class Result:
    anomalies: dict[str, DataFrame]
    cycles: DataFrame
    facts: DataFrame
    kind: str
    models: tuple[str, ...] | None
    extra: tuple[str, ...] = ()
    history: History | None = None

    def summary(self) -> DataFrame:
        """(type, n): anomaly types and how many cases prove them."""
        parts = [rows.select(F.lit(name).alias("type")) for name, rows in self.anomalies.items()] + [self.cycles.select("type")]
        return reduce(DataFrame.unionByName, parts).groupBy("type").agg(F.count("*").alias("n"))

    def counts(self) -> dict[str, int]:
        return {r.type: r.n for r in self.summary().collect()}  # a row for each type of anomaly

    def verdict(self) -> dict[str, object]:
        """valid, anomaly_types, not, also_not."""
        return models.verdict(self.counts(), self.models, self.extra)

    def witnesses(self) -> DataFrame:
        """(cycle_id, type, scc, cycle): the cycles proper, without what is known to exist only."""
        real = "size(cycle) > 1 and element_at(cycle, 1) = element_at(cycle, -1) and not endswith(type, '-cycle-exists')"
        return self.cycles.filter(real).select(F.concat_ws("-", "scc", "spec").alias("cycle_id"), "type", "scc", "cycle")

    def write(self, folder: str) -> None:
        """Everything for people below ``folder``: cycles by type (S8), graphs of components and cycles (S9), pages of keys."""
        found = pinned(self.witnesses())
        texts = explain.rendered(found.select("cycle_id", "cycle"), self.facts, self.history.ops, self.kind, self.history.mops).join(found.select("cycle_id", "type"), "cycle_id")
        render.write_cycles(texts.select("type", "text"), f"{folder}/cycles")
        steps = pinned(explain.explained_steps(found.select("cycle_id", "cycle"), self.facts, self.kind))
        render.write_files(render.cycle_dots(steps, self.history.mops), ["cycle_id"], "dot", f"{folder}/cycle-graphs")
        inside = graph.component_edges(edges.edge_union(self.facts), graph.components(edges.edge_union(self.facts)))
        render.write_files(render.dots(inside, self.history.mops), ["scc"], "dot", f"{folder}/component-graphs")
        if "incompatible-order" in self.anomalies:
            pages = render.incompatible_pages(self.anomalies["incompatible-order"], self.history.possible().mops)
            render.write_files(pages, ["k", "page"], "html", f"{folder}/incompatible-orders")


def needed_orders(consistency: Iterable[str] | None, anomalies: Iterable[str] = ()) -> list[str]:
    """Which orders between transactions matter for these models (C11): real time, else the process, else none."""
    wanted = models.prohibited(consistency, anomalies)
    if wanted & models.realtime_types():
        return ["realtime"]
    return ["process"] if wanted & models.process_types() else []


def order_facts(history: History, orders: Iterable[str]) -> list[DataFrame]:
    made = {"process": lambda: edges.process_facts(history.ops), "realtime": lambda: edges.realtime_facts(pair_index(history.ops))}
    return [made[o]() for o in orders]


def combine(*analyzers: Analyzer) -> Analyzer:
    """One analyzer of several: facts together; for an anomaly type that two report, the later one counts."""

    def run(history: History) -> Analysis:
        found = [a(history) for a in analyzers]
        return Analysis(edges.union(*(f.facts for f in found)), {k: v for f in found for k, v in f.anomalies.items()})

    return run


def _finish(history: History, facts: Callable[[], DataFrame], anomalies: dict[str, Callable[[], DataFrame]], kind: str, consistency, extra, more: Iterable[Analyzer], timeout_s: float | None) -> Result:
    """Evidence and edges do not need each other; the search needs all edges."""
    others = [analyzer(history) for analyzer in more]
    orders = needed_orders(consistency, extra)
    made = together(
        *[lambda rows=rows: pinned(rows()) for rows in anomalies.values()],
        lambda: facts(),
        *[lambda order=order: order_facts(history, [order])[0] for order in orders],
    )
    found = dict(zip(anomalies, made, strict=False))
    for a in others:
        found |= a.anomalies
    all_facts = pinned(edges.union(*made[len(anomalies) :], *(a.facts for a in others)))
    cycles = pinned(search.cycle_cases(edges.edge_union(all_facts), kind, timeout_s))
    found["empty-transaction-graph"] = all_facts.limit(1).agg(F.count("*").alias("edges")).filter("edges = 0")
    return Result(found, cycles, all_facts, kind, None if consistency is None else tuple(consistency), tuple(extra), history)


def _prepared(history: History) -> History:
    """Client operations, each table written once: everything else reads what it needs of them."""
    validate.require_types(history)
    history = history.clients()
    return History(*together(lambda: pinned(history.ops), lambda: pinned(history.mops)))


def check_list_append(history: History, consistency: Iterable[str] | None = models.STRICT, anomalies: Iterable[str] = (), more: Iterable[Analyzer] = (), timeout_s: float | None = search.TIMEOUT_S, validated: bool = True) -> Result:
    """Keys hold lists; writes append unique elements; reads return whole lists."""
    if consistency is not None:
        models.validated(consistency)
    history = _prepared(history)
    mops = history.mops
    possible = mops.filter("type in ('ok', 'info')")
    order = pinned(versions.list_versions(possible))
    if validated:
        together(
            lambda: validate.require_none(validate.unexpected_mops(mops, ("r", "append")), "unexpected-txn-micro-op-types"),
            lambda: validate.require_none(validate.duplicate_appends(mops), "duplicate-appends"),
            lambda: validate.require_none(validate.garbage_elements(order, mops), "garbage-elements"),
        )
    found = {
        "G1a": lambda: detectors.g1a_list(mops),
        "G1b": lambda: detectors.g1b_list(mops),
        "internal": lambda: detectors.internal_list(mops),
        "dirty-update": lambda: detectors.dirty_update(mops, order),
        "duplicate-elements": lambda: detectors.duplicate_elements(possible),
        "incompatible-order": lambda: detectors.incompatible_order(possible),
        "future-read": lambda: detectors.future_read(mops),
        "lost-update": lambda: detectors.lost_update(mops, "array_join(transform(vs, x -> cast(x as string)), ',')"),
    }
    return _finish(history, lambda: edges.list_facts(possible, order), found, "list", consistency, anomalies, more, timeout_s)


def version_sources(history: History, reads: DataFrame, writes: DataFrame, sequential: bool, linearizable: bool, wfr: bool, order: DataFrame | None) -> list[tuple[str, DataFrame]]:
    """Version orders in the order in which they are trusted."""
    out = [("initial-state", versions.initial_versions(reads, writes))]
    if order is not None:
        out.append(("transaction-order", versions.ordered_versions(writes, order)))
    if wfr:
        out.append(("wfr-keys", versions.wfr_versions(reads, writes)))
    if sequential:
        out.append(("sequential-keys", versions.sequential_versions(history.ops, reads, writes)))
    if linearizable:
        out.append(("linearizable-keys", versions.linearizable_versions(pair_index(history.ops), reads, writes)))
    return out


def cyclic_versions(version_edges: DataFrame) -> DataFrame:
    """(k, scc, n): values of a key that come before themselves (A12); the graphs of all keys at once."""
    init = F.lit(-(1 << 63))
    keyed = version_edges.select("k", F.coalesce("v1", init).alias("a"), F.coalesce("v2", init).alias("b"))

    def run(pdf):
        import pandas as pd

        parts = [(k, p) for k, e in graph.each_group(pdf, "k") for p in graph.tarjan(zip(e["a"], e["b"], strict=True)) if len(p) > 1]
        return pd.DataFrame([(k, p[0], len(p), p) for k, p in parts], columns=["k", "first", "n", "vs"])

    return graph.in_batches(keyed, "k", run, "k string, first long, n long, vs array<long>")


def fold_versions(sources: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame, list[str]]:
    """(version edges, cyclic cases, sources kept): a source that makes any key cyclic is left out as a whole."""
    kept: DataFrame | None = None
    names: list[str] = []
    cases: list[DataFrame] = []
    for name, source in sources:
        candidate = pinned((source if kept is None else kept.unionByName(source)).distinct())
        # what leads from the initial state alone cannot come back
        bad = pinned(cyclic_versions(candidate)) if candidate.filter("v1 is not null").limit(1).count() else None
        if bad is not None and bad.limit(1).count():
            cases.append(bad.withColumn("sources", F.lit(",".join([*names, name]))))
        else:
            kept, names = candidate, [*names, name]
    empty = sources[0][1].limit(0)
    found = reduce(DataFrame.unionByName, cases) if cases else empty.select("k", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("n"), F.array(F.lit(0).cast("long")).alias("vs"), F.lit("").alias("sources"))
    return kept if kept is not None else empty, found, names


def check_rw_register(history: History, consistency: Iterable[str] | None = models.STRICT, anomalies: Iterable[str] = (), sequential_keys: bool = False, linearizable_keys: bool = False, wfr_keys: bool = False, transaction_order: DataFrame | None = None, more: Iterable[Analyzer] = (), timeout_s: float | None = search.TIMEOUT_S) -> Result:
    """Keys hold one value; writes are blind and unique; reads return the value."""
    if consistency is not None:
        models.validated(consistency)
    history = _prepared(history)
    mops = history.mops
    validate.require_none(validate.unexpected_mops(mops, ("r", "w")), "unexpected-txn-micro-op-types")
    reads, writes = together(lambda: pinned(txn.ext_reads(mops)), lambda: pinned(txn.ext_writes(mops)))
    validate.require_none(validate.ambiguous_reads(reads, writes), "ambiguous-writers")
    order, cyclic, _ = fold_versions(version_sources(history, reads, writes, sequential_keys, linearizable_keys, wfr_keys, transaction_order))
    found = {
        "G1a": lambda: detectors.g1a_register(mops),
        "G1b": lambda: detectors.g1b_register(mops),
        "internal": lambda: detectors.internal_register(mops),
        "lost-update": lambda: detectors.lost_update(mops),
        "cyclic-versions": lambda: cyclic,
    }
    facts = edges.union(edges.register_wr(reads, writes), edges.register_ww(order, writes), edges.register_rw(order, reads, writes))
    return _finish(history, lambda: facts, found, "register", consistency, anomalies, more, timeout_s)


def check_closed_predicate(history: History, consistency: Iterable[str] | None = models.STRICT, anomalies: Iterable[str] = (), faithful: bool = True, more: Iterable[Analyzer] = (), timeout_s: float | None = search.TIMEOUT_S) -> Result:
    """Rows with inserts, updates, deletes and predicate reads over a known universe."""
    if consistency is not None:
        models.validated(consistency)
    history = _prepared(history)
    mops = history.mops
    validate.require_none(validate.repeated_state_writes(txn.ext_state_writes(mops)), "multiple-writes-of-same-value")
    states = pinned(versions.state_versions(mops))
    sets = edges.predicate_sets(mops, states)
    found = {"predicate-read-miss": lambda: detectors.predicate_read_miss(mops, states)}
    return _finish(history, lambda: edges.predicate_facts(mops, states, sets, faithful), found, "predicate", consistency, anomalies, more, timeout_s)


@dataclass(frozen=True)
class GraphResult:
    """``cycles``: scc, size, cycle."""

    cycles: DataFrame
    facts: DataFrame
    anomalies: dict[str, DataFrame]

    def verdict(self) -> dict[str, object]:
        if self.facts.limit(1).count() == 0:
            return {"valid": "unknown", "anomaly_types": ["empty-transaction-graph"]}
        n = self.cycles.count()
        return {"valid": not n, "scc_count": n}


def check_graph(history: History, *analyzers: Analyzer) -> GraphResult:
    """Any analyzers: a history is valid if their graph has no cycle."""
    history = _prepared(history)
    analysis = combine(*analyzers)(history)
    facts = pinned(analysis.facts)
    return GraphResult(pinned(search.plain_cycles(edges.edge_union(facts))), facts, analysis.anomalies)


def monotonic_analyzer(observations: DataFrame) -> Analyzer:
    """Keys only grow: observed values order the operations that saw them."""
    return lambda history: Analysis(edges.monotonic_facts(observations))


def process_analyzer(history: History) -> Analysis:
    return Analysis(edges.process_facts(history.ops))


def realtime_analyzer(history: History) -> Analysis:
    return Analysis(edges.realtime_facts(pair_index(history.ops)))
