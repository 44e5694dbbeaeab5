"""Graphs as edge DataFrames (src, dst, rels)."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import pinned, running_max, shuffle_partitions

EDGES = "src long, dst long, rels int"
#: Edges that one task may hold as one group; larger ones are solved by distributed colouring.
ISLAND_EDGES = 1_000_000
#: Rows of small groups that a Python function gets at once, about.
BATCH = 20_000
#: Edges of a stretch of the vertex order that a task contracts, about; four times as many at most.
STRETCH = 20_000


# construction and change (G1-G5) ------------------------------------------------------------------------


def from_map(spark: SparkSession, adjacency: dict[int, Iterable[int]], rels: int = 0) -> DataFrame:
    return spark.createDataFrame([(a, b, rels) for a, bs in adjacency.items() for b in bs], EDGES)


def link(edges: DataFrame, pairs: DataFrame, rels: int = 0) -> DataFrame:
    """With (src, dst) pairs added."""
    return union(edges, pairs.select("src", "dst", F.lit(rels).alias("rels")))


def link_to_all(edges: DataFrame, source: int, targets: DataFrame, rels: int = 0) -> DataFrame:
    """With one vertex linked to each of ``targets.vertex``."""
    return link(edges, targets.select(F.lit(source).cast("long").alias("src"), F.col("vertex").alias("dst")), rels)


def link_all_to(edges: DataFrame, sources: DataFrame, target: int, rels: int = 0) -> DataFrame:
    """With each of ``sources.vertex`` linked to one vertex."""
    return link(edges, sources.select(F.col("vertex").alias("src"), F.lit(target).cast("long").alias("dst")), rels)


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dsts): a row for each vertex with its successors in order, as host structures have them."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("dsts"))


def to_map(edges: DataFrame, most: int = 1_000_000) -> dict[int, list[int]]:
    """The graph on the driver; raises if it has more than ``most`` edges."""
    if edges.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} edges")
    return {r.src: list(r.dsts) for r in adjacency(edges).toLocalIterator()}


def link_all_to_all(edges: DataFrame, sources: DataFrame, targets: DataFrame, by: list[str], rels: int = 0) -> DataFrame:
    """With every source linked to every target of its group ``by`` (vertex columns src and dst)."""
    return link(edges, sources.join(targets, by).select("src", "dst"), rels)


def unlink(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return edges.join(pairs.select("src", "dst"), ["src", "dst"], "left_anti").select(*edges.columns)


def without_self_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def out_of(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return edges.join(vertices.select(F.col("vertex").alias("src")), "src", "left_semi").select(*edges.columns)


def into(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return edges.join(vertices.select(F.col("vertex").alias("dst")), "dst", "left_semi").select(*edges.columns)


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("vertex")).union(edges.select(F.col("dst").alias("vertex"))).distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("src", "dst").agg(F.bit_or("rels").alias("rels"))


def project(edges: DataFrame, mask: int) -> DataFrame:
    """Only these relations; edges without any of them go."""
    return edges.withColumn("rels", F.col("rels").bitwiseAND(F.lit(mask))).filter("rels <> 0")


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends among ``keep.vertex``."""
    return into(out_of(edges, keep), keep)


def map_vertices(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Vertices renamed by (vertex, to); those without a name stay; relations of edges that meet are merged."""
    a, b = mapping.select(F.col("vertex").alias("src"), F.col("to").alias("src_to")), mapping.select(F.col("vertex").alias("dst"), F.col("to").alias("dst_to"))
    rows = edges.join(a, "src", "left").join(b, "dst", "left")
    return rows.select(F.coalesce("src_to", "src").alias("src"), F.coalesce("dst_to", "dst").alias("dst"), "rels").groupBy("src", "dst").agg(F.bit_or("rels").alias("rels"))


def composition(a: DataFrame, b: DataFrame) -> DataFrame:
    """a;b: a step in a, then one in b, as one edge without relations."""
    left, right = a.select("src", F.col("dst").alias("mid")), b.select(F.col("src").alias("mid"), "dst")
    return left.join(right, "mid").select("src", "dst").distinct().withColumn("rels", F.lit(0))


def extension(a: DataFrame, b: DataFrame) -> DataFrame:
    """a and a;b."""
    return union(a.select("src", "dst", "rels"), composition(a, b))


def _in_bounds(n: int, rounds: int | None) -> None:
    if rounds is not None and n >= rounds:
        raise RuntimeError(f"not finished after {rounds} rounds")


def reachable(edges: DataFrame, start: DataFrame, rounds: int | None = None) -> DataFrame:
    """Vertices reached from ``start.vertex``, themselves included (G11): breadth first, a join for each shell.

    Goes on until a shell is empty; beyond ``rounds`` shells, where given, it raises an error.
    """
    seen = pinned(start.select("vertex").distinct())
    shell = seen
    for n in itertools.count():
        shell = pinned(shell.join(edges, shell["vertex"] == edges["src"]).select(F.col("dst").alias("vertex")).distinct().join(seen, "vertex", "left_anti"))
        if not shell.limit(1).count():
            return seen
        _in_bounds(n, rounds)
        seen = seen.union(shell)
        if n % 16 == 15:
            seen = pinned(seen)


def collapse(edges: DataFrame, keep: DataFrame, rounds: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """Only vertices of ``keep``, linked where a path leads through others alone.

    Stretches of the vertex order are contracted first, a task each; what is left are the other vertices that an
    edge from another stretch leads to, and they are followed by joins until no path is open. Beyond ``rounds``
    steps, where given, it raises an error; stretches are left alone then.
    """
    if rounds is not None:
        return _followed_through(edges, keep, rounds)
    kept = keep.select("vertex").distinct()
    ends = edges.select("src", "dst").join(kept.select(F.col("vertex").alias("src"), F.lit(True).alias("a")), "src", "left").join(kept.select(F.col("vertex").alias("dst"), F.lit(True).alias("b")), "dst", "left")
    ends = pinned(ends.select("src", "dst", F.col("a").isNotNull().alias("a"), F.col("b").isNotNull().alias("b")))
    direct = ends.filter("a and b").select("src", "dst")
    short, left = _contracted(ends.filter("not (a and b)"), stretch)
    done = direct.union(short.join(left.select(F.col("vertex").alias("src")), "src", "left_anti").join(left.select(F.col("vertex").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if not left.limit(1).count():
        return done.distinct()
    through = short.join(left.select(F.col("vertex").alias("src")), "src", "left_semi").unionByName(short.join(left.select(F.col("vertex").alias("dst")), "dst", "left_semi")).distinct()
    return done.union(_followed_through(pinned(through), kept, None)).distinct()


def _followed_through(edges: DataFrame, keep: DataFrame, rounds: int | None) -> DataFrame:
    """``collapse`` by joins alone, a step of all open paths at a time."""
    out = edges.join(keep.select(F.col("vertex").alias("src")), "src", "left_semi").select("src", "dst")
    done = into(out, keep)
    open_ = pinned(out.join(keep.select(F.col("vertex").alias("dst")), "dst", "left_anti").select("src", "dst"))
    seen = open_
    for n in itertools.count():
        step = pinned(open_.withColumnRenamed("dst", "mid").join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct())
        done = done.union(into(step, keep))
        open_ = pinned(step.join(keep.select(F.col("vertex").alias("dst")), "dst", "left_anti").join(seen, ["src", "dst"], "left_anti").select("src", "dst"))
        if not open_.limit(1).count():
            return done.distinct()
        _in_bounds(n, rounds)
        seen = seen.union(open_)
        if n % 16 == 15:
            seen, done = pinned(seen), pinned(done.distinct())


def _stretch_of(vertex: Column, cuts: list[int], below: int = 0) -> Column:
    """How many of the sorted cuts a vertex has come to."""
    if not cuts:
        return F.lit(below)
    mid = len(cuts) // 2
    return F.when(vertex < cuts[mid], _stretch_of(vertex, cuts[:mid], below)).otherwise(_stretch_of(vertex, cuts[mid + 1 :], below + mid + 1))


def _contracted(edges: DataFrame, stretch: int) -> tuple[DataFrame, DataFrame]:
    """(edges src, dst; vertices left between them) of ``edges`` (src, dst, a, b), of which a and b say which ends are to stay.

    A vertex that is not to stay is left if an edge comes to it from such a vertex of another stretch, or if its
    stretch is too large for one task. So paths through the rest never leave a stretch.
    """
    n = edges.count() // stretch
    cuts: list[int] = []
    if n:  # one number for each stretch
        probe = F.percentile_approx(F.when(F.col("a"), F.col("dst")).otherwise(F.col("src")), [i / (n + 1) for i in range(1, n + 1)], max(10_000, 10 * n))
        cuts = sorted(set(edges.agg(probe.alias("cuts")).first()["cuts"]))
    rows = pinned(edges.withColumns({"sa": _stretch_of(F.col("src"), cuts), "sb": _stretch_of(F.col("dst"), cuts)}))
    ends = rows.filter("not a").select(F.col("src").alias("vertex"), F.col("sa").alias("s")).unionByName(rows.filter("not b").select(F.col("dst").alias("vertex"), F.col("sb").alias("s")))
    large = ends.groupBy("s").count().filter(F.col("count") > 4 * stretch).select("s")
    left = pinned(rows.filter("not a and not b and sa <> sb").select(F.col("dst").alias("vertex")).union(ends.join(large, "s", "left_semi").select("vertex")).distinct())
    marked = rows.join(left.select(F.col("vertex").alias("src"), F.lit(True).alias("la")), "src", "left").join(left.select(F.col("vertex").alias("dst"), F.lit(True).alias("lb")), "dst", "left")
    marked = marked.select("src", "dst", (F.col("a") | F.col("la").isNotNull()).alias("a"), (F.col("b") | F.col("lb").isNotNull()).alias("b"), "sa", "sb")
    marked = pinned(marked.withColumn("s", F.when(~F.col("a"), F.col("sa")).when(~F.col("b"), F.col("sb"))).drop("sa", "sb"))
    inside = marked.filter("s is not null").repartition(max(shuffle_partitions(edges.sparkSession), n), "s").groupBy("s").applyInPandas(_contract, "src long, dst long")
    return pinned(marked.filter("s is null").select("src", "dst").unionByName(inside)), left


def _contract(pdf: pd.DataFrame) -> pd.DataFrame:
    """(src, dst) of vertices that stay, linked through others: what each of the others reaches is a set of bits, made along components."""
    src, dst, a, b = (pdf[c].tolist() for c in ("src", "dst", "a", "b"))
    targets = sorted({y for y, stays in zip(dst, b, strict=True) if stays})
    bit = {v: i for i, v in enumerate(targets)}
    out: dict[int, set[int]] = {}
    reach: dict[int, int] = {}
    begins: dict[int, list[int]] = {}
    steps: list[tuple[int, int]] = []
    for x, y, from_end, to_end in zip(src, dst, a, b, strict=True):
        if from_end:
            begins.setdefault(x, []).append(y)
        elif to_end:
            out.setdefault(x, set()).add(bit[y])
        else:
            steps.append((x, y))
    after: dict[int, list[int]] = {}
    for x, y in steps:
        after.setdefault(x, []).append(y)
    others = {*out, *after, *(y for ys in begins.values() for y in ys)}
    for part in tarjan([*steps, *((v, v) for v in others)]):  # what a component leads to comes before it
        got = 0
        for v in part:
            for i in out.get(v, ()):
                got |= 1 << i
            for w in after.get(v, ()):
                got |= reach.get(w, 0)
        for v in part:
            reach[v] = got
    at = np.array(targets, dtype="int64")
    found = {}
    for x, ys in begins.items():
        got = 0
        for y in ys:
            got |= reach[y]
        if got:
            bits = np.frombuffer(got.to_bytes((got.bit_length() + 7) // 8, "little"), dtype="uint8")
            found[x] = at[np.flatnonzero(np.unpackbits(bits, bitorder="little"))]
    if not found:
        return pd.DataFrame({"src": [], "dst": []}, dtype="int64")
    return pd.DataFrame({"src": np.repeat(np.array(list(found), dtype="int64"), [len(v) for v in found.values()]), "dst": np.concatenate(list(found.values()))})


# groups of rows in Python ----------------------------------------------------------------------------------


def each_group(pdf: pd.DataFrame, by: str) -> Iterator[tuple[object, dict[str, list]]]:
    """(value of ``by``, the other columns as lists) for each group of a batch."""
    if not len(pdf):
        return
    keys, at = pd.factorize(pdf[by], use_na_sentinel=False)
    order = np.argsort(keys, kind="stable")
    cuts = [*np.flatnonzero(np.diff(keys[order], prepend=-1)).tolist(), len(order)]
    columns = {c: pdf[c].to_numpy()[order] for c in pdf.columns if c not in (by, "batch")}
    for i, (a, b) in enumerate(itertools.pairwise(cuts)):
        yield at[i], {c: vs[a:b].tolist() for c, vs in columns.items()}


def in_batches(rows: DataFrame, by: str, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` on batches of whole groups ``by``: a call for each group costs more than most groups are worth.

    A batch has some thousands of rows and whatever its largest group has; there are as many tasks as batches,
    up to the session's own number of partitions at least.
    """
    rows = pinned(rows)
    n = max(shuffle_partitions(rows.sparkSession), rows.count() // BATCH)
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64(by), F.lit(n))).repartition(n, "batch")
    return dealt.groupBy("batch").applyInPandas(run, schema)


# strongly connected components (G8) ----------------------------------------------------------------------


def tarjan(edges: Iterable[tuple[int, int]]) -> list[list[int]]:
    """All components, single vertices included; iterative."""
    out: dict[int, list[int]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    on: set[int] = set()
    found: list[list[int]] = []
    for root in out:
        if root in number:
            continue
        work = [(root, iter(out[root]))]
        number[root] = low[root] = len(number)
        stack.append(root)
        on.add(root)
        while work:
            v, todo = work[-1]
            for w in todo:
                if w not in number:
                    number[w] = low[w] = len(number)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    found.append(sorted(part))
    return found


def backward_islands(edges: DataFrame) -> DataFrame:
    """(lo, hi): disjoint stretches of the vertex order outside of which no cycle passes.

    A cycle needs an edge that goes back in the order; it never leaves the merged interval of the
    backward edges around it, as coming back would take another backward edge. Intervals merge where they
    overlap or share a vertex.
    """
    back = edges.filter("dst < src").groupBy(F.col("dst").alias("lo")).agg(F.max("src").alias("hi"))
    reached = running_max(back, ["lo"], "hi", "reach", strictly_before=True)
    marked = reached.withColumn("start", F.when(F.col("reach").isNull() | (F.col("lo") > F.col("reach")), F.col("lo")))
    owned = running_max(marked.drop("reach"), ["lo"], "start", "island")
    return owned.groupBy(F.col("island").alias("lo")).agg(F.max("hi").alias("hi"))


def in_islands(edges: DataFrame, islands: DataFrame) -> DataFrame:
    """``edges`` with both ends in one island, with ``island``: an as-of join by a running maximum over one order."""
    starts = islands.select(F.col("lo").alias("at"), F.lit(0).alias("kind"), F.struct("lo", "hi").alias("span"), *[F.lit(None).cast("long").alias(c) for c in ("src", "dst")], F.lit(None).cast("int").alias("rels"))
    rows = edges.select(F.least("src", "dst").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<lo:bigint,hi:bigint>").alias("span"), "src", "dst", "rels")
    met = running_max(starts.unionByName(rows), ["at", "kind"], "span", "own")
    return met.filter("kind = 1 and greatest(src, dst) <= own.hi").select("src", "dst", "rels", F.col("own.lo").alias("island"))


def _scc_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one island, or of several: no path leads from one to another."""
    parts = [p for p in tarjan(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True)) if len(p) > 1]
    return pd.DataFrame({"vertex": [v for p in parts for v in p], "scc": [p[0] for p in parts for _ in p]}, dtype="int64")


def components(edges: DataFrame, island_edges: int = ISLAND_EDGES) -> DataFrame:
    """(vertex, scc) of components with more than one vertex; scc is the smallest of them."""
    schema = "vertex long, scc long"
    rows = pinned(edges.filter("src <> dst").select("src", "dst", "rels"))
    if not rows.filter("dst < src").limit(1).count():
        return edges.sparkSession.createDataFrame([], schema)
    placed = pinned(in_islands(rows, backward_islands(rows)))
    large = pinned(placed.groupBy("island").count().filter(F.col("count") > island_edges).select("island"))
    found = in_batches(placed.join(large, "island", "left_anti"), "island", _scc_group, schema)
    if large.limit(1).count():
        found = found.unionByName(coloured(placed.join(large, "island", "left_semi").select("src", "dst")))
    return pinned(found)  # whoever asks for edges meets it twice


def trimmed(edges: DataFrame) -> DataFrame:
    """Without vertices that have no way in or no way out: they are on no cycle."""
    left, n = edges, edges.count()
    while n:
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = pinned(kept.select("src", "dst"))
        before, n = n, left.count()
        if n == before:
            break
    return left


def without_chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between the ends of chains, chains: vertex, start, end).

    A chain vertex has one way in and one way out, and so is in a component if the ends of its chain are in
    it together. Ends are found by doubling: each round a vertex looks twice as far, so a ring of n vertices
    takes log2 n rounds. A ring of chain vertices alone keeps its smallest vertex as both ends.
    """
    degree = edges.select(F.col("src").alias("vertex"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("vertex"), F.lit(0).alias("o"), F.lit(1).alias("i"))).groupBy("vertex").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    inner = pinned(degree.filter("o = 1 and i = 1").select("vertex"))
    ahead = edges.join(inner.select(F.col("vertex").alias("src")), "src", "left_semi")
    stops = F.col("inner").isNull()
    # at: the vertex looked at; low: the smallest chain vertex passed, itself included; done: at is no chain vertex
    state = pinned(ahead.join(inner.select(F.col("vertex").alias("dst"), F.lit(1).alias("inner")), "dst", "left").select(F.col("src").alias("vertex"), F.col("dst").alias("at"), F.col("src").alias("low"), F.col("src").alias("last"), stops.alias("done")))
    reach, n = 1, state.count()
    while reach <= n and state.filter("not done").limit(1).count():
        far = state.select(F.col("vertex").alias("at"), F.col("at").alias("far"), F.col("low").alias("far_low"), F.col("last").alias("far_last"), F.col("done").alias("far_done"))
        open_ = state.filter("not done").join(far, "at").select("vertex", F.col("far").alias("at"), F.least("low", "far_low").alias("low"), F.col("far_last").alias("last"), F.col("far_done").alias("done"))
        state = pinned(state.filter("done").unionByName(open_))
        reach *= 2
    ring = state.filter("not done").select("vertex", F.col("low").alias("start"), F.col("low").alias("end"))
    # the first vertex of a chain is the one that a vertex outside leads to; its start is that vertex
    entry = edges.join(inner.select(F.col("vertex").alias("dst")), "dst", "left_semi").join(inner.select(F.col("vertex").alias("src")), "src", "left_anti").select(F.col("dst").alias("vertex"), F.col("src").alias("start"))
    by_last = entry.join(state.filter("done"), "vertex").select("last", "start")
    chain = state.filter("done").join(by_last, "last").select("vertex", "start", F.col("at").alias("end"))
    chains = pinned(chain.unionByName(ring))
    plain = edges.join(inner.select(F.col("vertex").alias("src")), "src", "left_anti").join(inner.select(F.col("vertex").alias("dst")), "dst", "left_anti").select("src", "dst")
    short = plain.union(chains.filter("start <> end").select(F.col("start").alias("src"), F.col("end").alias("dst"))).distinct()
    return pinned(short), chains


def coloured(edges: DataFrame) -> DataFrame:
    """Components with joins alone, for islands beyond one task: chains are taken out, the rest is coloured.

    The smallest vertex that reaches each vertex is its colour, and what reaches a colour's own vertex inside
    the colour is its component; what is left is trimmed and goes on. Spreading a colour takes as many rounds
    as its path is long, once chains are gone.
    """
    left = trimmed(pinned(edges.filter("src <> dst").select("src", "dst").distinct()))
    done = edges.sparkSession.createDataFrame([], "vertex long, scc long")
    if not left.limit(1).count():
        return done
    left, chains = without_chains(left)
    while left.limit(1).count():
        left = trimmed(left.filter("src <> dst"))
        colors = pinned(vertices(left).withColumn("color", F.col("vertex")))
        while True:
            got = left.join(colors.withColumnRenamed("vertex", "src"), "src").groupBy(F.col("dst").alias("vertex")).agg(F.min("color").alias("other"))
            new = pinned(colors.join(got, "vertex", "left").select("vertex", F.least("color", "other").alias("color"), (F.col("other") < F.col("color")).alias("moved")))
            colors = new.select("vertex", "color")
            if not new.filter("moved").limit(1).count():
                break
        # backward from each colour's own vertex, inside its colour
        inside = pinned(left.join(colors.select(F.col("vertex").alias("src"), F.col("color").alias("a")), "src").join(colors.select(F.col("vertex").alias("dst"), F.col("color").alias("b")), "dst").filter("a = b").select("src", "dst", F.col("a").alias("color")))
        shell = seen = pinned(colors.filter("vertex = color"))
        while True:
            at = shell.select(F.col("vertex").alias("dst"), "color")
            shell = pinned(inside.join(at, ["dst", "color"]).select(F.col("src").alias("vertex"), "color").distinct().join(seen, ["vertex", "color"], "left_anti"))
            if not shell.limit(1).count():
                break
            seen = pinned(seen.union(shell))
        found = seen.select("vertex", F.col("color").alias("scc"))
        several = found.groupBy("scc").count().filter("count > 1").select("scc")
        done = pinned(done.unionByName(found.join(several, "scc", "left_semi").select("vertex", "scc")))
        left = pinned(left.join(found.select(F.col("vertex").alias("src")), "src", "left_anti").join(found.select(F.col("vertex").alias("dst")), "dst", "left_anti").select("src", "dst"))
    return _with_chains(done, chains)


def _with_chains(found: DataFrame, chains: DataFrame) -> DataFrame:
    """Components of the ends of chains with the chains' own vertices, named after their smallest again."""
    a, b = found.select(F.col("vertex").alias("start"), F.col("scc").alias("s")), found.select(F.col("vertex").alias("end"), F.col("scc").alias("e"))
    ends = chains.join(a, "start", "left").join(b, "end", "left")
    # a chain from a vertex back to itself is a component even if that vertex is in no other
    rows = ends.filter("start = end or s = e").select("vertex", F.coalesce("s", "start").alias("c"))
    loops = ends.filter("start = end and s is null").select(F.col("start").alias("vertex"), F.col("start").alias("c"))
    own = found.select("vertex", F.col("scc").alias("c")).unionByName(rows).unionByName(loops).distinct()
    names = own.groupBy("c").agg(F.min("vertex").alias("scc"), F.count("*").alias("n")).filter("n > 1")
    return own.join(names, "c").select("vertex", "scc")


def component_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(scc, src, dst, rels): edges inside components."""
    a = members.select(F.col("vertex").alias("src"), "scc")
    b = members.select(F.col("vertex").alias("dst"), F.col("scc").alias("scc_b"))
    return edges.join(a, "src").join(b, "dst").filter("scc = scc_b").select("scc", "src", "dst", "rels")
