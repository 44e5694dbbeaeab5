"""Dependency edges between transactions, with their evidence.

Facts have src, dst (completions), rel (one bit), k, v1, v2 (versions; null is the initial one), a_mop
and b_mop. ``edge_union`` folds facts into one row of relation bits for each pair.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import relations as rel
from ..functions.expressions import matches
from ..functions.ordered import followed, pinned, running_max
from ..functions.shared import together
from .predicates import FEW, committed_reads, unseen
from .versions import list_readers, list_writers, navigated, previous_elements, resolved_reads

FACTS = "src long, dst long, rel int, k string, v1 long, v2 long, a_mop int, b_mop int"
_COLUMNS = ("src", "dst", "rel", "k", "v1", "v2", "a_mop", "b_mop")


def _facts(rows: DataFrame, relation: int) -> DataFrame:
    """Columns that ``rows`` lacks are null; a transaction does not depend on itself."""
    kinds = dict(x.split() for x in FACTS.split(", "))
    have = set(rows.columns)
    cols = [F.lit(relation).alias("rel") if c == "rel" else (F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in _COLUMNS]
    return rows.filter("src <> dst").select(*cols)


def union(*facts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, facts)


def edge_union(facts: DataFrame) -> DataFrame:
    """(src, dst, rels): relations of a pair as one bit set."""
    return facts.groupBy("src", "dst").agg(F.bit_or("rel").alias("rels"))


# lists -----------------------------------------------------------------------------------------------


def list_ww(mops: DataFrame, previous: DataFrame | None = None, writers: DataFrame | None = None) -> DataFrame:
    """Who appended the element before -> who appended (E1). ``previous`` and ``writers`` are made of ``mops`` if not given."""
    prev = (previous_elements(mops) if previous is None else previous).filter("prev is not null")
    w = (list_writers(mops) if writers is None else writers).select("k", F.col("v").alias("prev"), F.col("writer").alias("src"), F.col("mop").alias("a_mop"))
    return _facts(prev.join(w, ["k", "prev"]).select("src", F.col("index").alias("dst"), "k", F.col("prev").alias("v1"), F.col("v").alias("v2"), "a_mop", F.col("mop_idx").alias("b_mop")), rel.WW)


def list_wr(mops: DataFrame, readers: DataFrame | None = None, writers: DataFrame | None = None) -> DataFrame:
    """Who appended the last element read -> who read it."""
    w = (list_writers(mops) if writers is None else writers).select("k", "v", F.col("writer").alias("src"), F.col("mop").alias("a_mop"))
    r = (list_readers(mops) if readers is None else readers).filter("v is not null").select("k", "v", F.col("reader").alias("dst"), F.col("mop").alias("b_mop"))
    return _facts(w.join(r, ["k", "v"]).withColumn("v1", F.col("v")), rel.WR)


def list_rw(mops: DataFrame, previous: DataFrame | None = None, readers: DataFrame | None = None) -> DataFrame:
    """Who read the state before an append -> who appended (E3). The initial state is a version like others."""
    init = F.lit(-(1 << 63))  # equi-joins need a value where the initial state is null
    r = (list_readers(mops) if readers is None else readers).select("k", F.coalesce("v", init).alias("prev"), F.col("reader").alias("src"), F.col("mop").alias("a_mop"))
    a = (previous_elements(mops) if previous is None else previous).select("k", F.coalesce("prev", init).alias("prev"), F.col("prev").alias("v1"), F.col("v").alias("v2"), F.col("index").alias("dst"), F.col("mop_idx").alias("b_mop"))
    return _facts(r.join(a, ["k", "prev"]), rel.RW)


def list_facts(mops: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """All three; what they share is made once. ``order``: the version order, if there is one already."""
    previous, writers, readers = together(lambda: pinned(previous_elements(mops, order)), lambda: pinned(list_writers(mops)), lambda: pinned(list_readers(mops)))
    return union(list_ww(mops, previous, writers), list_wr(mops, readers, writers), list_rw(mops, previous, readers))


# registers -------------------------------------------------------------------------------------------


def register_wr(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """The one external writer of a value -> its external readers (E5)."""
    w = writes.filter("type = 'ok' and v is not null").groupBy("k", "v").agg(F.min("index").alias("src"), F.count("*").alias("n")).filter("n = 1")
    r = reads.filter("type = 'ok'").select("k", "v", F.col("index").alias("dst"))
    return _facts(w.join(r, ["k", "v"]).withColumn("v1", F.col("v")), rel.WR)


def register_ww(versions: DataFrame, writes: DataFrame) -> DataFrame:
    """Along a version edge: writers -> writers."""
    w = writes.filter("type = 'ok' and v is not null")
    a, b = w.select("k", F.col("v").alias("v1"), F.col("index").alias("src")), w.select("k", F.col("v").alias("v2"), F.col("index").alias("dst"))
    return _facts(versions.join(a, ["k", "v1"]).join(b, ["k", "v2"]), rel.WW)


def register_rw(versions: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Along a version edge: readers -> writers."""
    init = F.lit(-(1 << 63))
    r = reads.filter("type = 'ok'").select("k", F.coalesce("v", init).alias("at"), F.col("index").alias("src"))
    w = writes.filter("type = 'ok' and v is not null").select("k", F.col("v").alias("v2"), F.col("index").alias("dst"))
    return _facts(versions.withColumn("at", F.coalesce("v1", init)).join(r, ["k", "at"]).join(w, ["k", "v2"]), rel.RW)


# predicates ------------------------------------------------------------------------------------------


def predicate_ww(mops: DataFrame, versions: DataFrame, faithful: bool = True) -> DataFrame:
    """Writer of the version before -> writer (E8). By default plain writes make no such edge; inserts and deletes do."""
    kinds = "f in ('insert', 'delete')" if faithful else "f in ('insert', 'delete', 'w')"
    own = mops.filter(kinds).filter("type in ('ok', 'info')").select(F.col("index").alias("writer"), F.col("mop_idx").alias("mop"), "k")
    later = navigated(versions).filter("before is not null").join(own, ["k", "writer", "mop"])
    earlier = versions.filter("writer is not null").select("k", F.col("pos").alias("before"), F.col("writer").alias("src"), F.col("mop").alias("a_mop"), F.col("v").alias("v1"))
    return _facts(later.join(earlier, ["k", "before"]).select("src", F.col("writer").alias("dst"), "k", "v1", F.col("v").alias("v2"), "a_mop", F.col("mop").alias("b_mop")), rel.WW)


def item_reads(mops: DataFrame, versions: DataFrame) -> DataFrame:
    """(k, v, index, mop_idx, pos): committed item reads with the version they saw."""
    return resolved_reads(mops.filter("f = 'r' and type = 'ok' and k is not null").select("k", "v", "index", "mop_idx"), versions)


def matching_versions(preds: DataFrame, versions: DataFrame) -> DataFrame:
    """(pred, k, pos): live versions that match, by joins on the value, or on its remainder for each modulus."""
    live = versions.filter("state = 'live' and v is not null").select("k", "pos", "v")
    every = versions.filter("state = 'live'").select("k", "pos").join(F.broadcast(preds.filter("pred.kind = 'true'").select("pred").limit(1)), F.lit(True))  # one row
    equal = live.join(preds.filter("pred.kind = '='").select("pred", F.col("pred.a").alias("v")), "v").select("k", "pos", "pred")
    moduli = preds.filter("pred.kind = 'mod' and pred.a <> 0").select(F.col("pred.a").alias("a")).distinct()
    rests = live.join(moduli, F.lit(True)).select("k", "pos", "a", F.pmod("v", "a").alias("b"))
    modulo = rests.join(preds.filter("pred.kind = 'mod'").select("pred", F.col("pred.a").alias("a"), F.col("pred.b").alias("b")), ["a", "b"]).select("k", "pos", "pred")
    return every.select("k", "pos", "pred").unionByName(equal).unionByName(modulo).select("pred", "k", "pos")


@dataclass(frozen=True)
class VersionSets:
    """The version of each key that predicate reads must have seen (O18), in the size of the reads and versions.

    ``known``: (index, mop_idx, pred, k, pos) of keys in a result. ``only``: (pred, k, pos) of keys that are not
    in one: a read must have seen each of its predicate but those of its ``names``.
    """

    reads: DataFrame
    known: DataFrame
    only: DataFrame

    def rows(self) -> DataFrame:
        """(index, mop_idx, pred, k, pos): a row for each read and key."""
        return self.known.unionByName(unseen(self.reads, self.only).select("index", "mop_idx", "pred", "k", "pos"))


def predicate_sets(mops: DataFrame, versions: DataFrame) -> VersionSets:
    """A key in the result: the version read. A key that is not: its only version that does not match; unborn
    if all match; unknown (no row) if several do not. Unseen keys are condensed for each distinct predicate:
    versions that match are found by equi-joins, and what does not match is what is left of the key's number
    and sum of positions.
    """
    reads = committed_reads(mops)
    seen = reads.select("index", "mop_idx", "pred", F.explode("seen").alias("k", "v"))
    known = resolved_reads(seen, versions).filter("pos is not null").select("index", "mop_idx", "pred", "k", "pos")
    preds, whole = together(
        lambda: pinned(reads.select("pred").distinct()),
        lambda: pinned(versions.groupBy("k").agg(F.count("*").alias("all"), F.sum("pos").alias("sum"), F.max(F.when(F.col("state") == "unborn", F.col("pos"))).alias("unborn"))),
    )
    some = pinned(matching_versions(preds, versions).groupBy("pred", "k").agg(F.count("*").alias("hits"), F.sum("pos").alias("hit_sum")))
    left = F.col("all") - F.col("hits")
    several = some.join(whole, "k").filter(left <= 1).select("pred", "k", F.when(left == 1, F.col("sum") - F.col("hit_sum")).otherwise(F.col("unborn")).cast("int").alias("pos"))
    # of keys without a match only those with one version have one miss: a row for each predicate, as each read needs it
    lone = whole.filter("all = 1").select("k", F.col("sum").cast("int").alias("pos"))
    none = preds.join(F.broadcast(lone) if lone.count() <= FEW else lone, F.lit(True)).alias("x").join(some.alias("y"), F.col("x.pred").eqNullSafe(F.col("y.pred")) & (F.col("x.k") == F.col("y.k")), "left_anti")
    only = several.unionByName(none.select("pred", "k", "pos")).filter("pos is not null")
    return VersionSets(reads, known, pinned(only))


def version_sets(mops: DataFrame, versions: DataFrame) -> DataFrame:
    """(index, mop_idx, pred, k, pos): the version of each key that a predicate read must have seen.

    A result row for each read and key is what is asked for.
    """
    return predicate_sets(mops, versions).rows()


def predicate_wr(mops: DataFrame, versions: DataFrame) -> DataFrame:
    """Writer of the version read -> reader (E9, items)."""
    w = versions.filter("writer is not null").select("k", "pos", F.col("writer").alias("src"), F.col("mop").alias("a_mop"), F.col("v").alias("v1"))
    r = item_reads(mops, versions).filter("pos is not null").select("k", "pos", F.col("index").alias("dst"), F.col("mop_idx").alias("b_mop"))
    return _facts(w.join(r, ["k", "pos"]), rel.WR)


def _left_by(versions: DataFrame, sets: DataFrame) -> DataFrame:
    """``sets`` (k, pos, ...) with who wrote that version: src, a_mop, v1."""
    w = versions.filter("writer is not null and state <> 'unborn'").select("k", "pos", F.col("writer").alias("src"), F.col("mop").alias("a_mop"), F.col("v").alias("v1"))
    return w.join(sets, ["k", "pos"]).drop("pos")


def predicate_wrp(versions: DataFrame, sets: VersionSets) -> DataFrame:
    """Writer of a version that a predicate read depended on -> reader (E9, predicates)."""
    known = _left_by(versions, sets.known)
    rows = known.unionByName(unseen(sets.reads, _left_by(versions, sets.only)).select(*known.columns))
    return _facts(rows.withColumnsRenamed({"index": "dst", "mop_idx": "b_mop"}), rel.WRP)


def predicate_rw(mops: DataFrame, versions: DataFrame) -> DataFrame:
    """Reader -> writer of the next version (E10, items)."""
    r = item_reads(mops, versions).filter("pos is not null").select("k", (F.col("pos") + 1).alias("pos"), F.col("v").alias("v1"), F.col("index").alias("src"), F.col("mop_idx").alias("a_mop"))
    w = versions.filter("writer is not null").select("k", "pos", F.col("writer").alias("dst"), F.col("mop").alias("b_mop"), F.col("v").alias("v2"))
    return _facts(r.join(w, ["k", "pos"]), rel.RW)


def _changed_by(versions: DataFrame, sets: DataFrame) -> DataFrame:
    """``sets`` (pred, k, pos, ...) with each later version that changes whether the key matches: v1, v2, dst, b_mop."""
    hit = matches(F.col("pred.kind"), F.col("pred.a"), F.col("pred.b"), F.col("state"), F.col("v"))
    was = sets.join(versions.select("k", "pos", "state", "v"), ["k", "pos"]).withColumns({"was": hit, "v1": F.col("v")}).drop("state", "v")
    later = versions.filter("writer is not null").select("k", F.col("pos").alias("later"), "state", "v", F.col("writer").alias("dst"), F.col("mop").alias("b_mop"))
    rows = was.join(later, "k").filter("later > pos").filter(hit != F.col("was"))
    return rows.withColumnRenamed("v", "v2").drop("pos", "later", "state", "was")


def predicate_rwp(versions: DataFrame, sets: VersionSets) -> DataFrame:
    """Predicate reader -> writer of any later version that changes whether the key matches (E10, predicates)."""
    known = _changed_by(versions, sets.known)
    rows = known.unionByName(unseen(sets.reads, _changed_by(versions, sets.only)).select(*known.columns))
    return _facts(rows.withColumnsRenamed({"index": "src", "mop_idx": "a_mop"}), rel.RWP)


def predicate_facts(mops: DataFrame, versions: DataFrame, sets: VersionSets, faithful: bool = True) -> DataFrame:
    return union(predicate_ww(mops, versions, faithful), predicate_wr(mops, versions), predicate_wrp(versions, sets), predicate_rw(mops, versions), predicate_rwp(versions, sets))


# orders ----------------------------------------------------------------------------------------------


def process_facts(ops: DataFrame) -> DataFrame:
    """Consecutive committed operations of a process."""
    rows = followed(ops.filter("type = 'ok'").select("index", "process"), ["process"], "index", ["index"], "next")
    return _facts(rows.filter("next is not null").select(F.col("index").alias("src"), F.col("next.index").alias("dst")), rel.PROCESS)


def realtime_facts(spans: DataFrame) -> DataFrame:
    """Real-time order, transitively reduced.

    ``spans``: inv, comp, type. a -> b if a (ok) ended before b began, and no ok c both began after a's
    end and ended before b began: comp(a) < inv(b) < m(a), where m(a) is the earliest completion among the
    ok operations that begin after a ends. m is a running minimum over one order, computed per range of
    positions; the interval join meets in bins of positions.
    """
    ended = spans.filter("comp is not null")
    oks = ended.filter("type = 'ok'")
    marks = oks.select((-F.col("inv")).alias("at"), F.lit(0).alias("kind"), (-F.col("comp")).alias("neg"), F.lit(None).cast("long").alias("a"))
    marks = marks.unionByName(oks.select((-F.col("comp")).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("neg"), F.col("comp").alias("a")))
    bounds = running_max(marks, ["at", "kind"], "neg", "m").filter("kind = 1").select("a", (-F.col("m")).alias("bound"))
    extent = ended.agg(F.min("inv").alias("lo"), F.max("inv").alias("hi"), F.count("*").alias("n")).first()
    if not extent["n"]:
        return _facts(bounds.select(F.col("a").alias("src"), F.col("a").alias("dst")), rel.REALTIME)
    width = max(1, 8 * (extent["hi"] - extent["lo"] + 1) // extent["n"])
    bin_of = lambda c: F.floor(c / width).cast("long")
    upper = F.least(F.coalesce("bound", F.lit(extent["hi"] + 1)), F.lit(extent["hi"] + 1))
    a = bounds.select("a", upper.alias("upper")).filter("a < upper").select("a", "upper", F.explode(F.sequence(bin_of(F.col("a")), bin_of(F.col("upper")))).alias("bin"))
    b = ended.select("inv", F.col("comp").alias("b"), bin_of(F.col("inv")).alias("bin"))
    return _facts(a.join(b, "bin").filter("a < inv and inv < upper").select(F.col("a").alias("src"), F.col("b").alias("dst")), rel.REALTIME)


def monotonic_facts(observations: DataFrame) -> DataFrame:
    """All operations with one value of a key -> all with its next larger value (E14). ``observations``: index, k, v."""
    w = Window.partitionBy("k").orderBy("v")
    ranked = observations.select("index", "k", "v").distinct().withColumn("rank", F.dense_rank().over(w))
    a = ranked.select("k", (F.col("rank") + 1).alias("rank"), F.col("index").alias("src"), F.col("v").alias("v1"))
    b = ranked.select("k", "rank", F.col("index").alias("dst"), F.col("v").alias("v2"))
    return _facts(a.join(b, ["k", "rank"]), rel.WW)


