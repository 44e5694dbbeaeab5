"""Anomalies that show without a cycle. Each returns the rows that prove it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import is_prefix, last_or_null
from ..functions.ordered import pinned
from .edges import matching_versions
from .predicates import committed_reads, unseen
from .txn import element_frequencies, failed_writes, intermediate_writes
from .validate import require_none
from .versions import list_versions, list_writers, observed_lists


def g1a_list(mops: DataFrame) -> DataFrame:
    """Committed reads of elements that an aborted transaction appended (A1)."""
    seen = mops.filter("type = 'ok' and f = 'r' and size(vs) > 0").select("index", "mop_idx", "k", F.explode("vs").alias("v"))
    return seen.join(failed_writes(mops), ["k", "v"]).select("index", "mop_idx", "k", "v", "writer").distinct()


def g1a_register(mops: DataFrame) -> DataFrame:
    """Committed reads of a value that an aborted transaction wrote (A2)."""
    return mops.filter("type = 'ok' and f = 'r' and v is not null").select("index", "mop_idx", "k", "v").join(failed_writes(mops), ["k", "v"]).select("index", "mop_idx", "k", "v", "writer")


def g1b_list(mops: DataFrame) -> DataFrame:
    """Committed reads whose last element another transaction appended and then followed up (A3)."""
    reads = mops.filter("type = 'ok' and f = 'r' and size(vs) > 0").select("index", "mop_idx", "k", last_or_null(F.col("vs")).alias("v"))
    return reads.join(intermediate_writes(mops), ["k", "v"]).filter("index <> writer").select("index", "mop_idx", "k", "v", "writer")


def g1b_register(mops: DataFrame) -> DataFrame:
    """Committed reads of a value that another transaction overwrote itself (A4)."""
    reads = mops.filter("type = 'ok' and f = 'r' and v is not null").select("index", "mop_idx", "k", "v")
    return reads.join(intermediate_writes(mops), ["k", "v"]).filter("index <> writer").select("index", "mop_idx", "k", "v", "writer")


def _first(rows: DataFrame) -> DataFrame:
    """The first offending row of each transaction."""
    names = [c for c in rows.columns if c not in ("index", "mop_idx")]
    return rows.groupBy("index").agg(F.min(F.struct("mop_idx", *names)).alias("m")).select("index", "m.*")


def internal_list(mops: DataFrame) -> DataFrame:
    """First read of a committed transaction that contradicts its own earlier reads and appends (A5).

    After a read the whole list is known: it must be that list and what was appended since. Before any
    read, the appends so far must be a suffix. A null read and an empty one differ.
    """
    w = Window.partitionBy("index", "k").orderBy("mop_idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = mops.filter("type = 'ok' and f in ('r', 'append')").select("index", "mop_idx", "f", "k", "v", "vs")
    rows = rows.withColumn("last_read", F.max(F.when(F.col("f") == "r", F.col("mop_idx"))).over(before))
    rows = rows.withColumn("known", F.last(F.when(F.col("f") == "r", F.struct("vs")), ignorenulls=True).over(before))
    rows = rows.withColumn("done", F.collect_list(F.when(F.col("f") == "append", F.struct("mop_idx", "v"))).over(before))
    own = F.transform(F.filter("done", lambda x: F.col("last_read").isNull() | (x["mop_idx"] > F.col("last_read"))), lambda x: x["v"])
    reads = rows.filter("f = 'r'").withColumn("own", own).withColumn("seen", F.coalesce("vs", F.array().cast("array<bigint>")))
    expected = F.concat(F.coalesce("known.vs", F.array().cast("array<bigint>")), F.col("own"))
    after_read = F.when(F.size("own") > 0, expected != F.col("seen")).otherwise(~F.col("known.vs").eqNullSafe(F.col("vs")))
    tail = F.slice("seen", F.greatest(F.size("seen") - F.size("own") + 1, F.lit(1)), F.greatest(F.size("own"), F.lit(1)))
    unread = (F.size("own") > 0) & ((F.size("seen") < F.size("own")) | (tail != F.col("own")))
    bad = F.when(F.col("last_read").isNotNull(), after_read).otherwise(unread)
    return _first(reads.filter(bad).select("index", "mop_idx", "k", F.when(F.col("last_read").isNotNull(), expected).otherwise(F.col("own")).alias("expected"), F.col("last_read").isNull().alias("prefix_unknown"), "vs"))


def internal_register(mops: DataFrame) -> DataFrame:
    """First read of a committed transaction other than its own last read or write of the key."""
    w = Window.partitionBy("index", "k").orderBy("mop_idx")
    rows = mops.filter("type = 'ok' and f in ('r', 'w')").select("index", "mop_idx", "f", "k", "v", F.lag("v").over(w).alias("expected"), F.lag("mop_idx").over(w).alias("earlier"))
    return _first(rows.filter("f = 'r' and earlier is not null and not v <=> expected").select("index", "mop_idx", "k", "expected", "v"))


def incompatible_order(mops: DataFrame) -> DataFrame:
    """(k, a, b): per key the first lists, by length, where the shorter is no prefix of the longer.

    Lists of one length are ordered by their elements.
    """
    w = Window.partitionBy("k").orderBy(F.size("vs"), "vs")
    pairs = observed_lists(mops).select("k", F.col("vs").alias("a"), F.lead("vs").over(w).alias("b"))
    bad = pairs.filter(F.col("b").isNotNull() & ~is_prefix(F.col("a"), F.col("b")))
    return bad.groupBy("k").agg(F.min(F.struct(F.size("a").alias("n"), "a", "b")).alias("m")).select("k", "m.a", "m.b")


def require_total_order(mops: DataFrame) -> None:
    """Raises if some key's reads have no common order (V9)."""
    require_none(incompatible_order(mops), "no-total-state-order")


def duplicate_elements(mops: DataFrame) -> DataFrame:
    """Elements that occur more than once in one read."""
    reads = mops.filter("f = 'r' and type in ('ok', 'info') and vs is not null").filter(F.size("vs") != F.size(F.array_distinct("vs")))
    return element_frequencies(reads).filter("n > 1")


def future_read(mops: DataFrame) -> DataFrame:
    """First read of a committed transaction that has an element which the transaction appends later."""
    seen = mops.filter("type = 'ok' and f = 'r' and size(vs) > 0").select("index", F.col("mop_idx").alias("read_at"), "k", F.explode("vs").alias("v"))
    own = mops.filter("type = 'ok' and f = 'append'").select("index", "mop_idx", "k", "v")
    rows = seen.join(own, ["index", "k", "v"]).filter("read_at < mop_idx")
    return rows.groupBy("index").agg(F.min(F.struct("mop_idx", "read_at", "k", "v")).alias("m")).select("index", F.col("m.read_at").alias("mop_idx"), F.col("m.mop_idx").alias("append_at"), "m.k", "m.v")


def dirty_update(mops: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Committed appends on top of an aborted one, with no committed element between (A10).

    (k, fail_pos, ok_pos, fail_writer, ok_writer, values): from the first aborted element since the last
    committed one; elements of unknown outcome change nothing. Elements that nobody appended are no part of
    it (``validate.garbage_elements`` has them).
    """
    order = (list_versions(mops) if order is None else order).join(list_writers(mops, "ok", "info", "fail"), ["k", "v"])
    order = pinned(order)
    before = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = order.withColumn("last_ok", F.coalesce(F.max(F.when(F.col("writer_type") == "ok", F.col("pos"))).over(before), F.lit(-1)))
    island = Window.partitionBy("k", "last_ok")
    rows = rows.withColumn("fail", F.min(F.when(F.col("writer_type") == "fail", F.struct("pos", "writer"))).over(island))
    hits = rows.filter("writer_type = 'ok' and fail is not null and fail.pos < pos").select("k", F.col("fail.pos").alias("fail_pos"), F.col("pos").alias("ok_pos"), F.col("fail.writer").alias("fail_writer"), F.col("writer").alias("ok_writer"))
    parts = order.select("k", "pos", "v").join(hits, "k").filter("pos between fail_pos and ok_pos")
    return parts.groupBy("k", "fail_pos", "ok_pos", "fail_writer", "ok_writer").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("values"))


def lost_update(mops: DataFrame, read_version: str = "v") -> DataFrame:
    """(k, v, n, first_txn, last_txn): versions from which several committed transactions went on to write.

    The first read of a key counts, and a write of the key after it. ``read_version`` is an expression of
    the version read: v for registers, the spelled list for lists; null is a version too. All transactions
    of a case are in ``lost_update_txns``.
    """
    return _updates(mops, read_version).groupBy("k", "v").agg(F.count("*").alias("n"), F.min("index").alias("first_txn"), F.max("index").alias("last_txn")).filter("n >= 2")


def _updates(mops: DataFrame, read_version: str) -> DataFrame:
    """(k, v, index): the version that each committed transaction read of a key and then wrote over."""
    rows = mops.filter("type = 'ok' and k is not null")
    reads = rows.filter("f = 'r'").groupBy("index", "k").agg(F.min(F.struct("mop_idx", F.expr(read_version).alias("v"))).alias("r"))
    writes = rows.filter("f in ('append', 'w', 'insert', 'delete')").groupBy("index", "k").agg(F.max("mop_idx").alias("w"))
    return reads.join(writes, ["index", "k"]).filter("w > r.mop_idx").select("k", F.col("r.v").alias("v"), "index")


def lost_update_txns(mops: DataFrame, read_version: str = "v") -> DataFrame:
    """(k, v, n, index): a row for each transaction of a lost update, however many there are."""
    rows, cases = _updates(mops, read_version).alias("u"), lost_update(mops, read_version).alias("l")
    return rows.join(cases, (F.col("u.k") == F.col("l.k")) & F.col("u.v").eqNullSafe(F.col("l.v"))).select("u.k", "u.v", "n", "index")


def predicate_read_miss(mops: DataFrame, versions: DataFrame) -> DataFrame:
    """(index, mop_idx, k): committed predicate reads without a key whose every version matches.

    Versions that match are counted for each key and distinct predicate, so reads never meet single versions.
    """
    reads = committed_reads(mops)
    hits = matching_versions(pinned(reads.select("pred").distinct()), versions).groupBy("pred", "k").agg(F.count("*").alias("hits"))
    always = hits.join(versions.groupBy("k").agg(F.count("*").alias("all")), "k").filter("hits = all").select("pred", "k")
    return unseen(reads, always).select("index", "mop_idx", "k")
