"""Version orders: what the values of a key were, and in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import last_or_null
from ..functions.ordered import pinned


# lists -----------------------------------------------------------------------------------------------


def observed_lists(mops: DataFrame) -> DataFrame:
    """(k, vs): distinct non-empty lists that were read (O1)."""
    return mops.filter("f = 'r' and size(vs) > 0").select("k", "vs").distinct()


def single_appends(mops: DataFrame) -> DataFrame:
    """(k, v): keys with exactly one append (O2)."""
    return mops.filter("f = 'append'").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("v")).filter("n = 1").select("k", "v")


def list_versions(mops: DataFrame) -> DataFrame:
    """(k, pos, v): the longest list read, without repeats; one lone append where nothing was read (O2, O3).

    Of several longest lists the greatest counts.
    """
    reads = mops.filter("f = 'r' and size(vs) > 0").select("k", F.struct(F.size("vs").alias("n"), "vs").alias("best"), F.lit(None).cast("long").alias("v"))
    appends = mops.filter("f = 'append'").select("k", F.lit(None).cast("struct<n:int,vs:array<bigint>>").alias("best"), "v")
    by_key = reads.unionByName(appends).groupBy("k").agg(F.max("best").alias("best"), F.count("v").alias("n"), F.max("v").alias("v"))
    order = F.when(F.col("best").isNotNull(), F.array_distinct("best.vs")).when(F.col("n") == 1, F.array("v"))
    return by_key.select("k", F.posexplode(order).alias("pos", "v"))


def list_writers(mops: DataFrame, *types: str) -> DataFrame:
    """(k, v, writer, writer_type, mop): the completion that appended an element; the last wins."""
    rows = mops.filter((F.col("f") == "append") & F.col("type").isin(*(types or ("ok", "info"))))
    return rows.groupBy("k", "v").agg(F.max(F.struct("index", "type", "mop_idx")).alias("w")).select("k", "v", F.col("w.index").alias("writer"), F.col("w.type").alias("writer_type"), F.col("w.mop_idx").alias("mop"))


def list_readers(mops: DataFrame) -> DataFrame:
    """(k, v, reader, mop): reads by their last element; v null is the initial state.

    A null read of an info operation is unknown, not initial, and is left out.
    """
    reads = mops.filter("f = 'r' and (type = 'ok' or (type = 'info' and vs is not null))")
    return reads.select("k", last_or_null(F.col("vs")).alias("v"), F.col("index").alias("reader"), F.col("mop_idx").alias("mop"))


def previous_elements(mops: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """(k, v, prev, index, mop_idx): each append with the element before it.

    prev null is the initial state. An append that nobody saw comes after the last element known.
    """
    versions = list_versions(mops) if versions is None else versions
    w = Window.partitionBy("k").orderBy("pos")
    order = versions.select("k", "v", F.lag("v").over(w).alias("before"), F.lit(True).alias("seen"))
    last = versions.groupBy("k").agg(F.max_by("v", "pos").alias("last"))
    appends = mops.filter("f = 'append' and type in ('ok', 'info')").select("k", "v", "index", "mop_idx")
    return appends.join(order, ["k", "v"], "left").join(last, "k", "left").select("k", "v", F.when(F.col("seen"), F.col("before")).otherwise(F.col("last")).alias("prev"), "index", "mop_idx")


# registers: edges (k, v1, v2) between values, null is the initial value -------------------------------


def initial_versions(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """null comes before every value read (ok) or written (ok, info)."""
    values = reads.filter("type = 'ok'").select("k", "v").union(writes.filter("type in ('ok', 'info')").select("k", "v"))
    return values.filter("v is not null").distinct().select("k", F.lit(None).cast("long").alias("v1"), F.col("v").alias("v2"))


def wfr_versions(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Writes follow reads: what a committed transaction read of a key comes before what it wrote."""
    a = reads.filter("type = 'ok'").select("index", "k", F.col("v").alias("v1"))
    b = writes.filter("type = 'ok' and v is not null").select("index", "k", F.col("v").alias("v2"))
    return a.join(b, ["index", "k"]).select("k", "v1", "v2").distinct()


def ordered_versions(writes: DataFrame, order: DataFrame) -> DataFrame:
    """Consecutive writes of a key in a given total order (index, position) of transactions."""
    w = Window.partitionBy("k").orderBy("position")
    rows = writes.filter("type in ('ok', 'info')").join(order, "index")
    return rows.select("k", F.col("v").alias("v1"), F.lead("v").over(w).alias("v2"), F.lead("position").over(w).alias("more")).filter("more is not null").select("k", "v1", "v2").distinct()


def touches(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(index, k, first_v, last_v): how a transaction meets a key: the external read, else the write; the write, else the read."""
    r = reads.filter("type = 'ok'").select("index", "k", F.col("v").alias("rv"), F.lit(True).alias("r"))
    w = writes.filter("type in ('ok', 'info')").select("index", "k", F.col("v").alias("wv"), F.lit(True).alias("w"))
    return r.join(w, ["index", "k"], "full_outer").select("index", "k", F.when(F.col("r"), F.col("rv")).otherwise(F.col("wv")).alias("first_v"), F.when(F.col("w"), F.col("wv")).otherwise(F.col("rv")).alias("last_v"))


def sequential_versions(ops: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Version order from process order: a process' next committed transaction that touches a key."""
    oks = ops.filter("type = 'ok'").select("index", "process")
    w = Window.partitionBy("process", "k").orderBy("index")
    rows = touches(reads, writes).join(oks, "index")
    return rows.select("k", F.col("last_v").alias("v1"), F.lead("first_v").over(w).alias("v2"), F.lead("index").over(w).alias("more")).filter("more is not null and not v1 <=> v2").select("k", "v1", "v2").distinct()


def linearizable_versions(spans: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Version order from real time (O11, O12): for each key the reduced real-time order over its own transactions.

    ``spans``: inv, comp, type. The reduction per key has the same closure as the walk over the whole
    order that skips transactions which do not touch the key.
    """
    rows = touches(reads, writes).join(spans.select(F.col("comp").alias("index"), "inv", "type"), "index")
    edges = reduced_order(rows.select("k", "inv", F.col("index").alias("comp"), "type", "first_v", "last_v"), ["k"])
    return edges.filter("not a_last_v <=> b_first_v").select("k", F.col("a_last_v").alias("v1"), F.col("b_first_v").alias("v2")).distinct()


def reduced_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Real-time order within each key, reduced: a -> b if a (ok) ended before b began and no ok c fits between.

    ``rows``: keys, inv, comp, type and more columns; the result has keys, a_* and b_*. The next ok
    completion among those that begin after a bounds how far it looks, so the rows that follow a are
    neighbours in the order of their beginnings: a running count over each key gives the first and the last
    of them, and a join by number yields the pairs of the result and no others.
    """
    rows = pinned(rows)
    oks = rows.filter("type = 'ok'")
    after = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    none = F.lit(None).cast("long")
    marks = oks.select(*keys, F.col("inv").alias("at"), "comp", none.alias("a")).unionByName(oks.select(*keys, F.col("comp").alias("at"), none.alias("comp"), F.col("comp").alias("a")))
    bounds = marks.withColumn("bound", F.min("comp").over(after)).filter("a is not null").select(*keys, "a", F.coalesce("bound", F.lit((1 << 63) - 1)).alias("bound"))
    begun = rows.select(*keys, F.col("inv").alias("at"), F.lit(1).alias("one"), none.alias("lo_of"), none.alias("hi_of"))
    asked = bounds.select(*keys, F.col("a").alias("at"), F.lit(0).alias("one"), F.col("a").alias("lo_of"), none.alias("hi_of")).unionByName(bounds.select(*keys, F.col("bound").alias("at"), F.lit(0).alias("one"), none.alias("lo_of"), F.col("a").alias("hi_of")))
    counted = begun.unionByName(asked).withColumn("n", F.sum("one").over(Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))).filter("one = 0")
    spans = counted.groupBy(*keys, F.coalesce("lo_of", "hi_of").alias("a_comp")).agg(F.max(F.when(F.col("lo_of").isNotNull(), F.col("n"))).alias("lo"), F.max(F.when(F.col("hi_of").isNotNull(), F.col("n"))).alias("hi")).filter("hi > lo")
    others = [c for c in rows.columns if c not in keys]
    a = oks.select(*keys, *[F.col(c).alias(f"a_{c}") for c in others]).join(spans, [*keys, "a_comp"]).withColumn("rank", F.explode(F.sequence(F.col("lo") + 1, F.col("hi")))).drop("lo", "hi")
    b = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("inv")).cast("long")).select(*keys, "rank", *[F.col(c).alias(f"b_{c}") for c in others])
    return a.join(b, [*keys, "rank"]).drop("rank")


# predicates: versions (k, pos, state, v, writer, mop) ----------------------------------------------------


def state_versions(mops: DataFrame) -> DataFrame:
    """Each key's versions in history order (O15): unborn first unless init gives it; a later init starts over.

    state is unborn, live or dead.
    """
    changes = mops.filter("f in ('insert', 'w', 'delete', 'init') and type in ('ok', 'info')")
    last_init = changes.filter("f = 'init'").groupBy().agg(F.max("index").alias("init_at"))
    dead = F.col("f") == "delete"
    live = changes.crossJoin(last_init).filter("init_at is null or index >= init_at")  # one row on the right
    rows = live.select("k", F.col("index").alias("writer"), F.col("mop_idx").alias("mop"), F.when(dead, "dead").otherwise("live").alias("state"), F.when(~dead, F.col("v")).alias("v"), (F.col("f") == "init").alias("init"))
    given = rows.groupBy("k").agg(F.max("init").alias("given"))
    read = mops.filter("f = 'r' and k is not null").select("k").union(mops.filter("f = 'rp' and seen is not null").select(F.explode(F.map_keys("seen")).alias("k"))).distinct()
    keys = read.join(given, "k", "full_outer").filter("not coalesce(given, false)")
    unborn = keys.select("k", F.lit(None).cast("long").alias("writer"), F.lit(None).cast("int").alias("mop"), F.lit("unborn").alias("state"), F.lit(None).cast("long").alias("v"), F.lit(False).alias("init"))
    w = Window.partitionBy("k").orderBy(F.col("state") != "unborn", "writer", "mop")
    return rows.unionByName(unborn).withColumn("pos", F.row_number().over(w) - 1).select("k", "pos", "state", "v", "writer", "mop")


def navigated(versions: DataFrame) -> DataFrame:
    """Versions with the one before and after (O16); null where there is none."""
    w = Window.partitionBy("k").orderBy("pos")
    return versions.select("*", F.lag("pos").over(w).alias("before"), F.lead("pos").over(w).alias("after"))


def later_versions(versions: DataFrame) -> DataFrame:
    """(k, pos, later): all versions after one."""
    a, b = versions.select("k", "pos"), versions.select("k", F.col("pos").alias("later"))
    return a.join(b, "k").filter("later > pos")


def resolved_reads(reads: DataFrame, versions: DataFrame) -> DataFrame:
    """``reads`` (k, v, ...) with pos of the version read, null if unknown.

    A null read is the unborn version, or the dead one, if the key has one of these only.
    """
    nulls = versions.groupBy("k").agg(F.min(F.when(F.col("state") == "unborn", F.col("pos"))).alias("unborn"), F.min(F.when(F.col("state") == "dead", F.col("pos"))).alias("dead"), F.count(F.when(F.col("state") == "dead", 1)).alias("deaths"))
    live = versions.filter("state = 'live'").groupBy("k", "v").agg(F.min("pos").alias("live_pos"))
    at = F.when(F.col("v").isNotNull(), F.col("live_pos")).when(F.col("unborn").isNotNull() & (F.col("deaths") == 0), F.col("unborn")).when(F.col("unborn").isNull() & (F.col("deaths") == 1), F.col("dead"))
    return reads.join(nulls, "k", "left").join(live, ["k", "v"], "left").withColumn("pos", at).drop("unborn", "dead", "deaths", "live_pos")
