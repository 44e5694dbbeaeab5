"""Registered queries over the driver's tables, with their DuckDB equivalents.

Histories are derived from ``events`` (sources/synthetic.py). Lists are spelled as text in results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..functions.expressions import relation_names, spelled
from ..functions.ordered import pinned
from ..operators import detectors, edges, explain, generators, graph, render, txn, validate, versions
from ..operators import search as cycles
from ..sources import simulators, synthetic
from ..sources.history import distinct_keys, pair_index
from . import check

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, recursive: bool = False, history: bool = True, name: str | None = None):
    """Register a query; ``sql`` continues the common table expressions of the history."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            start = "WITH RECURSIVE " if recursive else "WITH "
            ORACLES[key] = start + synthetic.DUCK_CTES + (", " + sql if sql.lstrip()[:6].upper() != "SELECT" else sql) if history else sql
        return f

    return add


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.mops(spark, sf_dir)


def _registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.register_history(spark, sf_dir).mops


# sources and projections ------------------------------------------------------------------------------


@_query("SELECT index, process FROM ops WHERE type = 'ok'")
def ok_ops(spark, sf_dir):
    return synthetic.list_history(spark, sf_dir).oks().clients().ops.select("index", "process")


@_query("SELECT inv, CASE WHEN ctype <> 'invoke' THEN comp END AS comp, process, CASE WHEN ctype <> 'invoke' THEN ctype END AS type FROM (SELECT index AS inv, type, process, lead(index) OVER w AS comp, lead(type) OVER w AS ctype FROM ops WINDOW w AS (PARTITION BY process ORDER BY index)) WHERE type = 'invoke'", name="pair_index")
def pair_index_query(spark, sf_dir):
    return pair_index(synthetic.list_history(spark, sf_dir).ops)


@_query("SELECT index, type, process, mop_idx, f, k, v, array_to_string(vs, ',') AS vs FROM mops")
def explode_mops(spark, sf_dir):
    return _lists(spark, sf_dir).select("index", "type", "process", "mop_idx", "f", "k", "v", F.when(F.size("vs") > 0, spelled(F.col("vs"))).when(F.col("vs").isNotNull(), "").alias("vs"))


@_query("SELECT DISTINCT k FROM mops", name="distinct_keys")
def distinct_keys_query(spark, sf_dir):
    return distinct_keys(_lists(spark, sf_dir))


@_query("SELECT index, k, v FROM (SELECT index, k, arg_min(f, mop_idx) AS f, arg_min(coalesce(v, -1), mop_idx) AS v0 FROM reg GROUP BY 1, 2), LATERAL (SELECT nullif(v0, -1) AS v) WHERE f = 'r'")
def ext_reads(spark, sf_dir):
    return txn.ext_reads(_registers(spark, sf_dir)).select("index", "k", "v")


@_query("SELECT index, k, arg_max(v, mop_idx) AS v FROM reg WHERE f = 'w' GROUP BY 1, 2")
def ext_writes(spark, sf_dir):
    return txn.ext_writes(_registers(spark, sf_dir)).select("index", "k", "v")


_EXT = """
er AS (SELECT index, type, k, nullif(v0, -1) AS v FROM (SELECT index, type, k, arg_min(f, mop_idx) AS f, arg_min(coalesce(v, -1), mop_idx) AS v0 FROM reg GROUP BY 1, 2, 3) WHERE f = 'r'),
ew AS (SELECT index, type, k, arg_max(v, mop_idx) AS v FROM reg WHERE f = 'w' GROUP BY 1, 2, 3)
"""


@_query(_EXT + "SELECT k, v, count(*) AS n, min(index) AS first_index FROM er WHERE type = 'ok' GROUP BY 1, 2")
def ext_read_index(spark, sf_dir):
    return txn.ext_index(txn.ext_reads(_registers(spark, sf_dir)))


@_query(_EXT + "SELECT index, k FROM er WHERE type = 'ok' UNION SELECT index, k FROM ew WHERE type IN ('ok', 'info')")
def ext_keys(spark, sf_dir):
    return txn.ext_keys(_registers(spark, sf_dir))


@_query("SELECT k, v, max(index) AS writer FROM mops WHERE f = 'append' AND type = 'fail' GROUP BY 1, 2")
def failed_writes(spark, sf_dir):
    return txn.failed_writes(_lists(spark, sf_dir))


_INTER = "inter AS (SELECT k, v, max(index) AS writer FROM (SELECT *, lead(mop_idx) OVER (PARTITION BY index, k ORDER BY mop_idx) AS nxt FROM mops WHERE f = 'append') WHERE nxt IS NOT NULL GROUP BY 1, 2)"


@_query(_INTER + "SELECT * FROM inter")
def intermediate_writes(spark, sf_dir):
    return txn.intermediate_writes(_lists(spark, sf_dir))


@_query("SELECT index, f, k, v, min(mop_idx) AS mop_idx FROM mops GROUP BY 1, 2, 3, 4")
def mop_positions(spark, sf_dir):
    return txn.mop_positions(_lists(spark, sf_dir))


@_query("SELECT index, mop_idx, k, element, count(*) AS n FROM (SELECT index, mop_idx, k, unnest(vs) AS element FROM mops WHERE f = 'r') GROUP BY 1, 2, 3, 4")
def element_frequencies(spark, sf_dir):
    return txn.element_frequencies(_lists(spark, sf_dir))


# validation -------------------------------------------------------------------------------------------


@_query("SELECT k, v, count(*) AS n, min(index) AS index FROM mops WHERE type = 'invoke' AND f = 'append' GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_appends(spark, sf_dir):
    return validate.duplicate_appends(_lists(spark, sf_dir))


@_query("SELECT index, mop_idx, f, k FROM mops WHERE f NOT IN ('r', 'append')")
def unexpected_mops(spark, sf_dir):
    return validate.unexpected_mops(_lists(spark, sf_dir), ("r", "append"))


_VERSIONS = """
poss AS (SELECT * FROM mops WHERE type IN ('ok', 'info')),
best AS (SELECT k, arg_max(vs, (len(vs), vs)) AS vs FROM poss WHERE f = 'r' AND len(vs) > 0 GROUP BY k),
uniq AS (SELECT k, list_filter(vs, lambda x, i: list_position(vs, x) = i) AS vs FROM best),
lone AS (SELECT k, [max(v)] AS vs FROM poss WHERE f = 'append' AND k NOT IN (SELECT k FROM best) GROUP BY k HAVING count(*) = 1),
vers AS (SELECT k, CAST(unnest(range(len(vs))) AS INT) AS pos, unnest(vs) AS v FROM (SELECT * FROM uniq UNION ALL SELECT * FROM lone)),
writer AS (SELECT k, v, max(index) AS writer, arg_max(type, index) AS writer_type, arg_max(mop_idx, index) AS mop FROM poss WHERE f = 'append' GROUP BY 1, 2),
reader AS (SELECT k, CASE WHEN len(vs) > 0 THEN vs[-1] END AS v, index AS reader, mop_idx AS mop FROM mops WHERE f = 'r' AND (type = 'ok' OR type = 'info' AND vs IS NOT NULL)),
ord AS (SELECT k, v, lag(v) OVER (PARTITION BY k ORDER BY pos) AS before, true AS seen FROM vers),
tail AS (SELECT k, arg_max(v, pos) AS last FROM vers GROUP BY k),
prev AS (SELECT a.k, a.v, CASE WHEN seen THEN before ELSE last END AS prev, a.index, a.mop_idx
         FROM (SELECT * FROM poss WHERE f = 'append') a LEFT JOIN ord ON a.k = ord.k AND a.v = ord.v LEFT JOIN tail ON a.k = tail.k)
"""


@_query(_VERSIONS + "SELECT k, v FROM vers WHERE (k, v) NOT IN (SELECT (k, v) FROM poss WHERE f = 'append')")
def garbage_elements(spark, sf_dir):
    mops = _possible(spark, sf_dir)
    return validate.garbage_elements(versions.list_versions(mops), mops)


@_query(_EXT + "SELECT k, v, count(*) AS writers FROM ew WHERE type = 'ok' AND (k, v) IN (SELECT (k, v) FROM er WHERE type = 'ok' AND v IS NOT NULL) GROUP BY 1, 2 HAVING count(*) > 1")
def ambiguous_reads(spark, sf_dir):
    mops = _registers(spark, sf_dir)
    return validate.ambiguous_reads(txn.ext_reads(mops), txn.ext_writes(mops))


# detectors --------------------------------------------------------------------------------------------


def _possible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).filter("type in ('ok', 'info')")


_FAILED = "failed AS (SELECT k, v, max(index) AS writer FROM mops WHERE f = 'append' AND type = 'fail' GROUP BY 1, 2)"
_G1A = _FAILED + ", g1a AS (SELECT DISTINCT r.index, mop_idx, r.k, r.v, writer FROM (SELECT index, mop_idx, k, unnest(vs) AS v FROM mops WHERE type = 'ok' AND f = 'r') r JOIN failed USING (k, v))"


@_query(_G1A + "SELECT * FROM g1a")
def g1a_list(spark, sf_dir):
    return detectors.g1a_list(_lists(spark, sf_dir))


@_query("SELECT r.index, mop_idx, r.k, r.v, writer FROM reg r JOIN (SELECT k, v, max(index) AS writer FROM reg WHERE f = 'w' AND type = 'fail' GROUP BY 1, 2) USING (k, v) WHERE f = 'r' AND type = 'ok'")
def g1a_register(spark, sf_dir):
    return detectors.g1a_register(_registers(spark, sf_dir))


_G1B = _INTER + ", g1b AS (SELECT r.index, mop_idx, r.k, r.v, writer FROM (SELECT index, mop_idx, k, vs[-1] AS v FROM mops WHERE type = 'ok' AND f = 'r' AND len(vs) > 0) r JOIN inter USING (k, v) WHERE r.index <> writer)"


@_query(_G1B + "SELECT * FROM g1b")
def g1b_list(spark, sf_dir):
    return detectors.g1b_list(_lists(spark, sf_dir))


@_query("SELECT r.index, mop_idx, r.k, r.v, writer FROM reg r JOIN (SELECT k, v, max(index) AS writer FROM (SELECT *, lead(mop_idx) OVER (PARTITION BY index, k ORDER BY mop_idx) AS nxt FROM reg WHERE f = 'w') WHERE nxt IS NOT NULL GROUP BY 1, 2) USING (k, v) WHERE f = 'r' AND type = 'ok' AND r.index <> writer")
def g1b_register(spark, sf_dir):
    return detectors.g1b_register(_registers(spark, sf_dir))


_INTERNAL = """
own AS (SELECT r.index, r.mop_idx, r.k, r.vs, (SELECT max(mop_idx) FROM mops b WHERE b.index = r.index AND b.k = r.k AND b.f = 'r' AND b.mop_idx < r.mop_idx) AS lr
        FROM mops r WHERE r.type = 'ok' AND r.f = 'r'),
app AS (SELECT o.index, o.mop_idx, list(a.v ORDER BY a.mop_idx) AS vs FROM own o JOIN mops a ON a.index = o.index AND a.k = o.k AND a.f = 'append' AND a.mop_idx < o.mop_idx AND a.mop_idx > coalesce(o.lr, -1) GROUP BY 1, 2),
cmp AS (SELECT o.index, o.mop_idx, o.k, coalesce(o.vs, []) AS vs, o.lr IS NULL AS prefix_unknown, coalesce(p.vs, []) AS before, coalesce(app.vs, []) AS own
        FROM own o LEFT JOIN mops p ON p.index = o.index AND p.mop_idx = o.lr LEFT JOIN app ON app.index = o.index AND app.mop_idx = o.mop_idx),
viol AS (SELECT index, mop_idx, k, CASE WHEN prefix_unknown THEN own ELSE list_concat(before, own) END AS expected, prefix_unknown, vs FROM cmp
         WHERE CASE WHEN prefix_unknown THEN len(own) > 0 AND (len(vs) < len(own) OR vs[len(vs) - len(own) + 1:] <> own) ELSE list_concat(before, own) <> vs END),
internal AS (SELECT * FROM viol QUALIFY row_number() OVER (PARTITION BY index ORDER BY mop_idx) = 1)
"""


@_query(_INTERNAL + "SELECT index, mop_idx, k, prefix_unknown, array_to_string(expected, ',') AS expected, array_to_string(vs, ',') AS vs FROM internal")
def internal_list(spark, sf_dir):
    return detectors.internal_list(_lists(spark, sf_dir)).select("index", "mop_idx", "k", "prefix_unknown", spelled(F.col("expected")).alias("expected"), spelled(F.col("vs")).alias("vs"))


@_query("SELECT index, mop_idx, k, expected, v FROM (SELECT *, lag(v) OVER w AS expected, lag(mop_idx) OVER w AS earlier FROM reg WHERE type = 'ok' WINDOW w AS (PARTITION BY index, k ORDER BY mop_idx)) WHERE f = 'r' AND earlier IS NOT NULL AND v IS DISTINCT FROM expected QUALIFY row_number() OVER (PARTITION BY index ORDER BY mop_idx) = 1")
def internal_register(spark, sf_dir):
    return detectors.internal_register(_registers(spark, sf_dir))


_ORDER = """
lists AS (SELECT DISTINCT k, vs FROM mops WHERE type IN ('ok', 'info') AND f = 'r' AND len(vs) > 0),
adj AS (SELECT k, vs AS a, lead(vs) OVER (PARTITION BY k ORDER BY len(vs), vs) AS b FROM lists),
incompatible AS (SELECT k, a, b FROM adj WHERE b IS NOT NULL AND b[1:len(a)] <> a QUALIFY row_number() OVER (PARTITION BY k ORDER BY len(a), a) = 1)
"""


@_query(_ORDER + "SELECT k, array_to_string(a, ',') AS a, array_to_string(b, ',') AS b FROM incompatible")
def incompatible_order(spark, sf_dir):
    return detectors.incompatible_order(_possible(spark, sf_dir)).select("k", spelled(F.col("a")).alias("a"), spelled(F.col("b")).alias("b"))


@_query("SELECT index, mop_idx, k, element, count(*) AS n FROM (SELECT index, mop_idx, k, unnest(vs) AS element FROM mops WHERE type IN ('ok', 'info') AND f = 'r') GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")
def duplicate_elements(spark, sf_dir):
    return detectors.duplicate_elements(_lists(spark, sf_dir))


@_query("SELECT r.index, r.mop_idx, a.mop_idx AS append_at, r.k, r.v FROM (SELECT index, mop_idx, k, unnest(vs) AS v FROM mops WHERE type = 'ok' AND f = 'r') r JOIN mops a ON a.index = r.index AND a.k = r.k AND a.v = r.v AND a.f = 'append' AND r.mop_idx < a.mop_idx QUALIFY row_number() OVER (PARTITION BY r.index ORDER BY a.mop_idx, r.mop_idx) = 1")
def future_read(spark, sf_dir):
    return detectors.future_read(_lists(spark, sf_dir))


_DIRTY = """
allv AS (SELECT * FROM mops),
bestall AS (SELECT k, arg_max(vs, (len(vs), vs)) AS vs FROM allv WHERE f = 'r' AND len(vs) > 0 GROUP BY k),
loneall AS (SELECT k, [max(v)] AS vs FROM allv WHERE f = 'append' AND k NOT IN (SELECT k FROM bestall) GROUP BY k HAVING count(*) = 1),
versall AS (SELECT k, CAST(unnest(range(len(vs))) AS INT) AS pos, unnest(vs) AS v FROM (SELECT k, list_filter(vs, lambda x, i: list_position(vs, x) = i) AS vs FROM bestall UNION ALL SELECT * FROM loneall)),
wrote AS (SELECT k, v, max(index) AS writer, arg_max(type, index) AS t FROM mops WHERE f = 'append' AND type <> 'invoke' GROUP BY 1, 2),
walk AS (SELECT k, pos, v, writer, t, coalesce(max(CASE WHEN t = 'ok' THEN pos END) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last_ok FROM versall JOIN wrote USING (k, v)),
isl AS (SELECT *, min(CASE WHEN t = 'fail' THEN pos END) OVER (PARTITION BY k, last_ok) AS fail_pos FROM walk),
dirty AS (SELECT i.k, i.fail_pos, i.pos AS ok_pos, f.writer AS fail_writer, i.writer AS ok_writer FROM isl i JOIN walk f ON f.k = i.k AND f.pos = i.fail_pos WHERE i.t = 'ok' AND i.fail_pos < i.pos)
"""


@_query(_DIRTY + "SELECT k, fail_pos, ok_pos, fail_writer, ok_writer, (SELECT string_agg(w.v::VARCHAR, ',' ORDER BY w.pos) FROM walk w WHERE w.k = dirty.k AND w.pos BETWEEN fail_pos AND ok_pos) AS \"values\" FROM dirty")
def dirty_update(spark, sf_dir):
    return detectors.dirty_update(_lists(spark, sf_dir)).withColumn("values", spelled(F.col("values")))


_LOST = """
first_read AS (SELECT index, k, min(mop_idx) AS first_at, arg_min(array_to_string(coalesce(vs, []), ','), mop_idx) AS v FROM mops WHERE type = 'ok' AND f = 'r' GROUP BY 1, 2),
last_write AS (SELECT index, k, max(mop_idx) AS w FROM mops WHERE type = 'ok' AND f = 'append' GROUP BY 1, 2),
lost AS (SELECT k, v, count(*) AS n, min(index) AS first_txn, max(index) AS last_txn FROM first_read JOIN last_write USING (index, k) WHERE w > first_at GROUP BY 1, 2 HAVING count(*) >= 2)
"""


@_query(_LOST + "SELECT * FROM lost")
def lost_update(spark, sf_dir):
    return detectors.lost_update(_lists(spark, sf_dir), "array_join(transform(vs, x -> cast(x as string)), ',')")


@_query("SELECT k, v, count(*) AS n, min(index) AS first_txn, max(index) AS last_txn FROM (SELECT index, k, min(mop_idx) AS first_at, nullif(arg_min(coalesce(v, -1), mop_idx), -1) AS v FROM reg WHERE type = 'ok' AND f = 'r' GROUP BY 1, 2) JOIN (SELECT index, k, max(mop_idx) AS w FROM reg WHERE type = 'ok' AND f = 'w' GROUP BY 1, 2) USING (index, k) WHERE w > first_at GROUP BY 1, 2 HAVING count(*) >= 2")
def lost_update_register(spark, sf_dir):
    return detectors.lost_update(_registers(spark, sf_dir))


# version orders ---------------------------------------------------------------------------------------


@_query("SELECT DISTINCT k, array_to_string(vs, ',') AS vs FROM mops WHERE type IN ('ok', 'info') AND f = 'r' AND len(vs) > 0")
def observed_lists(spark, sf_dir):
    return versions.observed_lists(_possible(spark, sf_dir)).select("k", spelled(F.col("vs")).alias("vs"))


@_query("SELECT k, max(v) AS v FROM mops WHERE type IN ('ok', 'info') AND f = 'append' GROUP BY k HAVING count(*) = 1")
def single_appends(spark, sf_dir):
    return versions.single_appends(_possible(spark, sf_dir))


@_query(_VERSIONS + "SELECT k, pos, v FROM vers")
def version_order(spark, sf_dir):
    return versions.list_versions(_possible(spark, sf_dir))


@_query(_VERSIONS + "SELECT * FROM writer")
def write_index(spark, sf_dir):
    return versions.list_writers(_lists(spark, sf_dir))


@_query(_VERSIONS + "SELECT k, v, reader, mop FROM reader")
def read_index(spark, sf_dir):
    return versions.list_readers(_lists(spark, sf_dir))


@_query(_VERSIONS + "SELECT * FROM prev")
def previous_elements(spark, sf_dir):
    return versions.previous_elements(_possible(spark, sf_dir))


_INIT = "SELECT DISTINCT k, CAST(NULL AS BIGINT) AS v1, v AS v2 FROM (SELECT k, v FROM er WHERE type = 'ok' UNION ALL SELECT k, v FROM ew WHERE type IN ('ok', 'info')) WHERE v IS NOT NULL"
_WFR = "SELECT DISTINCT er.k, er.v AS v1, ew.v AS v2 FROM er JOIN ew ON er.index = ew.index AND er.k = ew.k WHERE er.type = 'ok' AND ew.v IS NOT NULL"


def _external(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    mops = _registers(spark, sf_dir)
    return txn.ext_reads(mops), txn.ext_writes(mops)


@_query(_EXT + _INIT)
def init_versions(spark, sf_dir):
    return versions.initial_versions(*_external(spark, sf_dir))


@_query(_EXT + _WFR)
def wfr_versions(spark, sf_dir):
    return versions.wfr_versions(*_external(spark, sf_dir))


_TOUCH = """, touch AS (
  SELECT coalesce(r.index, w.index) AS index, coalesce(r.k, w.k) AS k, CASE WHEN r.index IS NOT NULL THEN r.v ELSE w.v END AS first_v, CASE WHEN w.index IS NOT NULL THEN w.v ELSE r.v END AS last_v
  FROM (SELECT * FROM er WHERE type = 'ok') r FULL JOIN (SELECT * FROM ew WHERE type IN ('ok', 'info')) w ON r.index = w.index AND r.k = w.k)
"""


@_query(_EXT + _TOUCH + "SELECT DISTINCT k, last_v AS v1, nv AS v2 FROM (SELECT t.k, last_v, lead(first_v) OVER w AS nv, lead(t.index) OVER w AS more FROM touch t JOIN ops o ON o.index = t.index AND o.type = 'ok' WINDOW w AS (PARTITION BY process, t.k ORDER BY t.index)) WHERE more IS NOT NULL AND last_v IS DISTINCT FROM nv")
def sequential_versions(spark, sf_dir):
    return versions.sequential_versions(synthetic.register_history(spark, sf_dir).ops, *_external(spark, sf_dir))


_SPANS = ", spans AS (SELECT DISTINCT inv, index AS comp, type FROM mops WHERE type <> 'invoke')"


@_query(_EXT + _TOUCH + _SPANS + ", kt AS (SELECT t.*, inv, type FROM touch t JOIN spans ON comp = t.index) SELECT DISTINCT a.k, a.last_v AS v1, b.first_v AS v2 FROM kt a JOIN kt b ON a.k = b.k AND a.type = 'ok' AND a.index < b.inv AND a.last_v IS DISTINCT FROM b.first_v WHERE NOT EXISTS (SELECT 1 FROM kt c WHERE c.k = a.k AND c.type = 'ok' AND a.index < c.inv AND c.index < b.inv)")
def linearizable_versions(spark, sf_dir):
    h = synthetic.register_history(spark, sf_dir)
    return versions.linearizable_versions(pair_index(h.ops), *_external(spark, sf_dir))


@_query(_EXT + "SELECT DISTINCT k, v AS v1, nv AS v2 FROM (SELECT k, v, lead(v) OVER w AS nv, lead(index) OVER w AS more FROM ew WHERE type IN ('ok', 'info') WINDOW w AS (PARTITION BY k ORDER BY index)) WHERE more IS NOT NULL")
def ordered_versions(spark, sf_dir):
    """The given order of transactions is the order of their completions."""
    order = synthetic.register_history(spark, sf_dir).possible().ops.select("index", F.col("index").alias("position"))
    return versions.ordered_versions(_external(spark, sf_dir)[1], order)


# edges ------------------------------------------------------------------------------------------------


def _pairs(facts: DataFrame) -> DataFrame:
    return facts.select("src", "dst", "k", "v1", "v2", "a_mop", "b_mop")


_WW = "ww AS (SELECT w.writer AS src, p.index AS dst, p.k, p.prev AS v1, p.v AS v2, w.mop AS a_mop, p.mop_idx AS b_mop FROM prev p JOIN writer w ON w.k = p.k AND w.v = p.prev WHERE w.writer <> p.index)"
_WR = "wr AS (SELECT w.writer AS src, r.reader AS dst, r.k, r.v AS v1, CAST(NULL AS BIGINT) AS v2, w.mop AS a_mop, r.mop AS b_mop FROM reader r JOIN writer w ON w.k = r.k AND w.v = r.v WHERE w.writer <> r.reader)"
_RW = "rw AS (SELECT r.reader AS src, p.index AS dst, p.k, p.prev AS v1, p.v AS v2, r.mop AS a_mop, p.mop_idx AS b_mop FROM prev p JOIN reader r ON r.k = p.k AND r.v IS NOT DISTINCT FROM p.prev WHERE r.reader <> p.index)"
_LIST_EDGES = f"{_VERSIONS}, {_WW}, {_WR}, {_RW}, edges AS (SELECT src, dst, CAST(bit_or(rel) AS INT) AS rels FROM (SELECT src, dst, 1 AS rel FROM ww UNION ALL SELECT src, dst, 2 FROM wr UNION ALL SELECT src, dst, 4 FROM rw) GROUP BY 1, 2)\n"


@_query(f"{_VERSIONS}, {_WW} SELECT * FROM ww")
def list_ww(spark, sf_dir):
    return _pairs(edges.list_ww(_possible(spark, sf_dir)))


@_query(f"{_VERSIONS}, {_WR} SELECT * FROM wr")
def list_wr(spark, sf_dir):
    return _pairs(edges.list_wr(_possible(spark, sf_dir)))


@_query(f"{_VERSIONS}, {_RW} SELECT * FROM rw")
def list_rw(spark, sf_dir):
    return _pairs(edges.list_rw(_possible(spark, sf_dir)))


def _list_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.edge_union(edges.list_facts(_possible(spark, sf_dir)))


@_query(_LIST_EDGES + "SELECT src, dst, rels, concat_ws(',', CASE WHEN rels & 1 <> 0 THEN 'ww' END, CASE WHEN rels & 2 <> 0 THEN 'wr' END, CASE WHEN rels & 4 <> 0 THEN 'rw' END) AS names FROM edges")
def edge_union(spark, sf_dir):
    return _list_edges(spark, sf_dir).withColumn("names", relation_names(F.col("rels")))


_REG_VERSIONS = f", rv AS ({_INIT} UNION {_WFR})"


def _register_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    reads, writes = _external(spark, sf_dir)
    return versions.initial_versions(reads, writes).union(versions.wfr_versions(reads, writes)).distinct(), reads, writes


@_query(_EXT + "SELECT w.src, r.index AS dst, r.k, r.v AS v1 FROM (SELECT k, v, min(index) AS src FROM ew WHERE type = 'ok' GROUP BY 1, 2 HAVING count(*) = 1) w JOIN er r ON r.k = w.k AND r.v = w.v AND r.type = 'ok' WHERE src <> r.index")
def register_wr(spark, sf_dir):
    return edges.register_wr(*_external(spark, sf_dir)).select("src", "dst", "k", "v1")


@_query(_EXT + _REG_VERSIONS + "SELECT a.index AS src, b.index AS dst, rv.k, v1, v2 FROM rv JOIN ew a ON a.k = rv.k AND a.v = v1 AND a.type = 'ok' JOIN ew b ON b.k = rv.k AND b.v = v2 AND b.type = 'ok' WHERE a.index <> b.index")
def register_ww(spark, sf_dir):
    order, _, writes = _register_versions(spark, sf_dir)
    return edges.register_ww(order, writes).select("src", "dst", "k", "v1", "v2")


@_query(_EXT + _REG_VERSIONS + "SELECT a.index AS src, b.index AS dst, rv.k, v1, v2 FROM rv JOIN er a ON a.k = rv.k AND a.v IS NOT DISTINCT FROM v1 AND a.type = 'ok' JOIN ew b ON b.k = rv.k AND b.v = v2 AND b.type = 'ok' WHERE a.index <> b.index")
def register_rw(spark, sf_dir):
    return edges.register_rw(*_register_versions(spark, sf_dir)).select("src", "dst", "k", "v1", "v2")


@_query("SELECT src, dst FROM (SELECT index AS src, lead(index) OVER (PARTITION BY process ORDER BY index) AS dst FROM ops WHERE type = 'ok') WHERE dst IS NOT NULL")
def process_edges(spark, sf_dir):
    return edges.process_facts(synthetic.list_history(spark, sf_dir).ops).select("src", "dst")


@_query("spans AS (SELECT DISTINCT inv, index AS comp, type FROM mops WHERE type <> 'invoke'), m AS (SELECT a.comp AS a, min(c.comp) AS bound FROM (SELECT * FROM spans WHERE type = 'ok') a LEFT JOIN (SELECT * FROM spans WHERE type = 'ok') c ON c.inv > a.comp GROUP BY 1) SELECT a AS src, b.comp AS dst FROM m JOIN spans b ON a < b.inv AND (bound IS NULL OR b.inv < bound)")
def realtime_edges(spark, sf_dir):
    return edges.realtime_facts(pair_index(synthetic.list_history(spark, sf_dir).ops)).select("src", "dst")


_MONO = "SELECT a.turn_id AS src, b.turn_id AS dst, CAST(a.conv_id AS VARCHAR) AS k, a.turn AS v1, b.turn AS v2 FROM r a JOIN r b ON a.conv_id = b.conv_id AND b.rank = a.rank + 1"


@_query("WITH r AS (SELECT DISTINCT conv_id, turn, conv_id * 1000 + turn AS turn_id, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations) " + _MONO, history=False)
def monotonic_edges(spark, sf_dir):
    """Turns of a conversation as observations of a growing key."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("index"), F.col("conv_id").cast("string").alias("k"), F.col("turn").alias("v"))
    return edges.monotonic_facts(rows).select("src", "dst", "k", "v1", "v2")


# predicates -------------------------------------------------------------------------------------------

_PSTATES = synthetic.DUCK_PREDICATE_CTES + """,
pch AS (SELECT k, index AS writer, mop_idx AS mop, CASE WHEN f = 'delete' THEN 'dead' ELSE 'live' END AS state, CASE WHEN f <> 'delete' THEN v END AS v, f = 'init' AS given FROM pmops WHERE f IN ('insert', 'w', 'delete', 'init') AND type IN ('ok', 'info')),
pall AS (SELECT k FROM pmops WHERE f = 'r' UNION SELECT k FROM pseen UNION SELECT k FROM pch),
pv AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY state <> 'unborn', writer, mop) - 1 AS INT) AS pos, state, v, writer, mop FROM (
  SELECT k, state, v, writer, mop FROM pch
  UNION ALL SELECT k, 'unborn', NULL, NULL, NULL FROM pall WHERE k NOT IN (SELECT k FROM pch WHERE given))),
pnull AS (SELECT k, min(CASE WHEN state = 'unborn' THEN pos END) AS unborn, min(CASE WHEN state = 'dead' THEN pos END) AS dead, count(CASE WHEN state = 'dead' THEN 1 END) AS deaths FROM pv GROUP BY 1),
plive AS (SELECT k, v, min(pos) AS pos FROM pv WHERE state = 'live' GROUP BY 1, 2),
pread AS (SELECT m.k, m.v, index, mop_idx, CASE WHEN m.v IS NOT NULL THEN plive.pos WHEN unborn IS NOT NULL AND deaths = 0 THEN unborn WHEN unborn IS NULL AND deaths = 1 THEN dead END AS pos
          FROM pmops m LEFT JOIN pnull ON m.k = pnull.k LEFT JOIN plive ON plive.k = m.k AND plive.v = m.v WHERE f = 'r' AND type = 'ok'),
pmiss AS (SELECT k, count(*) FILTER (NOT (state = 'live' AND v % 2 = 0)) AS n, max(pos) FILTER (NOT (state = 'live' AND v % 2 = 0)) AS miss, max(pos) FILTER (state = 'unborn') AS unborn FROM pv GROUP BY 1),
pvset AS (
  SELECT s.index, s.mop_idx, s.k, plive.pos FROM pseen s JOIN pmops p ON p.index = s.index AND p.mop_idx = s.mop_idx AND p.type = 'ok' AND p.f = 'rp' JOIN plive ON plive.k = s.k AND plive.v = s.v
  UNION ALL
  SELECT p.index, p.mop_idx, m.k, CASE WHEN n = 1 THEN miss ELSE unborn END AS pos FROM pmops p, pmiss m
  WHERE p.f = 'rp' AND p.type = 'ok' AND n <= 1 AND (n = 1 OR unborn IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM pseen s WHERE s.index = p.index AND s.mop_idx = p.mop_idx AND s.k = m.k))
"""


def _predicate(sql: str):
    return _query("WITH " + _PSTATES + sql, history=False)


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    mops = synthetic.predicate_history(spark, sf_dir).mops
    return mops, pinned(versions.state_versions(mops))


@_predicate("SELECT index, type, process, mop_idx, f, k, v FROM pmops")
def predicate_mops(spark, sf_dir):
    return synthetic.predicate_history(spark, sf_dir).mops.select("index", "type", "process", "mop_idx", "f", "k", "v")


@_predicate("SELECT * FROM pv")
def state_versions(spark, sf_dir):
    return _states(spark, sf_dir)[1]


@_predicate("SELECT *, lag(pos) OVER w AS before, lead(pos) OVER w AS after FROM pv WINDOW w AS (PARTITION BY k ORDER BY pos)")
def version_navigation(spark, sf_dir):
    return versions.navigated(_states(spark, sf_dir)[1])


@_predicate("SELECT a.k, a.pos, b.pos AS later FROM pv a JOIN pv b ON a.k = b.k AND b.pos > a.pos")
def later_versions(spark, sf_dir):
    return versions.later_versions(_states(spark, sf_dir)[1])


@_predicate("SELECT * FROM pread")
def resolved_reads(spark, sf_dir):
    return edges.item_reads(*_states(spark, sf_dir))


@_predicate("SELECT index, type, k, arg_max(CASE WHEN f = 'delete' THEN 'dead' ELSE 'live' END, mop_idx) AS state, nullif(arg_max(CASE WHEN f = 'delete' THEN -1 ELSE v END, mop_idx), -1) AS v FROM pmops WHERE f IN ('insert', 'w', 'delete', 'init') GROUP BY 1, 2, 3")
def ext_state_writes(spark, sf_dir):
    return txn.ext_state_writes(synthetic.predicate_history(spark, sf_dir).mops)


@_predicate("SELECT k, v, count(*) AS n FROM (SELECT index, k, v FROM pmops WHERE f IN ('insert', 'w', 'init') AND type IN ('ok', 'info')) GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_state_writes(spark, sf_dir):
    return validate.repeated_state_writes(txn.ext_state_writes(synthetic.predicate_history(spark, sf_dir).mops))


@_predicate("SELECT index, mop_idx, k, pos FROM pvset")
def pred_vset(spark, sf_dir):
    return edges.version_sets(*_states(spark, sf_dir)).select("index", "mop_idx", "k", "pos")


@_predicate("SELECT a.writer AS src, b.writer AS dst, b.k, a.v AS v1, b.v AS v2 FROM pv b JOIN pv a ON a.k = b.k AND a.pos = b.pos - 1 JOIN pmops m ON m.index = b.writer AND m.mop_idx = b.mop AND m.k = b.k AND m.f IN ('insert', 'delete') WHERE a.writer IS NOT NULL AND a.writer <> b.writer")
def pred_ww(spark, sf_dir):
    return edges.predicate_ww(*_states(spark, sf_dir)).select("src", "dst", "k", "v1", "v2")


@_predicate("SELECT w.writer AS src, r.index AS dst, r.k, w.v AS v1 FROM pread r JOIN pv w ON w.k = r.k AND w.pos = r.pos WHERE w.writer IS NOT NULL AND w.writer <> r.index")
def pred_wr(spark, sf_dir):
    return edges.predicate_wr(*_states(spark, sf_dir)).select("src", "dst", "k", "v1")


@_predicate("SELECT w.writer AS src, r.index AS dst, r.k, w.v AS v1, r.mop_idx AS b_mop FROM pvset r JOIN pv w ON w.k = r.k AND w.pos = r.pos WHERE w.writer IS NOT NULL AND w.writer <> r.index")
def pred_wrp(spark, sf_dir):
    mops, states = _states(spark, sf_dir)
    return edges.predicate_wrp(states, edges.predicate_sets(mops, states)).select("src", "dst", "k", "v1", "b_mop")


@_predicate("SELECT r.index AS src, w.writer AS dst, r.k, r.v AS v1, w.v AS v2 FROM pread r JOIN pv w ON w.k = r.k AND w.pos = r.pos + 1 WHERE w.writer <> r.index")
def pred_rw(spark, sf_dir):
    return edges.predicate_rw(*_states(spark, sf_dir)).select("src", "dst", "k", "v1", "v2")


@_predicate("SELECT r.index AS src, w.writer AS dst, r.k, o.v AS v1, w.v AS v2, r.mop_idx AS a_mop FROM pvset r JOIN pv o ON o.k = r.k AND o.pos = r.pos JOIN pv w ON w.k = r.k AND w.pos > r.pos AND w.writer IS NOT NULL WHERE w.writer <> r.index AND (coalesce(w.state = 'live' AND w.v % 2 = 0, false)) <> (coalesce(o.state = 'live' AND o.v % 2 = 0, false))")
def pred_rwp(spark, sf_dir):
    mops, states = _states(spark, sf_dir)
    return edges.predicate_rwp(states, edges.predicate_sets(mops, states)).select("src", "dst", "k", "v1", "v2", "a_mop")


@_predicate("SELECT p.index, p.mop_idx, a.k FROM pmops p, (SELECT k FROM pv GROUP BY 1 HAVING bool_and(coalesce(state = 'live' AND v % 2 = 0, false))) a WHERE p.f = 'rp' AND p.type = 'ok' AND NOT EXISTS (SELECT 1 FROM pseen s WHERE s.index = p.index AND s.mop_idx = p.mop_idx AND s.k = a.k)")
def pred_read_miss(spark, sf_dir):
    return detectors.predicate_read_miss(*_states(spark, sf_dir))


@_query()
def predicate_check_summary(spark, sf_dir):
    """The whole closed-predicate check."""
    result = check.check_closed_predicate(synthetic.predicate_history(spark, sf_dir), ["serializable"])
    return result.summary()


@_query(_EXT + _REG_VERSIONS + ", c AS (SELECT k, v1 AS a, v2 AS b FROM rv WHERE v1 IS NOT NULL), r AS (SELECT k, a, b FROM c UNION SELECT r.k, r.a, c.b FROM r JOIN c ON r.k = c.k AND r.b = c.a) SELECT k, min(a) AS first, count(*) AS n FROM (SELECT DISTINCT k, a FROM r WHERE a = b) GROUP BY k, a HAVING count(*) > 1", recursive=True)
def cyclic_versions(spark, sf_dir):
    """Values that come before themselves under initial state and writes-follow-reads."""
    order, _, _ = _register_versions(spark, sf_dir)
    return check.cyclic_versions(order).select("k", "first", "n")


# graphs -----------------------------------------------------------------------------------------------


@_query(_LIST_EDGES + "SELECT src, dst, CAST(rels & 3 AS INT) AS rels FROM edges WHERE rels & 3 <> 0")
def project_relations(spark, sf_dir):
    return graph.project(_list_edges(spark, sf_dir), 3)


@_query(_LIST_EDGES + ", d AS (SELECT src, dst, CAST(rels & 3 AS INT) AS rels FROM edges WHERE rels & 3 <> 0), w AS (SELECT src, dst FROM edges WHERE rels & 4 <> 0) SELECT src, dst, CAST(bit_or(rels) AS INT) AS rels FROM (SELECT * FROM d UNION ALL SELECT d.src, w.dst, 0 FROM d JOIN w ON d.dst = w.src) GROUP BY 1, 2")
def seq_extension(spark, sf_dir):
    pairs = pinned(_list_edges(spark, sf_dir))
    return graph.extension(graph.project(pairs, 3), graph.project(pairs, 4))


@_query(_LIST_EDGES + "SELECT CAST(floor(src / 100.0) AS BIGINT) AS src, CAST(floor(dst / 100.0) AS BIGINT) AS dst, CAST(bit_or(rels) AS INT) AS rels FROM edges GROUP BY 1, 2")
def map_vertices(spark, sf_dir):
    """Transactions gathered by hundreds of positions."""
    pairs = pinned(_list_edges(spark, sf_dir))
    return graph.map_vertices(pairs, graph.vertices(pairs).withColumn("to", F.floor(F.col("vertex") / 100)))


_ISLANDS = _LIST_EDGES + """, back AS (SELECT dst AS lo, max(src) AS hi FROM edges WHERE dst < src GROUP BY 1),
reach AS (SELECT *, max(hi) OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM back),
grp AS (SELECT *, max(CASE WHEN before IS NULL OR lo > before THEN lo END) OVER (ORDER BY lo) AS island FROM reach),
islands AS (SELECT island AS lo, max(hi) AS hi FROM grp GROUP BY 1)
"""


@_query(_ISLANDS + "SELECT * FROM islands")
def backward_islands(spark, sf_dir):
    return graph.backward_islands(pinned(_list_edges(spark, sf_dir)))


_REACH = _ISLANDS + """, inside AS (SELECT src, dst FROM edges JOIN islands ON least(src, dst) >= lo AND greatest(src, dst) <= hi),
reaches AS (SELECT src, dst FROM inside UNION SELECT r.src, i.dst FROM reaches r JOIN inside i ON r.dst = i.src),
members AS (SELECT a.src AS vertex, min(least(a.src, a.dst)) AS scc FROM reaches a JOIN reaches b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY 1)
"""


@_query(_REACH + "SELECT * FROM members", recursive=True)
def scc_members(spark, sf_dir):
    return graph.components(_list_edges(spark, sf_dir))


@_query(_REACH + "SELECT * FROM members", recursive=True)
def scc_members_by_islands(spark, sf_dir):
    """Islands of over 200 edges take the way of those beyond one task."""
    return graph.components(_list_edges(spark, sf_dir), island_edges=200)


@_query(_REACH + "SELECT * FROM members", recursive=True)
def scc_members_by_colour(spark, sf_dir):
    """Islands beyond one task, whatever the size: components by joins alone."""
    pairs = pinned(_list_edges(spark, sf_dir))
    return graph.coloured(graph.in_islands(pairs, graph.backward_islands(pairs)))


@_query(_LIST_EDGES + ", start AS (SELECT min(src) AS vertex FROM edges), reached AS (SELECT vertex FROM start UNION SELECT dst FROM reached JOIN edges ON src = vertex) SELECT vertex FROM reached", recursive=True)
def reachable(spark, sf_dir):
    """What the first transaction reaches."""
    pairs = pinned(_list_edges(spark, sf_dir))
    start = pairs.agg(F.min("src").alias("vertex"))
    return graph.reachable(pairs, start)


_REGISTER_WR = "SELECT w.src, r.index AS dst FROM (SELECT k, v, min(index) AS src FROM ew WHERE type = 'ok' GROUP BY 1, 2 HAVING count(*) = 1) w JOIN er r ON r.k = w.k AND r.v = w.v AND r.type = 'ok' WHERE src <> r.index"
_REGISTER_WW = "SELECT a.index AS src, b.index AS dst FROM rv JOIN ew a ON a.k = rv.k AND a.v = v1 AND a.type = 'ok' JOIN ew b ON b.k = rv.k AND b.v = v2 AND b.type = 'ok' WHERE a.index <> b.index"
_REGISTER_RW = "SELECT a.index AS src, b.index AS dst FROM rv JOIN er a ON a.k = rv.k AND a.v IS NOT DISTINCT FROM v1 AND a.type = 'ok' JOIN ew b ON b.k = rv.k AND b.v = v2 AND b.type = 'ok' WHERE a.index <> b.index"


def _folded(*parts: tuple[str, int]) -> str:
    return "SELECT src, dst, CAST(bit_or(rel) AS INT) AS rels FROM (" + " UNION ALL ".join(f"SELECT src, dst, {bit} AS rel FROM ({sql})" for sql, bit in parts) + ") GROUP BY 1, 2"


@_query(_EXT + _REG_VERSIONS + _folded((_REGISTER_WW, 1), (_REGISTER_WR, 2), (_REGISTER_RW, 4)))
def register_edges(spark, sf_dir):
    """All edges of the register history as one graph."""
    order, reads, writes = _register_versions(spark, sf_dir)
    return edges.edge_union(edges.union(edges.register_wr(reads, writes), edges.register_ww(order, writes), edges.register_rw(order, reads, writes)))


_PREDICATE_PARTS = (
    ("SELECT a.writer AS src, b.writer AS dst FROM pv b JOIN pv a ON a.k = b.k AND a.pos = b.pos - 1 JOIN pmops m ON m.index = b.writer AND m.mop_idx = b.mop AND m.k = b.k AND m.f IN ('insert', 'delete') WHERE a.writer IS NOT NULL AND a.writer <> b.writer", 1),
    ("SELECT w.writer AS src, r.index AS dst FROM pread r JOIN pv w ON w.k = r.k AND w.pos = r.pos WHERE w.writer IS NOT NULL AND w.writer <> r.index", 2),
    ("SELECT r.index AS src, w.writer AS dst FROM pread r JOIN pv w ON w.k = r.k AND w.pos = r.pos + 1 WHERE w.writer <> r.index", 4),
    ("SELECT w.writer AS src, r.index AS dst FROM pvset r JOIN pv w ON w.k = r.k AND w.pos = r.pos WHERE w.writer IS NOT NULL AND w.writer <> r.index", 16),
    ("SELECT r.index AS src, w.writer AS dst FROM pvset r JOIN pv o ON o.k = r.k AND o.pos = r.pos JOIN pv w ON w.k = r.k AND w.pos > r.pos AND w.writer IS NOT NULL WHERE w.writer <> r.index AND (coalesce(w.state = 'live' AND w.v % 2 = 0, false)) <> (coalesce(o.state = 'live' AND o.v % 2 = 0, false))", 32),
)


@_predicate(_folded(*_PREDICATE_PARTS))
def predicate_edges(spark, sf_dir):
    """All edges of the predicate history as one graph."""
    mops, states = _states(spark, sf_dir)
    return edges.edge_union(edges.predicate_facts(mops, states, edges.predicate_sets(mops, states)))


_PROCESS = "SELECT src, dst FROM (SELECT index AS src, lead(index) OVER (PARTITION BY process ORDER BY index) AS dst FROM ops WHERE type = 'ok') WHERE dst IS NOT NULL"
_REALTIME = "SELECT a AS src, b.comp AS dst FROM bounded JOIN spans b ON a < b.inv AND (bound IS NULL OR b.inv < bound)"
_BOUNDED = ", spans AS (SELECT DISTINCT inv, index AS comp, type FROM mops WHERE type <> 'invoke'), bounded AS (SELECT a.comp AS a, min(c.comp) AS bound FROM (SELECT * FROM spans WHERE type = 'ok') a LEFT JOIN (SELECT * FROM spans WHERE type = 'ok') c ON c.inv > a.comp GROUP BY 1) "


@_query(_LIST_EDGES + _BOUNDED + "SELECT src, dst, CAST(bit_or(rel) AS INT) AS rels FROM (SELECT src, dst, rels AS rel FROM edges UNION ALL SELECT src, dst, 64 FROM (" + _PROCESS + ") UNION ALL SELECT src, dst, 128 FROM (" + _REALTIME + ")) GROUP BY 1, 2")
def combined_edges(spark, sf_dir):
    """Three analyzers as one: lists, processes and real time."""
    lists = lambda h: check.Analysis(edges.list_facts(h.possible().mops))
    both = check.combine(lists, check.process_analyzer, check.realtime_analyzer)
    return edges.edge_union(both(synthetic.list_history(spark, sf_dir)).facts)


@_query(_LIST_EDGES + "SELECT * FROM edges WHERE NOT (src % 2 = 0 AND rels = 4)")
def unlinked(spark, sf_dir):
    pairs = pinned(_list_edges(spark, sf_dir))
    return graph.unlink(pairs, pairs.filter("src % 2 = 0 and rels = 4"))


@_query(_LIST_EDGES + "SELECT * FROM (SELECT CAST(floor(src / 100.0) AS BIGINT) AS src, CAST(floor(dst / 100.0) AS BIGINT) AS dst, CAST(bit_or(rels) AS INT) AS rels FROM edges GROUP BY 1, 2) WHERE src <> dst")
def without_self_edges(spark, sf_dir):
    pairs = pinned(_list_edges(spark, sf_dir))
    return graph.without_self_edges(graph.map_vertices(pairs, graph.vertices(pairs).withColumn("to", F.floor(F.col("vertex") / 100))))


@_query(_LIST_EDGES + "SELECT src, dst, rels, 'out' AS side FROM edges WHERE src % 3 = 0 UNION ALL SELECT src, dst, rels, 'in' FROM edges WHERE dst % 3 = 0")
def ways_in_and_out(spark, sf_dir):
    pairs = pinned(_list_edges(spark, sf_dir))
    some = graph.vertices(pairs).filter("vertex % 3 = 0")
    return graph.out_of(pairs, some).withColumn("side", F.lit("out")).unionByName(graph.into(pairs, some).withColumn("side", F.lit("in")))


@_query(_LIST_EDGES + "SELECT * FROM edges WHERE src % 2 = 0 AND dst % 2 = 0")
def induced(spark, sf_dir):
    pairs = pinned(_list_edges(spark, sf_dir))
    return graph.induced(pairs, graph.vertices(pairs).filter("vertex % 2 = 0"))


@_query(_LIST_EDGES + ", more AS (SELECT src, dst, rels FROM edges UNION ALL SELECT -1, src, 64 FROM edges WHERE src % 3 = 0 UNION ALL SELECT src, -2, 128 FROM edges WHERE src % 3 = 0) SELECT src, dst, CAST(bit_or(rels) AS INT) AS rels FROM more GROUP BY 1, 2")
def linked(spark, sf_dir):
    """With one vertex before, and one after, some others."""
    pairs = pinned(_list_edges(spark, sf_dir))
    some = pairs.filter("src % 3 = 0").select(F.col("src").alias("vertex"))
    return graph.link_all_to(graph.link_to_all(pairs, -1, some, 64), some, -2, 128)


@_query(_LIST_EDGES + ", open_ AS (SELECT src, dst FROM edges WHERE src % 2 = 0 UNION SELECT o.src, e.dst FROM open_ o JOIN edges e ON e.src = o.dst WHERE o.dst % 2 <> 0) SELECT src, dst FROM open_ WHERE dst % 2 = 0", recursive=True)
def collapsed(spark, sf_dir):
    """Only vertices at even positions, linked through the others."""
    pairs = pinned(_list_edges(spark, sf_dir))
    return graph.collapse(pairs, graph.vertices(pairs).filter("vertex % 2 = 0"))


@_query(_LIST_EDGES + "SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS dsts FROM edges GROUP BY 1")
def adjacency(spark, sf_dir):
    return graph.adjacency(_list_edges(spark, sf_dir)).select("src", spelled(F.col("dsts")).alias("dsts"))


_TEXTS = _LIST_EDGES + """, fact AS (SELECT *, 1 AS place FROM ww UNION ALL SELECT *, 2 FROM wr UNION ALL SELECT *, 3 FROM rw),
pair AS (SELECT a.src, a.dst FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst),
step AS (SELECT src AS one, dst AS two, 0 AS n, src, dst, 'T1' AS a, 'T2' AS b FROM pair UNION ALL SELECT src, dst, 1, dst, src, 'T2', 'T1' FROM pair),
reason AS (SELECT s.*, f.place, f.k, f.v1, f.v2 FROM step s JOIN fact f ON f.src = s.src AND f.dst = s.dst QUALIFY row_number() OVER (PARTITION BY one, two, n ORDER BY place, a_mop NULLS LAST, b_mop, f.k, f.v1 NULLS FIRST, f.v2 NULLS FIRST) = 1),
told AS (SELECT *, CASE place WHEN 1 THEN b || ' appended ' || v2 || ' after ' || a || ' appended ' || coalesce(v1::VARCHAR, 'the initial state') || ' to ' || k
  WHEN 2 THEN b || ' saw what ' || a || ' wrote: ' || coalesce(v1::VARCHAR, 'the initial state') || ' of key ' || k
  ELSE a || ' read ' || coalesce(v1::VARCHAR, 'the initial state') || ' of key ' || k || ', and did not see the write of ' || coalesce(v2::VARCHAR, 'its removal') || ' by ' || b END AS why FROM reason)
SELECT x.one AS src, x.two AS dst, 'Let:' || chr(10) || '  T1 = op ' || x.one || chr(10) || '  T2 = op ' || x.two || chr(10) || chr(10) || 'Then:' || chr(10) || '  - T1 < T2, because ' || x.why || '.' || chr(10) || '  - However, T2 < T1, because ' || y.why || ': a contradiction!' AS text
FROM told x JOIN told y ON x.one = y.one AND x.two = y.two AND x.n = 0 AND y.n = 1
"""


@_query(_TEXTS)
def two_cycle_texts(spark, sf_dir):
    """Why two transactions that depend on each other do."""
    h = synthetic.list_history(spark, sf_dir)
    facts = pinned(edges.list_facts(h.possible().mops))
    pairs = pinned(edges.edge_union(facts))
    back = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    found = pinned(pairs.join(back, ["src", "dst"]).filter("src < dst").select(F.concat_ws("/", "src", "dst").alias("cycle_id"), F.array("src", "dst", "src").alias("cycle")))
    texts = explain.rendered(found, facts, h.ops).join(found, "cycle_id")
    return texts.select(F.get("cycle", F.lit(0)).alias("src"), F.get("cycle", F.lit(1)).alias("dst"), "text")


@_query(_LIST_EDGES + "SELECT a.src, a.dst FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst AND a.rels & 1 <> 0 AND b.rels & 1 <> 0")
def g0_two_cycles(spark, sf_dir):
    """Pairs of transactions that wrote around each other."""
    ww = pinned(graph.project(_list_edges(spark, sf_dir), 1))
    back = ww.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return ww.join(back, ["src", "dst"]).filter("src < dst").select("src", "dst")


@_query(_LIST_EDGES + "SELECT a.src, a.dst FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.rels & 4 <> 0 AND a.rels & 3 = 0 AND b.rels & 3 <> 0")
def g_single_two_cycles(spark, sf_dir):
    """A read skew of two transactions: one anti-dependency and one dependency back."""
    pairs = pinned(_list_edges(spark, sf_dir))
    back = graph.project(pairs, 3).select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return pairs.filter("rels & 4 <> 0 and rels & 3 = 0").join(back, ["src", "dst"]).select("src", "dst")


_INSIDE = _REACH + """, comp AS (SELECT e.src, e.dst, e.rels, a.scc FROM edges e JOIN members a ON a.vertex = e.src JOIN members b ON b.vertex = e.dst AND a.scc = b.scc),
sub AS (
  SELECT DISTINCT 'ww' AS g, src, dst FROM comp WHERE rels & 1 <> 0
  UNION ALL SELECT DISTINCT 'dep', src, dst FROM comp WHERE rels & 3 <> 0
  UNION ALL SELECT DISTINCT 'all', src, dst FROM comp
  UNION ALL SELECT DISTINCT 'ext', src, dst FROM (SELECT src, dst FROM comp WHERE rels & 3 <> 0 UNION SELECT d.src, w.dst FROM comp d JOIN comp w ON d.dst = w.src WHERE d.rels & 3 <> 0 AND w.rels & 4 <> 0)),
went AS (SELECT g, src, dst FROM sub UNION SELECT w.g, w.src, s.dst FROM went w JOIN sub s ON s.g = w.g AND s.src = w.dst),
part AS (SELECT a.g, a.src AS vertex, count(*) AS size FROM went a JOIN went b ON a.g = b.g AND a.src = b.dst AND a.dst = b.src GROUP BY 1, 2),
least_part AS (SELECT g, scc, min(size) AS size FROM part JOIN members USING (vertex) GROUP BY 1, 2)
"""


def _sub_graph(mask: int, extend: bool) -> str:
    """Which graph of the SQL text a model looks at, where edges are of writes, reads and anti-dependencies of items alone."""
    return "ext" if extend else {1: "ww", 3: "dep", 7: "all"}[mask & 7]


_MODELS = ", ".join(f"('{m}', {i}, '{_sub_graph(*spec)}')" for i, (m, spec) in enumerate(cycles.EXISTENCE.items()))
_RULED_OUT = ", ".join(f"('{c}', '{m}')" for c in cycles.EXISTENCE for m in sorted(models.all_impossible_models([c])) if m in cycles.EXISTENCE)
_EXISTENCE = f""", asked(model, place, g) AS (VALUES {_MODELS}), out_by(cause, model) AS (VALUES {_RULED_OUT}),
shown AS (SELECT scc, model, place, size FROM asked JOIN least_part USING (g)),
existence AS (SELECT scc, model, size FROM shown s WHERE NOT EXISTS (SELECT 1 FROM shown c JOIN out_by o ON o.cause = c.model WHERE c.scc = s.scc AND c.place < s.place AND o.model = s.model))
"""
_ITEM_TYPES = ("G-single-item", "G0", "G-nonadjacent-item", "G1c", "G2-item")
_TYPE_RULES_OUT = ", ".join(f"('{t}', '{m}')" for t in _ITEM_TYPES for m in sorted(models.anomalies_to_impossible_models([t])) if m in cycles.EXISTENCE)
#: Types of cycles of a component. One anti-dependency closed by a path of dependencies, and cycles without
#: any, show in reachability; two or more need the simple cycles, which only components without a single one
#: are asked for.
_CYCLE_TYPES = _INSIDE + _EXISTENCE + f""", single AS (SELECT DISTINCT c.scc FROM comp c JOIN went w ON w.g = 'dep' AND w.src = c.dst AND w.dst = c.src WHERE c.rels & 3 = 0),
g0 AS (SELECT DISTINCT scc FROM comp c JOIN went w ON w.g = 'ww' AND w.src = c.dst AND w.dst = c.src WHERE c.rels & 1 <> 0),
g1c AS (SELECT DISTINCT scc FROM comp c JOIN went w ON w.g = 'dep' AND w.src = c.dst AND w.dst = c.src WHERE c.rels & 2 <> 0),
path AS (
  SELECT scc, src AS start, dst AS at, [src, dst] AS vs, (rels & 3 = 0)::INT AS n, rels & 3 = 0 AS first, rels & 3 = 0 AS last, false AS next_to FROM comp WHERE dst > src AND scc NOT IN (SELECT scc FROM single)
  UNION ALL
  SELECT p.scc, start, c.dst, list_append(vs, c.dst), n + (c.rels & 3 = 0)::INT, first, c.rels & 3 = 0, next_to OR (last AND c.rels & 3 = 0)
  FROM path p JOIN comp c ON c.src = p.at AND c.scc = p.scc WHERE c.dst > start AND NOT list_contains(vs, c.dst)),
closed AS (SELECT DISTINCT p.scc, next_to OR (c.rels & 3 = 0 AND (last OR first)) OR (first AND last AND n = 1 AND c.rels & 3 = 0) AS touch FROM path p JOIN comp c ON c.src = p.at AND c.dst = start WHERE n + (c.rels & 3 = 0)::INT >= 2),
found AS (
  SELECT scc, 'G-single-item' AS type FROM single UNION ALL SELECT scc, 'G0' FROM g0
  UNION ALL SELECT scc, 'G-nonadjacent-item' FROM closed WHERE NOT touch
  UNION ALL SELECT scc, 'G1c' FROM g1c WHERE scc NOT IN (SELECT scc FROM g0)
  UNION ALL SELECT scc, 'G2-item' FROM closed WHERE touch AND scc NOT IN (SELECT scc FROM closed WHERE NOT touch)),
type_out(type, model) AS (VALUES {_TYPE_RULES_OUT}),
cycle_types AS (
  SELECT scc, type, type AS spec FROM found
  UNION ALL SELECT scc, model || '-cycle-exists', model FROM existence e WHERE NOT EXISTS (SELECT 1 FROM found f JOIN type_out o ON o.type = f.type WHERE f.scc = e.scc AND o.model = e.model))
"""


@_query(_INSIDE + _EXISTENCE + "SELECT scc, model, size::INTEGER AS size FROM existence", recursive=True)
def cycle_existence(spark, sf_dir):
    """Models that some cycle rules out, with the size of the smallest component that shows it."""
    pairs = pinned(_list_edges(spark, sf_dir))
    inside = graph.component_edges(pairs, graph.components(pairs))

    def run(pdf):
        import pandas as pd

        graphs = [(scc, cycles.graph_of(zip(e["src"], e["dst"], e["rels"], strict=True))) for scc, e in graph.each_group(pdf, "scc")]
        return pd.DataFrame([(scc, m, len(p)) for scc, g in graphs for m, p in cycles.existence_cases(g)], columns=["scc", "model", "size"])

    return graph.in_batches(inside, "scc", run, "scc long, model string, size int")


def _holding(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """``found`` (scc, cycle, ...) with ``holds``: each step of the cycle is an edge, and no vertex comes twice."""
    key = [c for c in found.columns if c != "cycle"]
    body = F.slice("cycle", F.lit(1), F.greatest(F.size("cycle") - 1, F.lit(0)))
    simple = found.withColumn("simple", F.size(F.array_distinct(body)) == F.size(body))
    steps = simple.select(*key, "simple", F.explode_outer(F.arrays_zip(body.alias("src"), F.slice("cycle", F.lit(2), F.greatest(F.size("cycle") - 1, F.lit(0))).alias("dst"))).alias("s"))
    met = steps.select(*key, "simple", "s.src", "s.dst").join(pairs.select("src", "dst", F.lit(1).alias("edge")), ["src", "dst"], "left")
    return met.groupBy(*key).agg((F.min("simple") & (F.count("*") == F.count("edge"))).alias("holds"))


@_query(_REACH + "SELECT scc, count(*) AS size, true AS holds FROM members GROUP BY 1", recursive=True)
def plain_cycles(spark, sf_dir):
    """One short cycle of each component, whatever its relations: that it is one."""
    pairs = pinned(_list_edges(spark, sf_dir))
    return _holding(cycles.plain_cycles(pairs), pairs)


@_query()
def cycle_explanations(spark, sf_dir):
    """The text that says why each cycle is one."""
    h = synthetic.list_history(spark, sf_dir)
    facts = pinned(edges.list_facts(h.possible().mops))
    found = pinned(cycles.cycle_cases(edges.edge_union(facts), timeout_s=10.0).filter(~F.col("type").endswith("-cycle-exists")).withColumn("cycle_id", F.concat_ws("/", "scc", "spec")))
    return explain.rendered(found, facts, h.ops)


_DOTS = _REACH + """, inner_edges AS (SELECT e.src, e.dst, e.rels, a.scc FROM edges e JOIN members a ON a.vertex = e.src JOIN members b ON b.vertex = e.dst AND a.scc = b.scc),
label AS (SELECT index, type, string_agg(concat_ws(' ', f, k, CASE WHEN f = 'r' THEN coalesce('[' || array_to_string(vs, ',') || ']', 'nil') ELSE coalesce(v::VARCHAR, 'nil') END), ' | ' ORDER BY mop_idx) AS label FROM mops GROUP BY 1, 2),
line AS (
  SELECT scc, 0 AS kind, vertex AS a, 0 AS b, '  T' || vertex || ' [label="' || coalesce(label, '') || '",color="' || CASE coalesce(type, 'ok') WHEN 'ok' THEN '#2e7d32' WHEN 'info' THEN '#f9a825' WHEN 'fail' THEN '#c62828' ELSE '#333333' END || '"];' AS line FROM members LEFT JOIN label ON index = vertex
  UNION ALL
  SELECT scc, 1, src, dst, '  T' || src || ' -> T' || dst || ' [label="' || concat_ws(',', CASE WHEN rels & 1 <> 0 THEN 'ww' END, CASE WHEN rels & 2 <> 0 THEN 'wr' END, CASE WHEN rels & 4 <> 0 THEN 'rw' END) || '",color="' || CASE WHEN rels & 1 <> 0 THEN '0.000' WHEN rels & 2 <> 0 THEN '0.167' ELSE '0.333' END || ' 0.8 0.7"];' FROM inner_edges)
SELECT scc, 'digraph G {' || chr(10) || '  rankdir=LR;' || chr(10) || '  node [shape=record];' || chr(10) || string_agg(line, chr(10) ORDER BY kind, a, b, line) || chr(10) || '}' || chr(10) AS dot
FROM line GROUP BY scc HAVING sum(strlen(line) + 1) <= 65536
"""


@_query(_DOTS, recursive=True)
def component_dots(spark, sf_dir):
    """Each component as DOT text."""
    h = synthetic.list_history(spark, sf_dir)
    pairs = pinned(edges.edge_union(edges.list_facts(h.possible().mops)))
    return render.dots(graph.component_edges(pairs, graph.components(pairs)), h.mops)


@_query(_ORDER + """, shown AS (SELECT k, index, mop_idx, vs FROM mops WHERE type IN ('ok', 'info') AND f = 'r' AND len(vs) > 0 AND k IN (SELECT k FROM incompatible)),
longest AS (SELECT k, arg_max(vs, (len(vs), vs)) AS best FROM shown GROUP BY 1),
row_ AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY len(vs), index, mop_idx) AS nth, '<tr><th>' || index || '</th>' ||
  array_to_string(list_transform(vs, lambda x, i: '<td style="background:hsl(' || (x * 47) % 360 || ',70%,' || CASE WHEN best[i] IS NOT DISTINCT FROM x THEN '95%' ELSE '75%' END || ')">' || x || '</td>'), '') || '</tr>' AS line FROM shown JOIN longest USING (k)),
paged AS (SELECT k, ceil(nth / 10000)::INTEGER AS page, string_agg(line, chr(10) ORDER BY nth) AS body FROM row_ GROUP BY 1, 2)
SELECT k, page, '<html><body><h1>All reads of ' || k || CASE WHEN page > 1 THEN ', page ' || page ELSE '' END || '</h1><table>' || chr(10) || body || chr(10) || '</table></body></html>' || chr(10) AS html FROM paged
""")
def incompatible_order_pages(spark, sf_dir):
    """For each key with incompatible orders, all its reads as an HTML table."""
    mops = _possible(spark, sf_dir)
    return render.incompatible_pages(detectors.incompatible_order(mops), mops)


@_query(_CYCLE_TYPES + "SELECT scc, type, spec, true AS holds FROM cycle_types", recursive=True)
def cycle_cases(spark, sf_dir):
    """One witness for each type of cycle in each component, and that it is a cycle."""
    pairs = pinned(_list_edges(spark, sf_dir))
    found = pinned(cycles.cycle_cases(pairs, timeout_s=None, steps_most=None).select("scc", "type", "spec", "cycle"))
    sure = F.col("type").endswith("-cycle-exists")
    return _holding(found.filter(~sure), pairs).unionByName(found.filter(sure).select("scc", "type", "spec", F.lit(True).alias("holds")))


@_query(_LOST + "SELECT l.k, l.v, n, index FROM lost l JOIN first_read f ON f.k = l.k AND f.v = l.v JOIN last_write w USING (index) WHERE w.k = l.k AND w > first_at")
def lost_update_txns(spark, sf_dir):
    """All transactions of each lost update."""
    return detectors.lost_update_txns(_lists(spark, sf_dir), "array_join(transform(vs, x -> cast(x as string)), ',')")


# whole checks -----------------------------------------------------------------------------------------


_LOCAL = (("G1a", "g1a"), ("G1b", "g1b"), ("internal", "internal"), ("incompatible-order", "incompatible"), ("dirty-update", "dirty"), ("lost-update", "lost"))
_REPEATS = "repeats AS (SELECT index FROM (SELECT index, mop_idx, k, unnest(vs) AS element FROM mops WHERE type IN ('ok', 'info') AND f = 'r') GROUP BY index, mop_idx, k, element HAVING count(*) > 1)"
_FUTURE = "future AS (SELECT DISTINCT r.index FROM (SELECT index, mop_idx, k, unnest(vs) AS v FROM mops WHERE type = 'ok' AND f = 'r') r JOIN mops a ON a.index = r.index AND a.k = r.k AND a.v = r.v AND a.f = 'append' AND r.mop_idx < a.mop_idx)"


def _counts(parts) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS type, count(*) AS n FROM {v}" for t, v in parts)


def _check_sql() -> str:
    return ", ".join((_G1A, _G1B, _INTERNAL, _ORDER, _DIRTY, _LOST)) + f" SELECT * FROM ({_counts(_LOCAL)}) WHERE n > 0"


def _whole_check_sql() -> str:
    """Local anomalies and cycles of the list check, without orders between transactions."""
    parts = (*_LOCAL, ("duplicate-elements", "repeats"), ("future-read", "future"))
    local = ", ".join((_G1A, _G1B, _INTERNAL, _ORDER, _DIRTY, _LOST, _REPEATS, _FUTURE))
    bad = ", ".join(f"'{a}'" for a in sorted(models.prohibited(["serializable"])))
    return f"{_CYCLE_TYPES}, {local} SELECT type, n, type IN ({bad}) AS forbidden FROM ({_counts(parts)} UNION ALL SELECT type, count(*) FROM cycle_types GROUP BY 1) WHERE n > 0"


@_query(_check_sql())
def list_local_anomalies(spark, sf_dir):
    """The anomalies of the list history that show without a cycle."""
    mops = _lists(spark, sf_dir)
    possible = mops.filter("type in ('ok', 'info')")
    found = {
        "G1a": detectors.g1a_list(mops),
        "G1b": detectors.g1b_list(mops),
        "internal": detectors.internal_list(mops),
        "incompatible-order": detectors.incompatible_order(possible),
        "dirty-update": detectors.dirty_update(mops),
        "lost-update": detectors.lost_update(mops, "array_join(transform(vs, x -> cast(x as string)), ',')"),
    }
    rows = [d.select(F.lit(t).alias("type")) for t, d in found.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("type").agg(F.count("*").alias("n"))


@_query(_whole_check_sql(), recursive=True)
def list_check_serializable(spark, sf_dir):
    """The whole list-append check against serializability, which needs no order between transactions."""
    result = check.check_list_append(synthetic.list_history(spark, sf_dir), ["serializable"], timeout_s=None)
    return result.summary().withColumn("forbidden", F.col("type").isin(*sorted(models.prohibited(["serializable"]))))


@_query()
def list_check_summary(spark, sf_dir):
    """The whole list-append check: anomaly types, how many cases prove them, and whether the asked model forbids them."""
    result = check.check_list_append(synthetic.list_history(spark, sf_dir))
    return result.summary().withColumn("forbidden", F.col("type").isin(*sorted(models.prohibited())))


@_query()
def register_check_summary(spark, sf_dir):
    result = check.check_rw_register(synthetic.register_history(spark, sf_dir), wfr_keys=True)
    return result.summary().withColumn("forbidden", F.col("type").isin(*sorted(models.prohibited())))


#: What each simulated level keeps, and what it breaks.
_SIMULATED = (("serial", "strict-serializable", "true"), ("serializable-si", "strict-serializable", "true"), ("si", "strong-snapshot-isolation", "true"), ("si", "serializable", "false"), ("prefix", "snapshot-isolation", "false"), ("sloppy", "read-committed", "false"))


@_query("SELECT * FROM (VALUES " + ", ".join(str(x) for x in _SIMULATED) + ") AS t(level, model, valid)", history=False)
def simulated_verdicts(spark, sf_dir):
    """The list check of simulated databases against models that their level keeps or breaks."""
    return simulators.verdicts(spark, [x[:2] for x in _SIMULATED], check.check_list_append, txns=150, shards=4)


# lattices ---------------------------------------------------------------------------------------------


def _values(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in pairs)


_STEP = "SELECT a, b FROM e UNION ALL SELECT c.a, e.b FROM c JOIN e ON c.b = e.a"


def _closure_sql(pairs: list[tuple[str, str]], names: str, select: str) -> str:
    return f"WITH RECURSIVE e(a, b) AS (SELECT * FROM (VALUES {_values(pairs)}) AS t(a, b)), c(a, b) AS ({_STEP}) SELECT DISTINCT a AS {names.split()[0]}, b AS {names.split()[1]} FROM ({select})"


_IMPLIED_SQL = _closure_sql(models.edges(models.IMPLIED), "anomaly implies", "SELECT a, b FROM c")
_CONTAINED_SQL = _closure_sql(models.edges(models.MODELS), "model contains", "SELECT a, b FROM c")


def _rows(spark: SparkSession, pairs, schema: str) -> DataFrame:
    return spark.createDataFrame(sorted(pairs), schema)


@_query(_IMPLIED_SQL, history=False)
def implied_anomalies(spark, sf_dir):
    return _rows(spark, {(a, b) for a in models.IMPLIED for b in models.all_implied_anomalies([a]) - {a}}, "anomaly string, implies string")


@_query(_CONTAINED_SQL, history=False)
def implied_models(spark, sf_dir):
    return _rows(spark, {(a, b) for a in models.MODELS for b in models.all_implied_models([a]) - {a}}, "model string, contains string")


_IMPOSSIBLE_SQL = f"""
WITH RECURSIVE ie(a, b) AS (SELECT * FROM (VALUES {_values(models.edges(models.IMPLIED))}) AS t(a, b)),
me(a, b) AS (SELECT * FROM (VALUES {_values(models.edges(models.MODELS))}) AS t(a, b)),
p(model, anomaly) AS (SELECT * FROM (VALUES {_values(models.edges(models.PROSCRIBED))}) AS t(model, anomaly)),
ic(a, b) AS (SELECT a, b FROM ie UNION ALL SELECT ic.a, ie.b FROM ic JOIN ie ON ic.b = ie.a),
mc(a, b) AS (SELECT a, b FROM me UNION ALL SELECT mc.a, me.b FROM mc JOIN me ON mc.b = me.a),
shown AS (SELECT a AS anomaly, b AS found FROM ic UNION SELECT a, a FROM ie UNION SELECT b, b FROM ie UNION SELECT anomaly, anomaly FROM p),
direct AS (SELECT DISTINCT shown.anomaly, model FROM shown JOIN p ON p.anomaly = shown.found)
SELECT anomaly, model FROM direct UNION SELECT d.anomaly, mc.a FROM direct d JOIN mc ON mc.b = d.model
"""


@_query(_IMPOSSIBLE_SQL, history=False)
def impossible_models(spark, sf_dir):
    """The models that each anomaly rules out."""
    return _rows(spark, {(a, m) for a in models.ALL_ANOMALIES for m in models.anomalies_to_impossible_models([a])}, "anomaly string, model string")


_PROHIBITED_SQL = f"""
WITH RECURSIVE me(a, b) AS (SELECT * FROM (VALUES {_values(models.edges(models.MODELS))}) AS t(a, b)),
ie(a, b) AS (SELECT * FROM (VALUES {_values(models.edges(models.IMPLIED))}) AS t(a, b)),
p(model, anomaly) AS (SELECT * FROM (VALUES {_values(models.edges(models.PROSCRIBED))}) AS t(model, anomaly)),
below(model, b) AS (SELECT a, a FROM me UNION SELECT b, b FROM me UNION SELECT model, model FROM p UNION SELECT below.model, me.b FROM below JOIN me ON below.b = me.a),
bad(model, anomaly) AS (SELECT below.model, anomaly FROM below JOIN p ON p.model = below.b UNION SELECT bad.model, ie.a FROM bad JOIN ie ON ie.b = bad.anomaly)
SELECT DISTINCT model, anomaly FROM bad
"""


@_query(_PROHIBITED_SQL, history=False)
def prohibited_anomalies(spark, sf_dir):
    """The anomalies that each model forbids."""
    return _rows(spark, {(m, a) for m in models.ALL_MODELS for a in models.anomalies_prohibited_by([m])}, "model string, anomaly string")


@_query(f"SELECT anomaly, model FROM ({_IMPOSSIBLE_SQL}) x WHERE NOT EXISTS (SELECT 1 FROM ({_IMPOSSIBLE_SQL}) y JOIN ({_CONTAINED_SQL}) c ON c.contains = y.model WHERE y.anomaly = x.anomaly AND c.model = x.model)", history=False)
def boundary(spark, sf_dir):
    """The weakest models that each anomaly rules out."""
    rows = [(a, m) for a in models.ALL_ANOMALIES for m in models.boundary([a])[0]]
    return spark.createDataFrame(rows, "anomaly string, model string")


_DEPTH_EDGES = sorted({*models.edges(models.IMPLIED), *models.edges(models.SEVERITY)})
_DEPTH_SQL = f"""
WITH RECURSIVE e(a, b) AS (SELECT * FROM (VALUES {_values(_DEPTH_EDGES)}) AS t(a, b)),
p(model, anomaly) AS (SELECT * FROM (VALUES {_values(models.edges(models.PROSCRIBED))}) AS t(model, anomaly)),
d(anomaly, depth) AS (SELECT a, 0 FROM e UNION SELECT anomaly, 0 FROM p UNION SELECT e.b, d.depth + 1 FROM d JOIN e ON e.a = d.anomaly)
SELECT anomaly, max(depth)::INTEGER AS depth FROM d GROUP BY 1
"""


@_query(_DEPTH_SQL, history=False)
def anomaly_depths(spark, sf_dir):
    """How many worse anomalies come before each, at most."""
    return _rows(spark, models.DEPTHS.items(), "anomaly string, depth int")


# generators -------------------------------------------------------------------------------------------


def _generated_sql(write: str, txns: int = 2000, seed: int = 53) -> str:
    u = lambda *salt: f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(salt)})), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"
    return f"""
WITH txn AS (SELECT range AS index, 1 + floor({u("'length'", "range::VARCHAR")} * 4)::INT AS n FROM range({txns})),
mop AS (SELECT index, unnest(range(n))::INT AS mop_idx FROM txn),
drawn AS (SELECT index, mop_idx, least(floor(ln({u("'slot'", "index::VARCHAR", "mop_idx::VARCHAR")} * 1023 + 1) / ln(2))::BIGINT, 9) AS slot, {u("'kind'", "index::VARCHAR", "mop_idx::VARCHAR")} < 0.5 AS writes FROM mop),
placed AS (SELECT *, (sum(writes::BIGINT) OVER (PARTITION BY slot ORDER BY index, mop_idx) - writes::BIGINT)::BIGINT AS place FROM drawn),
most AS (SELECT slot, max(place) AS most FROM placed GROUP BY 1),
epoch AS (SELECT slot, unnest(range(most + 1)) AS epoch, most FROM most),
sized AS (SELECT *, least(greatest(floor(pow(257.0, {u("'writes'", "slot::VARCHAR", "epoch::VARCHAR")}))::BIGINT, 1), 256) AS size FROM epoch),
ends AS (SELECT *, (sum(size) OVER (PARTITION BY slot ORDER BY epoch))::BIGINT AS fin FROM sized),
keyed AS (SELECT p.*, e.epoch, p.place - (e.fin - e.size) + 1 AS value FROM placed p JOIN ends e ON e.slot = p.slot AND p.place >= e.fin - e.size AND p.place < e.fin)
SELECT (slot + 10 * epoch)::VARCHAR AS k, CASE WHEN writes THEN '{write}' ELSE 'r' END AS f, count(*) AS n, max(CASE WHEN writes THEN value END) AS v FROM keyed GROUP BY 1, 2
"""


@_query(_generated_sql("w"), history=False)
def generated_registers(spark, sf_dir):
    """How often the generator meets each key, and the last value written."""
    return generators.register_txns(spark, 2000, seed=53).groupBy("k", "f").agg(F.count("*").alias("n"), F.max("v").alias("v"))


@_query(_generated_sql("append"), history=False)
def generated_lists(spark, sf_dir):
    return generators.list_txns(spark, 2000, seed=53).groupBy("k", "f").agg(F.count("*").alias("n"), F.max("v").alias("v"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
