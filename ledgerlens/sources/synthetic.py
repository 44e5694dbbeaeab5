"""Histories derived from the ``events`` table, in SQL text that Spark and DuckDB both run.

Three events make a transaction. 'purchase' and 'signup' events write, the others read what came before
on their key: every 13th transaction sees aborted writes, and every 11th is twelve transactions stale.
A process' transactions never overlap. Indexes are positions in time, unique but not dense, so no global
numbering is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import scratch_dir, written
from .history import History

_STORED: dict[tuple[str, str, str], History] = {}


def _stored(spark: SparkSession, sf_dir: str, kind: str, make) -> History:
    """A history of a folder is written once for each application, and then read."""
    key = (scratch_dir(spark), sf_dir, kind)  # a new folder, a new history
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]

_MOPS = """
raw AS (SELECT event_id, user_id, event_type, CAST(floor(event_id / 3.0) AS BIGINT) AS txn, CAST(event_id % 3 AS INT) AS mop_idx FROM {events}),
keyed AS (SELECT *, first_value(user_id) OVER (PARTITION BY txn ORDER BY event_id) AS first_user FROM raw),
base AS (
  SELECT txn, mop_idx, CAST(txn % 5 AS BIGINT) AS process,
         CASE WHEN txn % 17 = 0 THEN 'fail' WHEN txn % 23 = 0 THEN 'info' ELSE 'ok' END AS outcome,
         event_type IN ('purchase', 'signup') AS writes,
         CAST((CASE WHEN mop_idx < 2 THEN first_user ELSE user_id END) % 15 + 15 * CAST(floor(txn / 200.0) AS BIGINT) AS {text}) AS k,
         event_id AS v, CAST(10 * txn AS BIGINT) AS inv, CAST(10 * (txn + (txn * 7) % 4) + 8 - (txn * 7) % 4 AS BIGINT) AS comp
  FROM keyed),
seen AS (
  SELECT r.v, {sorted} AS vs FROM base r JOIN base w ON r.k = w.k
  WHERE NOT r.writes AND w.writes AND w.v < r.v
    AND (w.txn = r.txn OR ((w.outcome <> 'fail' OR r.txn % 13 = 0) AND w.txn < r.txn - CASE WHEN r.txn % 11 = 0 THEN 12 ELSE 0 END))
  GROUP BY r.v),
joined AS (SELECT base.*, seen.vs FROM base LEFT JOIN seen ON base.v = seen.v),
mops AS (
  SELECT comp AS index, outcome AS type, process, mop_idx, CASE WHEN writes THEN 'append' ELSE 'r' END AS f, k,
         CASE WHEN writes THEN v END AS v,
         CASE WHEN NOT writes AND outcome = 'ok' THEN coalesce(vs, {empty}) END AS vs, inv
  FROM joined
  UNION ALL
  SELECT inv AS index, 'invoke' AS type, process, mop_idx, CASE WHEN writes THEN 'append' ELSE 'r' END AS f, k,
         CASE WHEN writes THEN v END AS v, CAST(NULL AS {list}) AS vs, inv
  FROM joined)
"""
_SPARK = {"text": "STRING", "sorted": "sort_array(collect_list(w.v))", "empty": "CAST(array() AS ARRAY<BIGINT>)", "list": "ARRAY<BIGINT>"}
_DUCK = {"text": "VARCHAR", "sorted": "list(w.v ORDER BY w.v)", "empty": "CAST([] AS BIGINT[])", "list": "BIGINT[]", "events": "events"}

#: Common table expressions for DuckDB: mops (lists), reg (registers), ops.
DUCK_CTES = (
    _MOPS.format(**_DUCK)
    + """,
reg AS (SELECT index, type, process, mop_idx, CASE WHEN f = 'append' THEN 'w' ELSE f END AS f, k, CASE WHEN f = 'append' THEN v WHEN len(vs) > 0 THEN vs[-1] END AS v FROM mops),
ops AS (SELECT DISTINCT index, type, process FROM mops)
"""
)


def mops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_history(spark, sf_dir).mops


def _mops(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    text = "WITH " + _MOPS.format(events="{events}", **_SPARK) + "SELECT index, type, process, mop_idx, f, k, v, vs FROM mops"
    return spark.sql(text, events=events)


def list_history(spark: SparkSession, sf_dir: str) -> History:
    def make() -> History:
        rows = written(_mops(spark, sf_dir), "list-history")
        return History(written(_ops(rows), "list-operations"), rows)

    return _stored(spark, sf_dir, "list", make)


def register_history(spark: SparkSession, sf_dir: str) -> History:
    history = list_history(spark, sf_dir)
    rows = history.mops.selectExpr("index", "type", "process", "mop_idx", "CASE WHEN f = 'append' THEN 'w' ELSE f END AS f", "k", "CASE WHEN f = 'append' THEN v WHEN size(vs) > 0 THEN element_at(vs, -1) END AS v")
    return History(history.ops, rows)


def _ops(rows: DataFrame) -> DataFrame:
    """Each operation's first row; three rows of one operation meet nowhere else, so there is no shuffle."""
    return rows.filter("mop_idx = 0").selectExpr("index", "index * 1000000 AS time", "type", "process", "'txn' AS f")


#: A closed universe: an init of two thirds of the keys, one change of each key (by key mod 3 an insert, a
#: write or a delete), item reads, and predicate reads for even values from 'view' events.
_PREDICATE = """
praw AS (
  SELECT event_id, event_type, txn, mop_idx, CAST(floor(txn / 200.0) AS BIGINT) AS epoch,
         CAST(user_id % 12 AS BIGINT) + 12 * CAST(floor(txn / 200.0) AS BIGINT) AS n,
         CASE WHEN txn % 17 = 0 THEN 'fail' WHEN txn % 23 = 0 THEN 'info' ELSE 'ok' END AS outcome,
         CAST(txn % 5 AS BIGINT) AS process, CAST(110 + 10 * (txn + (txn * 7) % 4) - (txn * 7) % 4 AS BIGINT) AS index
  FROM (SELECT *, CAST(floor(event_id / 3.0) AS BIGINT) AS txn, CAST(event_id % 3 AS INT) AS mop_idx FROM {events})),
muts AS (SELECT n AS mn, min(event_id) AS m FROM praw WHERE event_type IN ('purchase', 'signup') GROUP BY 1),
pacts AS (
  SELECT praw.*, CASE WHEN m = event_id THEN CASE n % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'w' ELSE 'delete' END WHEN event_type = 'view' THEN 'rp' ELSE 'r' END AS f
  FROM praw LEFT JOIN muts ON n = mn),
pkeys AS (
  SELECT k.n, k.epoch, c.event_id AS m, c.txn AS mtxn, c.outcome AS mout
  FROM (SELECT DISTINCT n, epoch FROM praw) k LEFT JOIN (SELECT * FROM pacts WHERE f IN ('insert', 'w', 'delete')) c ON k.n = c.n),
pview AS (
  SELECT r.index, r.mop_idx, r.f, p.n, CASE WHEN r.f = 'r' AND p.n <> r.n THEN false ELSE true END AS own,
         CASE WHEN p.m IS NOT NULL AND p.mout <> 'fail' AND (p.mtxn < r.txn - CASE WHEN r.txn % 11 = 0 THEN 12 ELSE 0 END OR p.mtxn = r.txn AND p.m < r.event_id)
              THEN CASE WHEN p.n % 3 = 2 THEN NULL ELSE p.m END
              WHEN p.n % 3 <> 0 THEN 0 END AS v
  FROM pacts r JOIN pkeys p ON r.epoch = p.epoch WHERE r.f IN ('r', 'rp')),
pseen AS (SELECT index, mop_idx, CAST(n AS {text}) AS k, v FROM pview WHERE f = 'rp' AND v % 2 = 0),
pmops AS (
  SELECT a.index, a.outcome AS type, a.process, a.mop_idx, a.f, CASE WHEN a.f <> 'rp' THEN CAST(a.n AS {text}) END AS k,
         CASE WHEN a.f IN ('insert', 'w') THEN a.event_id WHEN a.f = 'r' THEN r.v END AS v
  FROM pacts a LEFT JOIN (SELECT index, mop_idx, v FROM pview WHERE f = 'r' AND own) r ON a.index = r.index AND a.mop_idx = r.mop_idx
  UNION ALL
  SELECT CAST(1 AS BIGINT), 'ok', CAST(0 AS BIGINT), CAST(n AS INT), 'init', CAST(n AS {text}), CAST(0 AS BIGINT) FROM pkeys WHERE n % 3 <> 0)
"""
DUCK_PREDICATE_CTES = _PREDICATE.format(**_DUCK)


def predicate_history(spark: SparkSession, sf_dir: str) -> History:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    text = "WITH " + _PREDICATE.format(events="{events}", **_SPARK)
    text += """, maps AS (SELECT index, mop_idx, map_from_entries(collect_list(struct(k, v))) AS seen FROM pseen GROUP BY 1, 2)
    SELECT p.index, type, process, p.mop_idx, f, k, v,
           CASE WHEN f = 'rp' THEN named_struct('kind', 'mod', 'a', 2L, 'b', 0L) END AS pred,
           CASE WHEN f = 'rp' THEN coalesce(seen, CAST(map() AS MAP<STRING, BIGINT>)) END AS seen
    FROM pmops p LEFT JOIN maps ON p.index = maps.index AND p.mop_idx = maps.mop_idx"""

    def make() -> History:
        rows = written(spark.sql(text, events=events), "predicate-history")
        return History(written(rows.select("index", (F.col("index") * 1000000).alias("time"), "type", "process", F.lit("txn").alias("f")).distinct(), "predicate-operations"), rows)

    return _stored(spark, sf_dir, "predicate", make)
