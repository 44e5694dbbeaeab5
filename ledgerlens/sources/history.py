"""Histories as DataFrames: one row per operation, one row per micro-operation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import followed

PREDICATE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
MOP = T.StructType(
    [
        T.StructField("f", T.StringType()),
        T.StructField("k", T.StringType()),
        T.StructField("v", T.LongType()),
        T.StructField("vs", T.ArrayType(T.LongType())),
        T.StructField("pred", PREDICATE),
        T.StructField("seen", T.MapType(T.StringType(), T.LongType())),
    ]
)
OPS = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("time", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("process", T.LongType()),
        T.StructField("f", T.StringType()),
        T.StructField("value", T.ArrayType(MOP)),
    ]
)
TYPES = ("invoke", "ok", "fail", "info")
POSSIBLE = ("ok", "info")


class HistoryError(ValueError):
    """A history that cannot be analysed; ``kind`` names why."""

    def __init__(self, kind: str, detail: object) -> None:
        super().__init__(f"{kind}: {detail}")
        self.kind, self.detail = kind, detail


@dataclass(frozen=True)
class History:
    """``ops``: index, time, type, process, f. ``mops``: index, type, process, mop_idx, f, k, v, vs, pred, seen."""

    ops: DataFrame
    mops: DataFrame

    @classmethod
    def of(cls, ops: DataFrame) -> History:
        """From operations with nested values (S5: flattening)."""
        return cls(ops.drop("value"), explode_mops(ops))

    def clients(self) -> History:
        """Without system processes, whose process is not a number."""
        return History(self.ops.filter("process is not null"), self.mops.filter("process is not null"))

    def filtered(self, *types: str) -> History:
        """Operations with these outcomes (S3)."""
        return History(self.ops.filter(F.col("type").isin(*types)), self.mops.filter(F.col("type").isin(*types)))

    def oks(self) -> History:
        return self.filtered("ok")

    def possible(self) -> History:
        return self.filtered(*POSSIBLE)


def explode_mops(ops: DataFrame) -> DataFrame:
    """(operation, micro-operation) rows in order within each operation."""
    return ops.select("index", "type", "process", F.posexplode("value").alias("mop_idx", "m")).select("index", "type", "process", "mop_idx", "m.*")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OPS).parquet(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OPS).json(path)


def mop(f: str, k: str | None = None, v: int | None = None, vs: Iterable[int] | None = None, pred: tuple | None = None, seen: dict[str, int | None] | None = None) -> Row:
    return Row(f=f, k=k, v=v, vs=list(vs) if vs is not None else None, pred=None if pred is None else (*pred, None, None)[:3], seen=seen)


def from_rows(spark: SparkSession, ops: Iterable[dict]) -> DataFrame:
    """A small history from dictionaries; missing indexes count up, times and processes default to 0."""
    rows = [(o.get("index", i), o.get("time", 0), o.get("type", "ok"), o.get("process", 0), o.get("f", "txn"), list(o.get("value", ()))) for i, o in enumerate(ops)]
    return spark.createDataFrame(rows, OPS)


def pair_index(ops: DataFrame) -> DataFrame:
    """(inv, comp, process, type of the completion): the invocation and completion of each transaction.

    comp is null for a transaction that never ended.
    """
    rows = followed(ops.select("index", "process", "type"), ["process"], "index", ["index", "type"], "next")
    ended = F.col("next.type") != "invoke"
    return rows.filter("type = 'invoke'").select(F.col("index").alias("inv"), F.when(ended, F.col("next.index")).alias("comp"), "process", F.when(ended, F.col("next.type")).alias("type"))


def distinct_keys(mops: DataFrame) -> DataFrame:
    """All keys (S7)."""
    return mops.select("k").where("k is not null").distinct()


def ok_mops(mops: DataFrame) -> DataFrame:
    """Micro-operations of committed transactions."""
    return mops.filter("type = 'ok'")


def check_schema(ops: DataFrame) -> None:
    """Types are fixed by the schema: keys are strings, values are longs (V3)."""
    wanted, got = {f.name: f.dataType.simpleString() for f in OPS}, {f.name: f.dataType.simpleString() for f in ops.schema}
    if bad := {n: (got.get(n), t) for n, t in wanted.items() if got.get(n) != t}:
        raise HistoryError("unexpected-types", bad)


def mixed_key_types(values: DataFrame, column: str = "k") -> DataFrame:
    """Pairs of key spellings that a schema-less source mixed: integers and other text (V3)."""
    kinds = values.select(F.when(F.col(column).rlike(r"^-?\d+$"), "integer").otherwise("text").alias("kind")).groupBy("kind").count()
    return kinds.agg(F.count("*").alias("n"), F.sum("count").alias("rows"), F.sort_array(F.collect_list("kind")).alias("kinds")).filter("n > 1")
