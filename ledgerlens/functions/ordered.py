"""Running values over one global order without a single-partition window.

Rows are range-partitioned by the order and pinned; each partition runs its own window,
and the partitions' totals (one number each) come back as a broadcast prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written


def pinned(df: DataFrame) -> DataFrame:
    """A written table in the shared folder: computed once (a checkpoint computes twice), and without lineage."""
    return written(df, "pinned")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def running_max(df: DataFrame, order: list[str], value: str, out: str, strictly_before: bool = False) -> DataFrame:
    """``df`` with ``out``: the maximum of ``value`` over all rows up to this one (or before it) by ``order``."""
    spark = df.sparkSession
    rows = pinned(df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("__part", F.spark_partition_id()))
    tops = {r["__part"]: r["top"] for r in rows.groupBy("__part").agg(F.max(value).alias("top")).collect()}  # a row for each partition
    before, best = [], None
    for part in sorted(tops):
        before.append((part, best))
        best = max((x for x in (best, tops[part]) if x is not None), default=None)
    kind = df.schema[value].dataType.simpleString()
    prefix = F.broadcast(spark.createDataFrame(before, f"__part int, __before {kind}"))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strictly_before else 0)
    local = rows.withColumn("__local", F.max(value).over(within))
    return local.join(prefix, "__part").withColumn(out, F.greatest("__local", "__before")).drop("__part", "__local", "__before")


def running_sum(df: DataFrame, by: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of its ``by`` up to this one, by ``order``, which begins with ``by``.

    Ranges of rows are summed on their own; the totals (one for each range and ``by``) give what comes before.
    """
    rows = pinned(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("__part", F.spark_partition_id()))
    local = rows.withColumn("__local", F.sum(value).over(Window.partitionBy("__part", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("__part", by).agg(F.sum(value).alias("n")).select("__part", by, F.coalesce(before, F.lit(0)).alias("__before"))
    return local.join(starts, ["__part", by]).withColumn(out, F.col("__local") + F.col("__before")).drop("__part", "__before", "__local")


def numbered(df: DataFrame, by: str, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: 1, 2, ... within each ``by`` in the order of ``order``, which begins with ``by``."""
    return running_sum(df.withColumn("__one", F.lit(1).cast("long")), by, order, "__one", out).drop("__one")


def followed(df: DataFrame, by: list[str], order: str, columns: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: a struct of ``columns`` of the next row of its ``by`` in the order of ``order``; null at the end.

    Ranges of rows are solved on their own, however few groups there are; the last row of a group in a range
    meets the group's first row in a later one.
    """
    rows = pinned(df.repartitionByRange(shuffle_partitions(df.sparkSession), order).withColumn("__part", F.spark_partition_id()))
    local = rows.withColumn(out, F.lead(F.struct(*columns)).over(Window.partitionBy("__part", *by).orderBy(order)))
    firsts = rows.groupBy("__part", *by).agg(F.min(F.struct(F.col(order).alias("__at"), F.struct(*columns).alias("__row"))).alias("__first"))
    carried = firsts.select("__part", *[F.col(c).alias(f"__{c}") for c in by], F.lead("__first.__row").over(Window.partitionBy(*by).orderBy("__part")).alias("__next"))
    same = [F.col("at.__part") == F.col("next.__part"), *[F.col(f"at.{c}").eqNullSafe(F.col(f"next.__{c}")) for c in by]]
    last = local.filter(F.col(out).isNull()).drop(out).alias("at").join(carried.alias("next"), same, "left").select("at.*", F.col("next.__next").alias(out))
    return local.filter(F.col(out).isNotNull()).unionByName(last).drop("__part")
