"""Running values by ranges against plain windows, and tables in the shared folder."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions import ordered, shared
from ledgerlens.operators import versions


def table(spark, n=200, seed=1):
    r = random.Random(seed)
    at = r.sample(range(10_000), n)
    return spark.createDataFrame([(a, r.choice(["x", "y", None]), r.randrange(100)) for a in at], "at long, g string, v long").repartition(5)


def rows(df):
    return sorted(map(str, df.collect()))


def test_next_rows(spark):
    df = table(spark)
    w = Window.partitionBy("g").orderBy("at")
    want = df.withColumn("next", F.lead(F.struct("at", "v")).over(w))
    assert rows(ordered.followed(df, ["g"], "at", ["at", "v"], "next")) == rows(want)
    assert ordered.followed(df.limit(0), ["g"], "at", ["at"], "next").count() == 0


def test_running_sums_and_numbers(spark):
    df = table(spark).filter("g is not null")
    w = Window.partitionBy("g").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(ordered.running_sum(df, "g", ["g", "at"], "v", "s").select("at", "g", "v", "s")) == rows(df.withColumn("s", F.sum("v").over(w)))
    assert rows(ordered.numbered(df, "g", ["g", "at"], "s").select("at", "g", "v", "s")) == rows(df.withColumn("s", F.row_number().over(Window.partitionBy("g").orderBy("at"))))


def test_reduced_order_is_the_reduction(spark):
    r = random.Random(4)
    data, at = [], 0
    spans = r.sample(range(400), 400)
    for i in range(100):
        inv, comp = sorted(spans[2 * i : 2 * i + 2])
        data.append((r.choice("ab"), inv, comp, r.choice(["ok", "ok", "info"]), at))
        at += 1
    df = spark.createDataFrame(data, "k string, inv long, comp long, type string, n long")
    got = {(x.k, x.a_n, x.b_n) for x in versions.reduced_order(df, ["k"]).collect()}
    want = {(a[0], a[4], b[4]) for a in data for b in data if a[0] == b[0] and a[3] == "ok" and a[2] < b[1] and not any(c[0] == a[0] and c[3] == "ok" and a[2] < c[1] and c[2] < b[1] for c in data)}
    assert got == want and want


def test_jobs_together(spark):
    assert shared.together(lambda: 1, lambda: spark.range(3).count()) == [1, 3]
    with pytest.raises(ZeroDivisionError):
        shared.together(lambda: 1, lambda: 1 // 0)
    assert shared.together() == []


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"
        _jsc = spark.sparkContext._jsc

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    class NoFolder:
        def isDefined(self):
            return False

    class Jsc:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return NoFolder()

    monkeypatch.setattr(Context, "_jsc", Jsc())
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(Session())
