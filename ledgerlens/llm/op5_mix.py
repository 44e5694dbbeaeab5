"""Mixing sources to target weights by Poisson replication, in DataFrame operations alone.

A source with share s of the documents and target weight w gets the mean repetition rate w / s. Each
document's count is the inverse of the Poisson distribution at a uniform number made from a hash of the
seed and its doc_id (a rate over 600 is dealt evenly over several draws, each at a number of its own, whose
sum has the Poisson distribution of the whole rate), so it depends on nothing but them, and the mix is the same on any cluster. Documents
are exploded by their counts and shuffled globally by a hash of (seed, doc_id, copy).

Rates come from partial counts for each source and reach the documents by a join. Up to
``few_sources`` sources (each a name and an array of some dozens of doubles) are broadcast after their
number is checked; more go through a join that Spark splits where a source is large.

A null source is a source of its own. A null doc_id hashes as the text 'null'; rows that share a doc_id
get the same count. Sources without a target weight get weight 0 where targets are given. Empty tables
give empty mixes. Weights are normalised over the sources that the table has.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEW_SOURCES = 10_000
#: Mean of a single draw at most: exp(-rate) stays a normal double, and the distribution function short.
MOST = 600
#: Copies of a row that are made at once.
BLOCK = 1 << 12
NULL = "\x00null"


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_cdf(rate: Column) -> Column:
    """The distribution function at 0, 1, 2, ... until beyond the reach of 52 bits."""
    steps = F.sequence(F.lit(1), (rate + 12 * F.sqrt(rate) + 30).cast("int"))
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(steps, start, step)["cdf"]


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 17, few_sources: int = FEW_SOURCES, epochs: float = 1.0) -> DataFrame:
    """The columns of ``docs`` with ``copy`` (1, 2, ...) and ``mix_key``, in the order of ``mix_key``.

    ``weights``: target share by source; by default all sources weigh the same. ``epochs``: the size of
    the mix in units of the table. Columns of ``docs`` with these two names are replaced.
    """
    named = [c for c in docs.columns if c not in ("copy", "mix_key")]
    rows = mixed(docs, weights, seed, few_sources, epochs)
    return rows.select(*[F.col(f"c{docs.columns.index(c)}").alias(c) for c in named], "copy", "mix_key")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix with exactly the columns of ``docs``."""
    return mixed(docs, **options).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 17, few_sources: int = FEW_SOURCES, epochs: float = 1.0) -> DataFrame:
    """The mix in order, with the columns of ``docs`` as c0, c1, ... so that no name can clash."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: plain[i] for i, c in enumerate(docs.columns)}
    docs = docs.toDF(*plain)
    doc_id, source = F.col(at["doc_id"]), F.col(at["source"])
    name = F.coalesce(source.cast("string"), F.lit(NULL))
    counts = docs.groupBy(name.alias("mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for s, w in weights.items():
            weight = F.when(F.col("mix_source") == (NULL if s is None else s), F.lit(float(w))).otherwise(weight)
    weighed = counts.select("mix_source", "n", weight.alias("w"))
    total = weighed.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("sources")).first()
    rate = F.col("w") * (epochs * (total["n"] or 0) / (total["w"] or 1.0)) / F.col("n")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST).cast("int"))
    cdfs = weighed.select("mix_source", rate.alias("rate")).select("mix_source", "rate", parts.alias("mix_parts")).select("mix_source", "mix_parts", poisson_cdf(F.col("rate") / F.col("mix_parts")).alias("mix_cdf"))
    if total["sources"] <= few_sources:
        cdfs = F.broadcast(cdfs)
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    joined = docs.select(*plain, name.alias("mix_source"), uniform(F.lit(str(seed)), key).alias("mix_u")).join(cdfs, "mix_source")
    drawn = lambda u: F.size(F.filter("mix_cdf", lambda c: u >= c))
    more = F.transform(F.sequence(F.lit(1), F.col("mix_parts")), lambda i: uniform(F.lit(str(seed)), F.lit("draw"), i.cast("string"), key))
    count = F.when(F.col("mix_parts") == 1, drawn(F.col("mix_u"))).otherwise(F.aggregate(more, F.lit(0), lambda n, u: n + drawn(u)))
    blocks = joined.select(*plain, count.alias("mix_count")).filter("mix_count > 0").select(*plain, "mix_count", F.explode(F.sequence(F.lit(1), F.col("mix_count"), F.lit(BLOCK))).alias("mix_first"))
    copies = blocks.select(*plain, F.explode(F.sequence(F.col("mix_first"), F.least(F.col("mix_count"), F.col("mix_first") + (BLOCK - 1)))).alias("copy"))
    return copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(str(seed)), key, F.col("copy").cast("string")))).orderBy("mix_key", doc_id)


MIX_SQL = """
WITH RECURSIVE counts AS (SELECT coalesce(source, chr(0) || 'null') AS s, count(*) AS n FROM documents GROUP BY 1),
total AS (SELECT sum(n)::DOUBLE AS n, count(*)::DOUBLE AS w FROM counts),
whole AS (SELECT s, (total.n / total.w) / counts.n AS rate FROM counts, total),
rates AS (SELECT s, greatest(1, ceil(rate / 600))::INTEGER AS parts, rate / greatest(1, ceil(rate / 600)) AS rate FROM whole),
cdf AS (
  SELECT s, parts, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT s, parts, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k + 1 <= floor(rate + 12 * sqrt(rate) + 30)
),
cdfs AS (SELECT s, parts, list(c ORDER BY k) AS cs FROM cdf GROUP BY s, parts),
drawn AS (
  SELECT d.*, CASE WHEN parts = 1 THEN len(list_filter(cs, lambda c: u >= c)) ELSE (
    SELECT sum(len(list_filter(cs, lambda c: ('0x' || substr(md5('17:draw:' || i || ':' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 >= c))) FROM (SELECT unnest(range(1, parts + 1)) AS i)
  ) END::BIGINT AS m FROM (
    SELECT *, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents
  ) d JOIN cdfs ON s = coalesce(source, chr(0) || 'null')
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR) AS mix_key
FROM (SELECT *, unnest(range(1, m + 1)) AS copy FROM drawn WHERE m > 0)
"""
