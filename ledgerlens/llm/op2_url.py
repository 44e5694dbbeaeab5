"""URL filters: rules first, then trust and distrust propagated over the host graph.

Rules (host, path) decide what they fit: the host or any subdomain, and a path that starts with the
rule's; the longest rule wins. For the rest the verdict is the host's:

* trust: personalised PageRank along links, restarted at hosts with pages that a rule allows
* distrust: the same against the links, restarted at hosts with pages that a rule blocks: who links to
  bad hosts is bad

Host edges are pre-aggregated (source host, target host, links), so a host with a third of all pages is
one row for each target. A host is blocked if distrust > ``ratio`` x trust, both in units of the mean. Rounds
go on until all hosts together change by ``tolerance`` of the mass at most; each round shrinks the change by
``damping`` or more, so there are at most log(tolerance / 2) / log(damping) of them.

Pages meet their host's scores in a left join; adaptive execution splits the pages of a hot host over tasks.

A null url, or one without ``://``, has an empty host and path, fits no rule, and gets its verdict as the
host ''. Null html has no links. page_id is carried, never compared: each row gives one row, repeated rows and
null ids alike. Of rules of one length that fit, the greater text wins. Only page_id, url and html are read,
so other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, written

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, TOLERANCE, DIGITS = 0.85, 1e-6, 4
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^/?#"'<>\s]+)"""


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the columns host and path; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the last that fits is the longest
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) over different hosts."""
    found = pages.select("host", F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), 1)).alias("link"))
    edges = found.select(F.col("host").alias("src"), F.translate(F.regexp_extract("link", r"//(.*)$", 1), UPPER, LOWER).alias("dst"))
    return edges.filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def most_rounds(damping: float, tolerance: float) -> int:
    """Rounds after which the change is below the tolerance whatever the graph."""
    return math.ceil(math.log(tolerance / 2) / math.log(damping))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust), settled to ``tolerance``.

    ``hosts``: host, allowed, blocked (pages by rule). What has no way on restarts at the seeds. Each
    round is a join and a partial aggregation over host edges; its small result is checkpointed.
    """
    total = hosts.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"), F.count("*").alias("n")).first()
    ends = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host"))).distinct()
    n_all = hosts.join(ends, "host", "full_outer").select("host").distinct().count()
    seed = lambda col, whole: (F.coalesce(F.col(col), F.lit(0)) * (n_all / whole) if whole else F.lit(0.0)).cast("double")
    out = edges.groupBy(F.col("src").alias("host")).agg(F.sum("n").alias("out_n"))
    back = edges.groupBy(F.col("dst").alias("host")).agg(F.sum("n").alias("in_n"))
    state = hosts.join(ends, "host", "full_outer").select("host", seed("allowed", total["a"]).alias("seed_t"), seed("blocked", total["b"]).alias("seed_d"))
    state = checkpointed(state.join(out, "host", "left").join(back, "host", "left").select("*", F.col("seed_t").alias("trust"), F.col("seed_d").alias("distrust")))
    if not edges.limit(1).count():
        return state.select("host", "trust", "distrust")
    while True:
        lost = state.agg(F.sum(F.when(F.col("out_n").isNull(), F.col("trust"))).alias("t"), F.sum(F.when(F.col("in_n").isNull(), F.col("distrust"))).alias("d")).first()
        forth = state.filter("trust > 0").select(F.col("host").alias("src"), (F.col("trust") / F.col("out_n")).alias("x")).join(edges, "src").select(F.col("dst").alias("host"), (F.col("x") * F.col("n")).alias("t"), F.lit(0.0).alias("d"))
        against = state.filter("distrust > 0").select(F.col("host").alias("dst"), (F.col("distrust") / F.col("in_n")).alias("x")).join(edges, "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("x") * F.col("n")).alias("d"))
        got = forth.unionByName(against).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        back_t, back_d = (lost["t"] or 0.0) / n_all, (lost["d"] or 0.0) / n_all
        new = lambda got, old, back: F.col(old) * ((1 - damping) + damping * back) + F.coalesce(F.col(got), F.lit(0.0)) * damping
        moved = (F.abs(new("t", "seed_t", back_t) - F.col("trust")) + F.abs(new("d", "seed_d", back_d) - F.col("distrust"))).alias("moved")
        state = checkpointed(state.join(got, "host", "left").select("host", "seed_t", "seed_d", "out_n", "in_n", new("t", "seed_t", back_t).alias("trust"), new("d", "seed_d", back_d).alias("distrust"), moved))
        if state.agg(F.sum("moved")).first()[0] <= tolerance * n_all:
            return state.select("host", "trust", "distrust")


def url_verdicts(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, ratio: float = 1.0, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust (of its host)."""
    url, (rule, verdict) = F.col("url").cast("string"), rule_of(rules)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html")).select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    judged = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("fixed"))
    counted = judged.groupBy("host").agg(F.sum((F.col("fixed") == "allow").cast("long")).alias("allowed"), F.sum((F.col("fixed") == "block").cast("long")).alias("blocked"))
    hosts = written(counted.select("host", F.coalesce("allowed", F.lit(0)).alias("allowed"), F.coalesce("blocked", F.lit(0)).alias("blocked")), "url-hosts")
    edges = written(host_edges(base), "url-edges")
    scores = propagate(hosts, edges, damping, tolerance)
    by_host = scores.select("host", F.round("trust", DIGITS).alias("trust"), F.round("distrust", DIGITS).alias("distrust"))
    host_verdict = F.when((F.col("distrust") > 0) & (F.col("distrust") > ratio * F.col("trust")), "block").otherwise("allow")
    return judged.join(by_host, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("fixed", host_verdict).alias("verdict"), "trust", "distrust")


def url_sql(rules: tuple[tuple[str, str, str], ...] = RULES, ratio: float = 1.0, damping: float = DAMPING, tolerance: float = TOLERANCE) -> str:
    """The same for DuckDB, with as many rounds as any graph can take."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, ordered, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, ordered, strict=True)) + " END"
    link = LINK.replace("'", "''")
    return f"""
WITH RECURSIVE cut AS (SELECT page_id, html, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
base AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS fixed FROM base),
counted AS (SELECT host, count(*) FILTER (fixed = 'allow') AS allowed, count(*) FILTER (fixed = 'block') AS blocked FROM judged GROUP BY 1),
links AS (SELECT host AS src, translate(regexp_extract(link, '//(.*)$', 1), '{UPPER}', '{LOWER}') AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM base)),
edges AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
hosts AS (SELECT host FROM counted UNION SELECT src FROM edges UNION SELECT dst FROM edges),
whole AS (SELECT (SELECT count(*) FROM hosts) AS n, (SELECT sum(allowed) FROM counted) AS a, (SELECT sum(blocked) FROM counted) AS b),
seeds AS (SELECT h.host, coalesce(coalesce(allowed, 0) * (n / nullif(a, 0)), 0)::DOUBLE AS seed_t, coalesce(coalesce(blocked, 0) * (n / nullif(b, 0)), 0)::DOUBLE AS seed_d,
  (SELECT sum(n) FROM edges WHERE src = h.host) AS out_n, (SELECT sum(n) FROM edges WHERE dst = h.host) AS in_n FROM hosts h CROSS JOIN whole LEFT JOIN counted ON counted.host = h.host),
state AS (
  SELECT 0 AS k, host, seed_t, seed_d, out_n, in_n, seed_t AS trust, seed_d AS distrust FROM seeds
  UNION ALL
  SELECT s.k + 1, s.host, seed_t, seed_d, out_n, in_n, seed_t * ({1 - damping} + {damping} * lt) + {damping} * coalesce(t.x, 0), seed_d * ({1 - damping} + {damping} * ld) + {damping} * coalesce(d.x, 0)
  FROM state s
  CROSS JOIN (SELECT coalesce(sum(trust) FILTER (out_n IS NULL), 0) / max(whole.n) AS lt, coalesce(sum(distrust) FILTER (in_n IS NULL), 0) / max(whole.n) AS ld FROM state, whole) lost
  LEFT JOIN (SELECT e.dst AS host, sum(trust / out_n * e.n) AS x FROM state JOIN edges e ON e.src = state.host GROUP BY 1) t ON t.host = s.host
  LEFT JOIN (SELECT e.src AS host, sum(distrust / in_n * e.n) AS x FROM state JOIN edges e ON e.dst = state.host GROUP BY 1) d ON d.host = s.host
  WHERE s.k < {most_rounds(damping, tolerance)}
),
last AS (SELECT host, round(trust, {DIGITS}) AS trust, round(distrust, {DIGITS}) AS distrust FROM state WHERE k = {most_rounds(damping, tolerance)})
SELECT page_id, j.host, path, rule, coalesce(fixed, CASE WHEN distrust > 0 AND distrust > {ratio} * trust THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust
FROM judged j LEFT JOIN last ON last.host = j.host
"""
