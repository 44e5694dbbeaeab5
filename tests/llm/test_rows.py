"""URL filter, decontamination, mixing, exact dedup and the pipeline against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from ledgerlens.llm import op2_url as op2
from ledgerlens.llm import op4_decontaminate as op4
from ledgerlens.llm import op5_mix as op5
from ledgerlens.llm import op6_language as op6
from ledgerlens.llm import op7_exact as op7
from ledgerlens.llm import op10_simhash as op10

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, host string, verdict string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy string, mix_key string"


# URL filter -------------------------------------------------------------------------------------------


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in op2.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute_scores(rows, damping=0.85, rounds=300):
    hosts, edges = {}, Counter()
    for _, url, html, *_ in rows:
        host, path = parts(url)
        v = rule(host, path)[1]
        a = hosts.setdefault(host, [0, 0])
        a[0] += v == "allow"
        a[1] += v == "block"
        for link in re.findall(r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'<>\s]+)""", html or ""):
            if host and link.lower() != host:
                edges[host, link.lower()] += 1
    names = sorted({*hosts, *(x for e in edges for x in e)})
    n = len(names)

    def walk(seeds, edges):
        total = sum(seeds.values())
        seed = {h: seeds.get(h, 0) * n / total if total else 0.0 for h in names}
        out = Counter()
        for (a, _), k in edges.items():
            out[a] += k
        x = dict(seed)
        for _ in range(rounds if edges else 0):
            lost = sum(v for h, v in x.items() if not out[h]) / n
            new = {h: seed[h] * (1 - damping + damping * lost) for h in names}
            for (a, b), k in edges.items():
                new[b] += damping * x[a] * k / out[a]
            x = new
        return x

    trust = walk({h: a for h, (a, _) in hosts.items()}, edges)
    distrust = walk({h: b for h, (_, b) in hosts.items()}, Counter({(b, a): k for (a, b), k in edges.items()}))
    return trust, distrust


def brute_pages(rows):
    trust, distrust = brute_scores(rows)
    out = []
    for page, url, *_ in rows:
        host, path = parts(url)
        r, v = rule(host, path)
        t, d = round(trust[host], 4), round(distrust[host], 4)
        out.append((page, host, path, r, v or ("block" if d > 0 and d > t else "allow")))
    return sorted(out, key=repr)


def test_urls(spark):
    r = random.Random(3)
    hosts = ["a.com", "B.com", "x.example.org", "example.org", "org", "evilorg", "c.net", "d.net", "e.net", "com"]
    paths = ["", "/", "/fr/1", "/de/2", "/es/", "/en/1", "/en/12?x=/fr/", "#/de/", "?q", "/EN/1"]
    rows = [(i, f"http{r.choice(['', 's'])}://{r.choice(hosts)}{r.choice(paths)}", " ".join(f'<a href="https://{r.choice(hosts)}/z">' for _ in range(r.randint(0, 3))), "", "") for i in range(150)]
    rows += [(200, None, None, "", ""), (201, "", "", "", ""), (202, "no-scheme.com/fr/", "<a href='//c.net'>", "", ""), (203, "x://", None, "", ""), (204, "http://É.ORG/\nfr", "", "", ""), (204, "http://E.org/", "", "", ""), (None, "http://a://b", "", "", ""), (205, "http://d.net/" + "p" * 50000, "y" * 50000, "", "")]
    got = op2.url_verdicts(spark.createDataFrame(rows, PAGES).repartition(3)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=repr) == brute_pages(rows)
    lone = [row for row in rows if row[0] and row[0] >= 200]
    assert sorted(map(tuple, op2.url_verdicts(spark.createDataFrame(lone, PAGES)).select("page_id", "host", "path", "rule", "verdict").collect()), key=repr) == brute_pages(lone)
    assert op2.url_verdicts(spark.createDataFrame([], PAGES)).count() == 0


def test_a_long_chain_of_links_settles(spark):
    """Sixteen hosts in a row lead to a blocked one; the far end has a page that a rule allows."""
    rows = [(0, "http://x.com/de/1", "", "", "")] + [(i, f"http://h{i}.net/", f"<a href='http://{'x.com' if i == 1 else f'h{i - 1}.net'}/'>", "", "") for i in range(1, 17)] + [(50, "http://far.org/", "<a href='http://h16.net/'>", "", "")]
    got = op2.url_verdicts(spark.createDataFrame(rows, PAGES)).collect()
    trust, distrust = brute_scores(rows)
    assert all(abs(x.trust - trust[x.host]) < 2e-4 and abs(x.distrust - distrust[x.host]) < 2e-4 for x in got)
    assert sorted(((x.page_id, x.host, x.path, x.rule, x.verdict) for x in got), key=repr) == brute_pages(rows)
    assert all(x.trust > 0 and x.distrust > 0 for x in got)


def test_the_sql_propagates_the_same(spark):
    import duckdb

    r = random.Random(5)
    hosts = ["a.com", "x.example.org", "example.org", "c.net", "d.net", "e.net", "f.net"]
    rows = [(i, f"http://{r.choice(hosts)}{r.choice(['/', '/fr/1', '/de/2', '/es/'])}", " ".join(f'<a href="https://{r.choice(hosts)}/z">' for _ in range(r.randint(0, 2))), "", "") for i in range(60)]
    pages = spark.createDataFrame(rows, PAGES).drop("host", "verdict")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.sql(op2.url_sql()).fetchall()
    got = [tuple(x) for x in op2.url_verdicts(pages).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust").collect()]
    key = lambda x: (*map(str, x[:5]), round(x[5], 3), round(x[6], 3))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len({x[4] for x in got}) == 2


# decontamination --------------------------------------------------------------------------------------


def brute_leaks(docs, items, threshold=0.8):
    words = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", (t or "").lower()).split()
    out = set()
    for d, t, *_ in docs:
        w, best = words(t), []
        for i, x in items:
            q = words(x)
            if not q:
                continue
            k = min(5, len(q))
            grams = lambda ws, k=k: Counter(tuple(ws[j : j + k]) for j in range(len(ws) - k + 1))
            scores = [sum((a & b).values()) / max(1, sum((a | b).values())) for s in range(max(1, len(w) - len(q) + 1)) for a, b in [(grams(w[s : s + len(q)]), grams(q))]]
            if max(scores, default=0) >= threshold:
                best.append((-max(scores), i))
        out.add((d, bool(best), min(best)[1] if best else None, len(best)))
    return out


@pytest.mark.parametrize("block_items", [20_000, 3])
def test_leaks(spark, block_items):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünder", "ÉTÉ"]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([2, 4, 5, 6, 20, 40, 60, 60])] + [(8, ""), (9, None), (10, "a a a a a a a a")]
    docs = [(i, make(r.randint(0, 60)), "", "", 0, "", "") for i in range(25)]
    for i in range(30):
        text = items[r.choice([4, 5, 6, 7, 10])][1].split()
        for _ in range(r.randint(0, 2)):
            at = r.randrange(len(text))
            text[at : at + r.randint(0, 1)] = ["new"] * r.randint(0, 1)
        docs.append((100 + i, make(r.randint(0, 30)) + "\n" + ",\t".join(text).upper() + " " + make(r.randint(0, 30)), "", "", 0, "", ""))
    docs += [(200, None, None, None, None, None, None), (201, "", "", "", 0, "", ""), (202, "other " * 20000 + items[6][1], "", "", 0, "", ""), (202, "a a a a a a a", "", "", 0, "", "")]
    bench = spark.createDataFrame(items + [items[4]], "item_id long, text string")
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    got = {(x.doc_id, x.contaminated, x.item_id, x.n_items) for x in op4.leaks(df, bench, block_items=block_items).collect()}
    assert got == brute_leaks(docs[:-2], items) | {(202, True, 6, 1)} | brute_leaks(docs[-1:], items)
    kept = op4.clean(df, bench, block_items=block_items)
    assert kept.columns == df.columns and kept.count() == sum(not x[1] for x in op4.leaks(df, bench).select("doc_id", "contaminated").collect())
    assert op4.leaks(df.limit(0), bench).count() == 0
    assert op4.leaks(df, bench.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize("radius", [0, 3, 17, 20])
def test_block_index_finds_all_within_the_radius(radius):
    r = random.Random(1)
    sizes = [20] * 150 + [21] * 50
    fps = np.array([r.getrandbits(64) for _ in sizes], np.uint64)
    index = op4.HammingIndex(fps, sizes, radius)
    asked = np.array([int(r.choice(fps)) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, radius + 3))) for _ in range(80)], np.uint64)
    window, item = index.near(asked, 20)
    want = {(w, n) for w, x in enumerate(asked) for n in range(150) if (int(x) ^ int(fps[n])).bit_count() <= radius}
    assert set(zip(window.tolist(), item.tolist())) == want and len(window) == len(want) > 0
    assert not len(index.near(asked, 22)[0])


def edited(r, vocabulary, items):
    words = r.choice(items)[1].split()
    for _ in range(r.randint(0, 3)):
        at, to = sorted((r.randrange(len(words) + 1), r.randrange(len(words) + 1)))
        kind = r.choice(["change", "insert", "rotate", "move", "drop"])
        if kind in ("change", "drop"):
            words[at : at + 1] = [r.choice(vocabulary)] * (kind == "change")
        elif kind == "insert":
            words.insert(at, "new")
        elif kind == "rotate":
            words = words[at:] + words[:at]
        else:
            words = words[:at] + words[to:] + words[at:to]
    return " ".join([r.choice(vocabulary) for _ in range(r.randint(0, 9))] + words + [r.choice(vocabulary) for _ in range(r.randint(0, 9))])


def test_only_windows_that_cannot_pass_are_left_out():
    r = random.Random(12)
    for _ in range(60):
        vocabulary = [f"w{i}" for i in range(r.choice([3, 30, 300]))]
        items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([3, 5, 9, 25, 59, 59])]
        every, some = op4.Index(items, prune=False), op4.Index(items)
        for _ in range(5):
            text = edited(r, vocabulary, items)
            assert every.match(text) == some.match(text)


def test_the_block_index_decides(monkeypatch):
    """With an index that finds nothing, no document is contaminated; with one that finds all, what brute force finds."""
    r = random.Random(13)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(30))) for i in range(5)]
    texts = [edited(r, vocabulary, items) for _ in range(60)]
    want = [brute_leaks([(0, t)], items) for t in texts]
    as_set = lambda f: {(0, f is not None, f[0] if f else None, f[2] if f else 0)}
    assert [as_set(op4.Index(items).match(t)) for t in texts] == want
    assert [as_set(op4.Index(items, radius=64).match(t)) for t in texts] == want
    monkeypatch.setattr(op4.HammingIndex, "near", lambda self, fps, size: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert not any(op4.Index(items).match(t) for t in texts)


# mixing -----------------------------------------------------------------------------------------------


def brute_mix(docs, weights, seed=17):
    sizes = Counter(d[3] for d in docs)
    total = sum(weights(s) for s in sizes)
    out = Counter()
    for doc in docs:
        rate = weights(doc[3]) / total * len(docs) / sizes[doc[3]]
        key = "null" if doc[0] is None else str(doc[0])
        u = int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) / (1 << 52)
        p = c = math.exp(-rate)
        n = 0
        while u >= c:
            n += 1
            p *= rate / n
            c += p
        for copy in range(1, n + 1):
            out[doc[0], copy] += 1
    return out


@pytest.mark.parametrize("few", [10_000, 1])
def test_mix(spark, few):
    r = random.Random(4)
    docs = [(i, f"t{i}", None, r.choice(["big"] * 9 + ["small", None, ""]), i, "", "") for i in range(400)] + [(None, None, None, "small", None, "", ""), (7, "again", None, "big", 1, "", "")]
    df = spark.createDataFrame(docs, DOCS).drop("copy", "mix_key").repartition(4)
    for weights in (None, {"big": 1.0, "small": 3.0}, {"big": 1.0, None: 0.5}):
        of = (lambda s: 1.0) if weights is None else (lambda s, w=weights: w.get(s, 0.0))
        got = op5.mix(df, weights, few_sources=few).collect()
        assert Counter((x.doc_id, x["copy"]) for x in got) == brute_mix(docs, of)
        keys = [x.mix_key for x in got]
        assert keys == sorted(keys) and all(x.mix_key == hashlib.md5(f"17:{'null' if x.doc_id is None else x.doc_id}:{x['copy']}".encode()).hexdigest() for x in got)
    assert op5.mix(df.limit(0)).count() == 0


def test_mix_hits_the_targets(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("source"))
    n = dict(op5.mix(df, {"hot": 1.0, "cold": 3.0}).groupBy("source").count().collect())
    assert abs(n["hot"] - 5000) < 300 and abs(n["cold"] - 15000) < 600


# exact dedup ------------------------------------------------------------------------------------------


def test_exact(spark):
    r = random.Random(8)
    texts = ["a b", "ab", "a\tb\n", "", " ", None, "\x0b\x0c\r", "x y", "a b", "É", "x" * 60000, "a b  "]
    docs = [(i, r.choice(texts), "", "", 0, "", "") for i in range(200)] + [(-3, "ab", "", "", 0, "", ""), (None, "only one", "", "", 0, "", ""), (None, "ab", "", "", 0, "", "")]
    groups = {}
    for d, t, *_ in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    want = set()
    for key, rows in groups.items():
        keep = min(rows)[3]
        want |= {(d, keep, len(rows), d == keep, hashlib.sha256(key.encode()).hexdigest()) for *_, d in rows}
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    for batches in (1, 2, 4):
        assert {tuple(x) for x in op7.exact_groups(df, batches).collect()} == want
    assert op7.exact_groups(df.limit(0)).count() == 0
    twins = spark.createDataFrame([(1, "a", "", "", 0, "", ""), (1, "a", "", "", 0, "", ""), (1, " a", "", "", 0, "", ""), (2, "a", "", "", 0, "", "")], DOCS)
    got = op7.exact_groups(twins).collect()
    assert len(got) == 4 and sum(x.kept for x in got) == 1 and {x.group_size for x in got} == {4}


def test_the_filter_decides(spark, monkeypatch):
    """A filter that wrongly says no leaves copies apart; one that wrongly says yes changes nothing."""
    docs = spark.createDataFrame([(i, f"text {i % 40}", "", "", 0, "", "") for i in range(200)], DOCS)
    right = {tuple(x) for x in op7.exact_groups(docs).collect()}
    real = op7.screen
    monkeypatch.setattr(op7, "screen", lambda batch, filters: real(batch, filters).withColumn("maybe", F.lit(True)))
    assert {tuple(x) for x in op7.exact_groups(docs).collect()} == right
    monkeypatch.setattr(op7, "screen", lambda batch, filters: real(batch, filters).withColumn("maybe", F.lit(False)))
    assert {tuple(x) for x in op7.exact_groups(docs).collect()} != right


def test_exact_with_many_nameless_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "same", "d", 1) for _ in range(60)] + [((1 << 63) - 1, "same ", "d", 1), (-(1 << 63), "other", "d", 1)], "doc_id long, text string, digest string, best long")
    got = op7.exact_groups(docs, 3).collect()
    assert sum(x.kept for x in got) == 2 and {(x.keep_id, x.group_size) for x in got} == {((1 << 63) - 1, 61), (-(1 << 63), 1)}


def test_no_column_of_the_users_is_touched(spark):
    names = ["__language", "__leak0", "__id", "__fp", "__row", "leak", "language", "id", "c0", "c1", "fingerprint"]
    rows = [(i, t, "en", "s", *["mine"] * len(names)) for i, t in enumerate(["the cat and the dog", "the cat and the dog", "of the and in"])]
    rows += [(1, "again the same id", "en", "s", *["mine"] * len(names)), (None, "no id at all here", "en", "s", *["mine"] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([(1, "of the and in", "x")], "item_id long, text string, leak string")
    for out in (op6.keep(docs), op4.clean(docs, bench), op10.keep_first(docs), op10.keep_first(docs, jaccard=0.8), op5.mixed_rows(docs)):
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept and all(x[n] == "mine" for x in kept for n in names)
    assert op4.leaks(docs, bench).filter("contaminated").count() == 1


def test_filters_have_no_false_negatives():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 100, 1000, 30_000):
        keys = r.integers(0, 1 << 63, n).astype(np.uint64)
        f = op7.FuseFilter.unpack(op7.FuseFilter.build(np.concatenate((keys, keys[: n // 2]))).pack())
        assert f.has(keys).all()
        assert f.has(r.integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.001
    assert len(f.table) < 1.35 * n


# pipeline ---------------------------------------------------------------------------------------------


def test_pipeline_against_its_parts(spark):
    from brute_groups import near_groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(x) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [tuple(x) for x in docs.collect()]
    model = op6.learn(docs)
    langs, scores = model.predict(pa.array([t for _, t, *_ in rows], pa.string()))
    strange = lambda t, score: sum(c.isalpha() for c in t) >= op6.ENOUGH and score < op6.NOISE / math.sqrt(op6.DIMENSIONS)
    rows = [x for x, lang, score in zip(rows, langs, scores) if lang != "und" and not strange(x[1], score)]
    component = near_groups(rows)
    rows = [x for x in rows if component[x[0]] == x[0]]
    dirty = {d for d, bad, *_ in brute_leaks(rows, bench) if bad}
    rows = [x for x in rows if x[0] not in dirty]
    copies = brute_mix(rows, lambda s: 1.0)
    texts = {x[0]: x[1] for x in rows}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for d, _ in sorted(copies.elements()):
        ids = [*tokenizer.encode(texts[d], add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(x) for x in corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1])
    assert got == want and dirty and len(component) > len(rows)


def test_stages_keep_the_columns_and_survive_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, None, None, None, "x", "y"), (1, "", "en", "s", 0, "x", "y"), (1, "the of and to", "en", None, 3, "x", "y"), (None, "word " * 30000, None, "s", 1, "x", "y"), (3, "12 34 !!", "de", "s", 1, "x", "y")], DOCS)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert set(out.columns) == set(docs.columns), name
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
