"""The near_dedup stage against the Jaccard similarity of all pairs."""

import random

from brute_groups import near_groups

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_copies_at_five_words(spark):
    r = random.Random(9)
    texts = []
    for _ in range(25):
        base = [f"w{r.randrange(10**5)}" for _ in range(r.choice([60, 200, 400]))]
        texts.append(base)
        for changed in (0.004, 0.01, 0.015, 0.02, 0.03, 0.08):
            texts.append([w if r.random() > changed else f"n{r.randrange(10**5)}" for w in base])
    texts += [[], ["lone"], ["a", "b", "c"]]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    kept = {x.doc_id for x in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()}
    label = near_groups(rows)
    assert len(set(label.values())) < len(rows) and kept == {i for i, x in label.items() if x == i}


def test_loose_clusters_are_linked_exactly(spark):
    """Variants of one template, most pairs of which are a little below or above the threshold."""
    r = random.Random(2)
    rows = []
    for c in range(4):
        base = [f"c{c}w{i}" for i in range(120)]
        for _ in range(25):
            words = list(base)
            for _ in range(r.randint(0, 5)):
                words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(words), "en", "s", 1))
    label = near_groups(rows)
    assert 4 < len(set(label.values())) < len(rows) - 4
    kept = {x.doc_id for x in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()}
    assert kept == {i for i, x in label.items() if x == i}


def test_a_common_passage_alone_links_nothing(spark):
    """Texts that share a passage, some of them near copies of each other at that: prefixes find these and no others."""
    r = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for _ in range(60):
        words = passage + [f"o{r.randrange(10**6)}" for _ in range(r.randint(8, 30))]
        rows.append((len(rows), " ".join(words), "en", "s", 1))
        if r.random() < 0.3:
            words[r.randrange(len(words))] = "changed"
            rows.append((len(rows), " ".join(words), "en", "s", 1))
    label = near_groups(rows)
    assert 3 < len(rows) - len(set(label.values())) < 40
    kept = {x.doc_id for x in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()}
    assert kept == {i for i, x in label.items() if x == i}


def test_hubs_meet_every_later_member():
    """Over all rounds each pair of a bucket meets once, whatever the batches."""
    import numpy as np
    import pyarrow as pa

    from ledgerlens.llm import near_jaccard as nj

    r = random.Random(5)
    members = sorted((k, bytes([k, i])) for k in range(6) for i in range(r.choice([1, 2, 7, 30])))
    sig = bytes(nj.PLACES)
    met, hubs = [], 1
    rows = members
    while rows:
        table = pa.table({"key": pa.array([k for k, _ in rows], pa.int64()), "digest": pa.array([d for _, d in rows], pa.binary()), "node": pa.array([d[0] * 100 + d[1] for _, d in rows], pa.int64()), "size": pa.array([10] * len(rows), pa.int64()), "pos": pa.array([1] * len(rows), pa.int64()), "sig": pa.array([sig] * len(rows), pa.binary()), "comp": pa.array([d[0] * 100 + d[1] for _, d in rows], pa.int64())})
        out = pa.Table.from_batches(nj._meet(iter(table.to_batches(max_chunksize=r.choice([1, 4, 100]))), hubs, 0.8)).to_pylist()
        met += [(x["hub"], x["digest"]) for x in out if x["hub"]]
        rows = [(x["key"], x["digest"]) for x in out if not x["hub"]]
        hubs *= 4
    want = {(a, b) for k, a in members for l, b in members if k == l and a < b}
    assert len(met) == len(set(met)) and set(met) == want
    assert np.array(met).size


def test_a_task_gives_fewer_links_than_it_has_nodes():
    """Many hubs that are all alike, each with all texts: their links must not be all pairs."""
    import pyarrow as pa

    from ledgerlens.llm import near_jaccard as nj
    from ledgerlens.llm.op10_simhash import shingle_hashes

    words = " ".join(f"w{i}" for i in range(200))
    rows = []
    for hub in range(20):
        rows.append((False, hub, hub, f"{words} h{hub}"))
        rows += [(True, hub, node, f"{words} s{node}" if node % 10 else f"unlike {node} " * 9) for node in range(100, 150)]
    table = pa.table({name: [row[i] for row in rows] for i, name in enumerate(("spoke", "hub_node", "node", "text"))})
    found = pa.Table.from_batches(nj._compare(iter(table.to_batches(max_chunksize=64)), lambda t: shingle_hashes(t, nj.WORDS, 42), 0.8)).to_pylist()
    label = {n: n for row in rows for n in row[1:3]}
    for x in found:
        one, other = label[x["a"]], label[x["b"]]
        label = {n: one if y == other else y for n, y in label.items()}
    linked = [n for n in label if n < 100 or n % 10]
    assert len({label[n] for n in linked}) == 1 and len(set(label.values())) == 1 + len(label) - len(linked)
    assert len(found) == len(linked) - 1


def test_links_of_a_loose_group_stay_fewer_than_its_copies(spark, monkeypatch):
    """What is known to be linked, by SimHash or by a step before, is not compared or linked again."""
    from ledgerlens.llm import near_jaccard as nj

    r = random.Random(500)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(500):
        words = list(base)
        for _ in range(r.randint(0, 9)):
            words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "s", 1))
    links, write = [], nj.written

    def written(df, name):
        out = write(df, name)
        if name == "jaccard-links":
            links.append(out.count())
        return out

    monkeypatch.setattr(nj, "written", written)
    kept = {x.doc_id for x in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()}
    label = near_groups(rows)
    assert kept == {i for i, x in label.items() if x == i}
    assert links and 2 * sum(links) < len(rows) - len(kept)
