"""SimHash groups against all pairs."""

import random
import re

import numpy as np
import xxhash

from ledgerlens.llm import op10_simhash as op

SCHEMA = "doc_id long, text string, fp string"


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [(d, brute_fp(t)) for d, t, *_ in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and ((fps[i][1] ^ fps[j][1]).bit_count() <= 4 or fps[i][0] == fps[j][0]):
                    a, b = label[i], label[j]
                    label = [min(a, b) if x in (a, b) else x for x in label]
                    changed = True
    least = {}
    for (d, _), x in zip(fps, label):
        least[x] = min(least.get(x, d), d)
    return {(d, f"{f:016x}", least[x]) for (d, f), x in zip(fps, label)}


def test_against_all_pairs(spark):
    r = random.Random(1)
    make = lambda n: " ".join(r.choice(["Ab", "cd", "ÉF", "gh", "Ij"]) + str(r.randint(0, 9)) for _ in range(n))
    rows = [(i, make(r.choice([1, 2, 3, 4, 5, 90])), "x") for i in range(60)]
    for i in range(60):
        words = rows[i][1].split(" ")
        if r.random() < 0.7 and len(words) > 20:
            words[r.randrange(len(words))] = "changed"
        rows.append((1000 - i, "\t".join(words).swapcase() if i % 2 else " ".join(words), "y"))
    rows += [(2000, None, ""), (2001, "", ""), (2002, " \n", ""), (-5, "\x0b", ""), (2003, "lone", ""), (2003, "other words of the same id here", ""), (2004, make(20000), "")]
    r.shuffle(rows)
    got = op.near_groups(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {tuple(x) for x in got} == brute(rows)
    assert len(got) == len(rows)


def test_masks_cover_every_pair():
    r = random.Random(2)
    for within in ((1 << 64) - 1, 0x0F0FFFFF12345678):
        masks = op.covering_masks(4, within)
        places = [i for i in range(64) if within >> i & 1]
        for _ in range(3000):
            diff = sum(1 << i for i in r.sample(places, r.randint(0, 4)))
            assert any(not diff & m for m in masks)


def test_large_buckets_are_dealt_again(spark):
    r = random.Random(4)
    centre = r.getrandbits(64)
    fps = list({centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(300)} | {r.getrandbits(64) for _ in range(100)})
    rows = [(op.signed(f), i) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "fp long, rep long")

    def groups(limit):
        comp = {x.node: x.component for x in op.components(op.links(df, 4, limit)).collect()}
        return [comp.get(i, i) for i in range(len(fps))]

    a = np.array(fps, np.uint64)
    label = list(range(len(fps)))
    for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 4)):
        x, y = label[i], label[j]
        if x != y:
            label = [min(x, y) if z in (x, y) else z for z in label]
    assert groups(1 << 18) == label
    assert groups(5) == label


def test_dealing_goes_on_until_buckets_fit(spark, monkeypatch):
    r = random.Random(7)
    fps = list({sum(1 << b for b in r.sample(range(30), r.randint(0, 5))) for _ in range(400)})
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    rounds, deal = [], op.written
    monkeypatch.setattr(op, "written", lambda d, n: rounds.append(n) or deal(d, n))
    comp = {x.node: x.component for x in op.components(op.links(df, 4, 3)).collect()}
    a = np.array(fps, np.uint64)
    label = list(range(len(fps)))
    for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 4)):
        x, y = label[i], label[j]
        if x != y:
            label = [min(x, y) if z in (x, y) else z for z in label]
    assert [comp.get(i, i) for i in range(len(fps))] == label and len(rounds) > 2


def test_a_long_chain_is_one_component(spark):
    n = 3000
    got = op.components(spark.range(n).selectExpr("id AS a", "id + 1 AS b")).collect()
    assert {x.component for x in got} == {0} and len(got) == n


def test_forest_splits_exactly(monkeypatch):
    monkeypatch.setattr(op, "DENSE", 8)
    r = random.Random(6)
    a = np.array([r.getrandbits(64) & ~0xFFF | r.getrandbits(12) for _ in range(1)] * 1, np.uint64)
    a = np.unique(np.array([int(a[0]) ^ r.getrandbits(11) for _ in range(200)], np.uint64))
    pairs = op.forest(a, 4)
    assert len(pairs) == len(a) - 1 and all((int(a[i]) ^ int(a[j])).bit_count() <= 4 for i, j in pairs)


def test_empty_and_null_ids(spark):
    assert op.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    got = op.near_groups(spark.createDataFrame([(None, "a b c d e", ""), (None, None, ""), (3, "a b c d e", "")], SCHEMA)).collect()
    assert sorted((x.doc_id or 0, x.component_id or 0) for x in got) == [(0, 0), (0, 3), (3, 3)]
    largest = (1 << 63) - 1
    got = op.near_groups(spark.createDataFrame([(largest, "one two", ""), (None, "one two", "")], SCHEMA)).collect()
    assert {x.component_id for x in got} == {largest}
