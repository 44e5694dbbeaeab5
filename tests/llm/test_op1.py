"""Suffix dedup against a dictionary of all windows."""

import hashlib
import random

import numpy as np

from ledgerlens.llm import op1_suffix
from ledgerlens.llm.op1_suffix import GRAM, LENGTH, STOP, merge, pack_run, read_run, suffix_dedup, window_minima

SCHEMA = "doc_id long, text string, g string"


def brute(rows):
    first = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - LENGTH + 1):
            w = b[i : i + LENGTH]
            first[w] = min(first.get(w, d), d)
    out = set()
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * (len(b) + 1)
        for i in range(len(b) - LENGTH + 1):
            if first[b[i : i + LENGTH]] < d:
                gone[i : i + LENGTH] = [True] * LENGTH
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.add((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def cases():
    r = random.Random(5)
    words = ["the", "of", "süß", "éa", "tion", "and", "x", "ing"]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [make(r.randint(0, 120)) for _ in range(25)]
    line = make(40)
    rows = [(i, t, "") for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 25], "") for i in range(30)]
    rows += [(200 + i, make(r.randint(0, 30)) + line + make(r.randint(0, 30)), "") for i in range(60)]
    rows += [(300, None, ""), (301, "", ""), (302, "a" * 400, ""), (303, "a" * 173, ""), (304, "ab" * 300 + line, ""), (305, line[:49], ""), (306, line[:50], ""), (-7, line, "")]
    rows += [(310, make(30000) + line, ""), (311, line * 3, "")]
    r.shuffle(rows)
    return rows


def test_against_all_windows(spark):
    rows = cases()
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5)).drop("removed").collect()
    assert {tuple(x) for x in got} == brute(rows)
    assert len(got) == len(rows)


def test_repeated_ids_and_nulls(spark):
    t = "0123456789" * 9
    rows = [(1, t, ""), (1, t, ""), (None, t, ""), (2, None, "")]
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.n_removed) for x in suffix_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(False, 0, 0), (True, 1, 90), (True, 1, 90), (True, 2, 0)]


def test_many_nameless_rows_and_clashing_columns(spark):
    t = "0123456789" * 9
    rows = [(None, f"{i} {t}", "x", "y") for i in range(20)] + [(5, t, "x", "y")]
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string, bucket string, removed string")).collect()
    assert len(got) == 21 and [x.n_removed for x in got if x.doc_id == 5] == [90] and not any(x.n_removed for x in got if x.doc_id is None)


def test_windows_by_common_prefixes_are_the_windows():
    """Suffixes of a small alphabet, many of them with common parts on both sides of one anchor."""
    r = random.Random(4)
    for _ in range(60):
        grams = [bytes(r.choices(b"ab", k=GRAM)) for _ in range(3)]
        keys = set()
        for _ in range(r.randint(1, 60)):
            o1, o2 = sorted(r.choices(range(LENGTH - GRAM + 1), k=2))  # the windows start o2 to o1 bytes before the anchor
            right = (r.choice(grams) + bytes(r.choices(b"cd", weights=[9, 1], k=LENGTH)))[: LENGTH - o1]
            keys.add(right + STOP + bytes(r.choices(b"ef", weights=[9, 1], k=o2)))
        keys = sorted(keys)
        docs = [r.randrange(9) for _ in keys]
        shared = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(keys, keys[1:])]
        windows, first = [], {}
        for k, d in zip(keys, docs):
            right, left = k.split(STOP)
            text = left[::-1] + right
            windows.append([(right[:GRAM], len(left) - j, text[j : j + LENGTH]) for j in range(len(text) - LENGTH + 1)])
            for w in windows[-1]:
                first[w] = min(first.get(w, d), d)
        n, size, doc = window_minima(keys, shared, docs)
        flat, at = np.repeat(doc, size).tolist(), 0
        for own, pieces in zip(windows, n):
            assert flat[at : at + len(own)] == [first[w] for w in own] and pieces >= 1
            at += len(own)
        assert at == len(flat)


def test_runs_of_one_suffix_are_judged_together():
    got = op1_suffix.judge([pack_run([b"a" * LENGTH + STOP], np.array([d])) for d in (3, 1)])
    assert [op1_suffix.read_verdict(x)[2].tolist() for x in got] == [[1], [1]]


def test_empty(spark):
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_merge_of_runs():
    r = random.Random(3)
    runs = [sorted({bytes(r.choices(b"ab", k=r.randint(1, 12))) for _ in range(r.randint(1, 60))}) for _ in range(7)]
    got = list(merge([read_run(pack_run(x, np.zeros(len(x), np.int64))) for x in runs]))
    assert [k for _, k, _, _ in got] == sorted(x for run in runs for x in run)
    for (_, a, _, _), (lcp, b, _, _) in zip(got, got[1:]):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp == n
