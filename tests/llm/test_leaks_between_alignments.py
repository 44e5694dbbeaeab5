"""Windows that lie between the alignments of an item's two halves."""

import random

import pytest
from test_rows import DOCS, brute_leaks

from ledgerlens.llm import op4_decontaminate as op4


def planted(size, ends, inserted, seed=1):
    """An item, and a document with it: ``ends`` words changed at both ends, ``inserted`` put in the middle."""
    r = random.Random(seed)
    item = [f"w{r.randrange(10**6)}" for _ in range(size)]
    text = [f"x{i}" for i in range(ends)] + item[ends : size // 2] + [f"y{i}" for i in range(inserted)] + item[size // 2 : size - ends] + [f"z{i}" for i in range(ends)]
    return " ".join(item), " ".join([f"a{i}" for i in range(70)] + text + [f"b{i}" for i in range(70)])


@pytest.mark.parametrize(("size", "ends", "inserted"), [(59, 1, 2), (100, 3, 1), (100, 3, 6), (200, 2, 9)])
def test_against_all_windows(size, ends, inserted):
    item, text = planted(size, ends, inserted)
    found = op4.Index([(7, item)]).match(text)
    want = brute_leaks([(0, text)], [(7, item)])
    assert want == {(0, found is not None, found[0] if found else None, found[2] if found else 0)}


def test_the_reviewed_case_is_a_leak(spark):
    item, text = planted(59, 1, 2)
    got = op4.leaks(spark.createDataFrame([(1, text, "", "", 0, "", "")], DOCS), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(x.contaminated, x.item_id, round(x.similarity, 3)) for x in got] == [(True, 7, 0.803)]


def test_random_edits():
    r = random.Random(3)
    for _ in range(150):
        vocabulary = [f"w{i}" for i in range(r.choice([2, 5, 300]))]
        items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([3, 5, 9, 25, 59])]
        words = r.choice(items)[1].split()
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(words))
            words[at : at + r.randint(0, 1)] = [f"n{r.randrange(9)}"] * r.randint(0, 2)
        text = " ".join([r.choice(vocabulary) for _ in range(r.randint(0, 9))] + words + [r.choice(vocabulary) for _ in range(r.randint(0, 9))])
        found = op4.Index(items).match(text)
        assert {(0, found is not None, found[0] if found else None, found[2] if found else 0)} == brute_leaks([(0, text)], items)
