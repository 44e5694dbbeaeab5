"""Brute-force near-duplicate groups by all pairs of texts."""

from test_op10 import brute_fp


def grams(text):
    """The set of five-word shingles."""
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_groups(rows):
    """doc_id -> smallest doc_id reachable by fingerprints within four bits or shingle sets at 0.8 or more."""
    ids, sets, fps = [r[0] for r in rows], [grams(r[1]) for r in rows], [brute_fp(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and ((fps[i] ^ fps[j]).bit_count() <= 4 or sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    least = {}
    for i, x in zip(ids, label):
        least[x] = min(least.get(x, i), i)
    return {i: least[x] for i, x in zip(ids, label)}
