"""Brute-force counterparts that several tests use."""

import re
from collections import defaultdict


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def shingles(text, size):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return set()
    return {tuple(found[k : k + size]) for k in range(max(1, len(found) - size + 1))}


def jaccard_groups(texts, size, threshold):
    """{id: smallest id reachable}, from all pairs that share an n-gram."""
    sets = {k: shingles(x, size) for k, x in texts.items()}
    shared, having = defaultdict(lambda: defaultdict(int)), defaultdict(list)
    for k, s in sorted(sets.items()):
        for g in s:
            for other in having[g]:
                shared[k][other] += 1
            having[g].append(k)
    root = {k: k for k in texts}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, others in shared.items():
        for b, both in others.items():
            if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in texts}
