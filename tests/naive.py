"""Plain models of what the operators compute."""

from collections import Counter
from math import log2


def densify(raw):
    words = sorted(set(raw))
    return [words.index(v) + 1 for v in raw]


def successors(t):
    counts = Counter(zip(t, t[1:]))
    out = {}
    for a in set(t):
        ranked = sorted((-c, b) for (x, b), c in counts.items() if x == a)
        for rk, (c, b) in enumerate(ranked, 1):
            out[a, b] = (-c, rk)
    return out


def suffix_array(t):
    return sorted(range(len(t)), key=lambda k: t[k:])


def lcp(t):
    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    sa = suffix_array(t)
    return [0, *(common(t[a:], t[b:]) for a, b in zip(sa, sa[1:]))][: len(t)]


def count(t, p):
    return sum(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1)) if p else len(t)


def entropy(t):
    return -sum(c / len(t) * log2(c / len(t)) for c in Counter(t).values()) if t else 0.0
