import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import simhash as s


def fp(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, bits=3):
    root = {i: i for i in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= bits:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in fps}


def test_fingerprints():
    texts = [None, "", " \t\n", "One", "one two", "ONE two Three", "a b c d", "É é ß", "x\u00a0y z w", "a b c " * 500, " ".join(map(str, range(70_000)))]
    assert [s.fingerprint(t) for t in texts[:-1]] == [fp(t) for t in texts[:-1]]
    assert s.fingerprint(texts[-1]) == fp(texts[-1])


@pytest.mark.parametrize("size,shared", [(4, 5), (3, 4), (5, 5), (2, 3)])
def test_covering(size, shared):
    masks = s.covering(size, shared)
    sets = [{p for p in range(8) if m >> 8 * p & 255} for m in masks]
    assert all(any(c <= set(x) for c in sets) for x in combinations(range(8), shared))


@pytest.mark.parametrize("bits", [1, 3])
@pytest.mark.parametrize("limit", [20_000, 3])
def test_components(spark, monkeypatch, limit, bits):
    """Chains, dense groups and strangers; a small limit sends lists to the finer keys."""
    monkeypatch.setattr(s, "LONG_LIST", limit)
    draw = random.Random(limit + bits)
    fps, at = {}, 0
    for _ in range(12):
        x = draw.getrandbits(64)
        for _ in range(draw.choice([1, 2, 12])):
            fps[at] = x
            at += 1
            for _ in range(draw.randrange(5)):
                x ^= 1 << draw.randrange(64)
    fps |= {at: 0, at + 1: 0, at + 2: 7, at + 3: 15 << 60}
    rows = spark.createDataFrame([(i, s._signed(x)) for i, x in fps.items()], "id long, fp long")
    monkeypatch.setattr(s, "fingerprints", lambda df, *a: df)
    got = {r["id"]: r["component"] for r in s.near_duplicates(rows, bits=bits).collect()}
    assert got == classes(fps, bits)


def test_forest_is_enough():
    draw = np.random.default_rng(1)
    x = draw.integers(0, 1 << 12, size=300).astype(np.uint64)
    fps = {int(v): int(v) for v in np.unique(x)}
    links = s._list_links(np.unique(x), 3, 5)
    assert len(links) < len(fps)
    root = {v: v for v in fps}
    for a, b in links:
        ra, rb = root[a], root[b]
        for v in root:
            if root[v] == rb:
                root[v] = ra
    groups = classes(fps)
    assert len(set(root.values())) == len(set(groups.values()))


def test_stars_on_a_long_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(100, 101), (7, 7), (101, 100)], "a long, b long"))
    got = {r["node"]: r["root"] for r in s.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert s.components(edges.limit(0)).count() == 0


def test_frames(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base, base, base + " end", "other words here", None, "", "other words here", base.upper()]
    df = spark.createDataFrame([(i, t, 9, "clash") for i, t in enumerate(texts)], "doc_id long, text string, fp int, id string")
    got = {r["id"]: r["component"] for r in s.near_duplicates(df).collect()}
    assert got == classes({i: fp(t) for i, t in enumerate(texts)})
    assert s.near_duplicates(df.limit(0)).count() == 0


def test_long_lists_looked_up_by_differences(monkeypatch):
    """The same components as by comparing, in a list of one five-byte key with close groups."""
    rng = np.random.default_rng(8)
    low = np.unique(rng.integers(0, 1 << 24, 12_000).astype(np.uint64))
    fps = np.unique(np.concatenate((low, low[:500] ^ np.uint64(5), low[200:300] ^ np.uint64(1 << 23)))) | np.uint64(0xAB << 40)

    def classes(links):
        return sorted(s._joined([(int(a), int(b)) for a, b in links]))

    compared = classes(s._list_links(fps, 3, 5))
    monkeypatch.setattr(s, "PROBED_LIST", 10)
    monkeypatch.setattr(s, "MOST_LINKS", 100)
    assert classes(s._list_links(fps, 3, 5)) == compared and len(compared) > 500
