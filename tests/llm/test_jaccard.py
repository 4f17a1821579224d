import random
from itertools import combinations

import pytest

import corpus_pipeline as pipe
from seqloom.llm import jaccard as j


def brute(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def left(docs):
    """Ids of the documents that stay, by comparing all pairs."""
    sets, root = {i: brute(t) for i, t in docs}, {i: i for i, _ in docs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return sorted(i for i in root if top(i) == i)


def corpus():
    draw = random.Random(6)
    word = lambda: f"w{draw.randrange(5000)}"
    docs, at = [], 0
    for k in range(60):
        text = [word() for _ in range(draw.choice([30, 120, 400]))]
        for edits in (0, 1, 2, 4, 8, 16)[: 1 + k % 6]:
            other = list(text)
            for _ in range(edits):
                other[draw.randrange(len(other))] = word()
            docs.append((at, " ".join(other)))
            at += 1
    base = [word() for _ in range(200)]
    for k in range(80):  # a large group; most members are copies of its first text and not of each other
        other = list(base)
        for _ in range(4 if k else 0):
            other[draw.randrange(200)] = word()
        docs.append((at + k, " ".join(other)))
    return [*docs, (1000, None), (1001, ""), (1002, "One two"), (1003, "one TWO")]


@pytest.mark.parametrize("short", [32, 4])
def test_stage_against_all_pairs(spark, monkeypatch, short):
    monkeypatch.setattr(j, "SHORT_LIST", short)
    docs = corpus()
    want = left(docs)
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in pipe.near_dedup(spark, rows, "").collect()) == want
    assert pipe.near_dedup(spark, rows.limit(0), "").count() == 0


def test_rows_of_one_id_and_of_none(spark):
    draw = random.Random(8)
    a, b, c = (" ".join(f"w{draw.randrange(5000)}" for _ in range(100)) for _ in range(3))
    docs = [(1, a), (2, a), (2, b), (2, b), (3, b), (4, c), (None, c), (None, b + " x y"), (None, "x " * 30 + "end"), (None, "x " * 30 + "end"), (5, None)]
    rows = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in pipe.near_dedup(spark, rows, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (4, c), (None, "x " * 30 + "end"), (5, None)], key=str)


def test_simhash_goes_first_and_is_verified(spark, monkeypatch):
    """Sets within three bits are joined by the index of byte positions; only similar ones of those are links."""
    docs = corpus()
    rows = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string").select("*", j.digest().alias("digest"))
    nodes = j._sets(rows).dropDuplicates(["node"]).cache()
    fps, joined = {r["node"]: r["fp"] & (1 << 64) - 1 for r in nodes.collect()}, []
    pairs = [(r["a"], r["b"]) for r in j.close(nodes).collect()]
    root = {x: x for x in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[top(a)] = top(b)
    near = [(a, b) for a, b in combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert len(near) > 10 and all(top(a) == top(b) for a, b in near)
    verified = j._verified
    monkeypatch.setattr(j, "_verified", lambda tried, *a: joined.append(sorted((r["a"], r["b"]) for r in tried.collect())) or verified(tried, *a))
    texts = dict(docs)
    sets = {r["node"]: set(j.shingles(texts[r["doc_id"]]).tolist()) for r in nodes.collect()}
    for r in j.links(nodes, rows).collect():
        assert 5 * len(sets[r["a"]] & sets[r["b"]]) >= 4 * len(sets[r["a"]] | sets[r["b"]])
    assert joined[0] == sorted(pairs)
