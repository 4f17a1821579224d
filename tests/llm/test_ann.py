import numpy as np
import pytest

from seqloom.llm import ann


def brute(vectors, ids, query, k=10):
    good = {i: v for i, v in zip(ids, vectors)}
    dist = sorted((float(np.sqrt(((good[i] - good[query]) ** 2).sum())), i) for i in good if i != query)
    return dist[:k]


def test_hilbert_is_a_curve():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = ann.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()  # each step goes to a neighbour


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = ann.search(rows, lambda key: key % 100 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["id"]))
    hit = total = 0
    for q in range(0, 3000, 100):
        want = brute(x.astype(float), range(3000), q)
        found = [(s, i) for _, s, i in sorted(by[q])]
        assert found == sorted(found) and len(found) == 10
        hit += len({i for _, i in want} & {i for _, i in found})
        total += 10
        assert all(abs(s - np.sqrt(((x[i].astype(float) - x[q].astype(float)) ** 2).sum())) < 1e-12 for s, i in found)
    assert hit / total >= 0.9


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (200, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, c string, ids string")
    got = {}
    for r in ann.search(df, lambda key: key % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], round(r["score"], 9)))
    far = round(2**0.5, 9)
    assert sorted(got[0]) == [(1, 1, 0.0), (2, 2, 0.0), (3, 200, 0.0), (4, 100, far)]
    assert sorted(got[100]) == [(1, 0, far), (2, 1, far), (3, 2, far), (4, 200, far)]
    assert sorted(got[200]) == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0), (4, 100, far)]
    assert set(got) == {0, 100, 200}
    assert ann.search(df.limit(0), lambda key: key % 100 == 0).count() == 0


def test_many_copies(spark):
    """A vector that half of the rows share: the smallest ids, without the query's own."""
    df = spark.range(400).selectExpr("id as vec_id", "case when id % 2 = 0 then array(1f, 2f, 3f) else array(float(id), 1f, float(id % 7)) end as embedding")
    rows = ann.search(df, lambda key: key % 100 == 0).where("query_id = 200").orderBy("rank").collect()
    assert [r["id"] for r in rows] == list(range(0, 20, 2)) and all(r["score"] == 0 for r in rows)


def test_registered_query_against_brute_force(spark):
    import os

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect() if r["embedding"] and np.isfinite(np.array(r["embedding"], dtype=float)).all()}
    found = ann.op2_nearest_neighbours(spark, data).collect()
    hit = total = 0
    for q in [i for i in rows if i % 100 == 0]:
        want = sorted((float(np.sqrt(((v - rows[q]) ** 2).sum())), i) for i, v in rows.items() if i != q)[:10]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [r for r, _, _ in got] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((rows[i] - rows[q]) ** 2).sum())) < 1e-12 for _, i, s in got)
        hit, total = hit + len({i for _, i in want} & {i for _, i, _ in got}), total + 10
    assert hit / total >= 0.9
