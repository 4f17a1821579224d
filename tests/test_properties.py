import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import naive
from seqloom.functions import sizes
from seqloom.functions.draws import draws
from seqloom.operators import bwt, ngram, search, suffix
from seqloom.operators.search import _Ranks
from seqloom.plans import index
from seqloom.plans.order import following, numbered, prefix_sum
from seqloom.plans.sequence import from_table


def sequence(spark, raw):
    return from_table(spark.createDataFrame(list(enumerate(raw)), "pos long, val long"), ["pos"], "val")


def fibonacci(n):
    a, b = [1], [1, 2]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


CASES = {
    "one symbol": [7],
    "one run": [5] * 60,
    "two copies": [3, 1, 4, 1, 5, 9, 2, 6] * 2,
    "periodic": [1, 2] * 40,
    "fibonacci": fibonacci(70),
    "all distinct": list(range(30)),
    "random": [random.Random(3).randrange(4) for _ in range(120)],
}


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_array_sorting(t):
    sa, common = suffix.sort_suffixes(np.array(t, dtype=np.int64))
    assert sa.tolist() == naive.suffix_array(t) and common.tolist() == naive.lcp(t)


@pytest.mark.parametrize("raw", [CASES[k] for k in ("one run", "fibonacci", "random")])
def test_distributed_sorting(spark, monkeypatch, raw):
    monkeypatch.setattr(suffix, "LOCAL_SYMBOLS", 0)
    s = sequence(spark, raw)
    x = suffix.suffix_array(s.seq, s.n)
    assert x.levels and [r["k"] for r in x.sa.orderBy("r").collect()] == naive.suffix_array(naive.densify(raw))
    assert [r["lcp"] for r in suffix.lcp(x).orderBy("r").collect()] == naive.lcp(naive.densify(raw))


def test_distributed_sorting_of_a_long_sequence(spark):
    """120,000 symbols with long repeats: the rounds against sorting in one task."""
    draw = np.random.default_rng(4)
    base = draw.integers(1, 40, 30_000)
    raw = np.concatenate((base, base, draw.integers(1, 40, 15_000), base, base[:15_000]))
    df = spark.createDataFrame(pa.table({"k": np.arange(len(raw)), "id": raw}))
    x = suffix.suffix_array(df, len(raw), local=0)
    sa, common = suffix.sort_suffixes(raw)
    assert x.levels and x.sa.orderBy("r").toArrow()["k"].to_numpy().tolist() == sa.tolist()
    assert suffix.lcp(x).orderBy("r").toArrow()["lcp"].to_numpy().tolist() == common.tolist()


@pytest.mark.parametrize("raw", CASES.values(), ids=CASES.keys())
def test_indexes_agree_with_brute_force(spark, raw):
    s = sequence(spark, raw)
    t = naive.densify(raw)
    x = suffix.suffix_array(s.seq, s.n)
    assert [r["k"] for r in x.sa.orderBy("r").collect()] == naive.suffix_array(t)
    assert [r["lcp"] for r in suffix.lcp(x).orderBy("r").collect()] == naive.lcp(t)
    u, primary = bwt.plain(x)
    assert [r["id"] for r in bwt.inverse_primary(u, s.n, primary).orderBy("k").collect()] == t
    b, (plain, _) = index.build(s), index.build_plain(s)
    draw = random.Random(1)
    patterns = [t[i : i + m] for m in (1, 2, 3, 5) for i in range(0, len(t) - m + 1, 7)] + [[draw.randrange(1, s.sigma + 1) for _ in range(3)] for _ in range(5)] + [t + [1]]
    rows = spark.createDataFrame(list(enumerate(patterns)), "pid long, p array<long>")
    want = [naive.count(t, p) for p in patterns]
    for i, how in ((b.index, True), (plain, True)):
        assert [r["n_occ"] for r in search.count(i, rows, how).orderBy("pid").collect()] == want
    assert {tuple(r["p"]): r["n_occ"] for r in ngram.ngram_counts(s, 2).collect()} == Counter(zip(t, t[1:]))


def test_joined_plan_agrees(spark):
    raw = CASES["random"]
    s = sequence(spark, raw)
    b, (plain, _) = index.build(s), index.build_plain(s)
    patterns = index.perturbed(ngram.sample_patterns(s, 3, 20), s.sigma)
    assert index.disagreements(b, plain, patterns).isEmpty()


def test_order_primitives(spark):
    n = 500
    df = spark.range(n).selectExpr("(id * 37) % 500 as x", "id % 3 as v").repartition(7)
    rows, total = prefix_sum(df, ["x"], "v", partitions=5)
    got = [(r["x"], r["before"]) for r in rows.orderBy("x").collect()]
    by = {r["x"]: r["v"] for r in df.collect()}
    want, before = [], 0
    for x in range(n):
        want.append((x, before))
        before += by[x]
    assert got == want and total == before
    seq, count = numbered(df.select("x"), ["x"])
    assert count == n and all(r["k"] == r["x"] for r in seq.collect())
    ahead = following(seq, 4, column="x", bucket=16).collect()
    assert len(ahead) == n and all(r[f"x{j}"] == (r["k"] + j if r["k"] + j < n else None) for r in ahead for j in range(4))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=60))
def test_rank_kernel(t):
    n, order = len(t), sorted(range(len(t)), key=lambda i: (t[i], i))
    fp = {k: j for j, k in enumerate(order)}
    starts = [i for i in range(n) if i == 0 or t[i] != t[i - 1]]
    ranks = _Ranks(*(np.array(x, dtype=np.int64) for x in ([t[i] for i in starts], starts, [fp[i] for i in starts])), n)
    c, i = np.array([(c, i) for c in range(0, 7) for i in range(n + 1)]).T
    assert ranks(c, i).tolist() == [t[:b].count(a) for a, b in zip(c.tolist(), i.tolist())]


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40))
def test_bulk_huffman_is_huffman(freqs):
    lengths = sizes.huffman_lengths(list(enumerate(freqs)))
    assert sizes.huffman_cost(list(Counter(freqs).items())) == sum(f * lengths[s] for s, f in enumerate(freqs))


def started(spark, run):
    """What a call returns, and how many jobs it started."""
    sc = spark.sparkContext
    before = sc._jsc.sc().dagScheduler().numTotalJobs()
    return run(), sc._jsc.sc().dagScheduler().numTotalJobs() - before


@pytest.mark.parametrize("rate", [None, 16])
def test_inverse_takes_few_jobs_and_the_rounds_agree(spark, rate):
    t = np.random.default_rng(5).integers(1, 5, 3000)
    x = suffix.suffix_array(spark.createDataFrame(pa.table({"k": np.arange(len(t)), "id": t})), len(t))
    u, primary = bwt.plain(x)
    aux = bwt.auxiliary(x, rate) if rate else spark.createDataFrame([(0, primary)], "t long, isa1 long")
    text = lambda df: df.orderBy("k").toArrow()["id"].to_numpy().tolist()
    got, jobs = started(spark, lambda: text(bwt.inverse(u, len(t), aux, rate)))
    assert got == t.tolist() and jobs < 20
    assert text(bwt.inverse(u, len(t), aux, rate, local=0)) == got


def test_long_samples_look_up_their_positions_alone(spark):
    """A sample of 64 symbols needs no window over the sequence, and none crosses a group."""
    draw = random.Random(2)
    raw = [draw.randrange(4) for _ in range(400)]
    s, t = sequence(spark, raw), naive.densify(raw)
    found = ngram.sample_patterns(s, 64, 30)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {j: t[k : k + 64] for j, k in enumerate((draws(np.arange(30), 64) % (len(t) - 63)).tolist())}
    assert {r["pid"]: r["p"] for r in found.collect()} == want
    g = from_table(spark.createDataFrame([(i // 50, i, v) for i, v in enumerate(raw)], "g long, pos long, val long"), ["pos"], "val", group="g")
    at = (draws(np.arange(60), 8) % (len(t) - 7)).tolist()
    assert {r["pid"]: r["p"] for r in ngram.sample_patterns(g, 8, 60).collect()} == {j: t[k : k + 8] for j, k in enumerate(at) if k // 50 == (k + 7) // 50}


def test_a_task_that_gathers_the_index_agrees(spark, monkeypatch):
    """Run tables beyond a broadcast, of an index that a task holds, cost no job for each symbol of a pattern."""
    raw = CASES["random"]
    s = sequence(spark, raw)
    t, b, (plain, _) = naive.densify(raw), index.build(s), index.build_plain(s)
    monkeypatch.setattr(search, "BROADCAST_RUNS", 1)
    patterns = [t[i : i + m] for m in (1, 4, 40) for i in range(0, len(t) - m + 1, 11)] + [[], [0, 1], [s.sigma + 1], t + [1]]
    rows = spark.createDataFrame([(f"x{j}", p) for j, p in enumerate(patterns)], "pid string, p array<long>")
    for x, empty in ((b.index, len(t)), (plain, len(t) + 1)):
        got, jobs = started(spark, lambda: {r["pid"]: r["n_occ"] for r in search.count(x, rows).collect()})
        assert got == {f"x{j}": naive.count(t, p) if p else empty for j, p in enumerate(patterns)} and jobs < 30


def test_rounds_without_lcps_keep_no_ranks(spark):
    t = CASES["fibonacci"]
    df = spark.createDataFrame(list(enumerate(t)), "k long, id long")
    x = suffix.suffix_array(df, len(t), local=0, lcps=False)
    assert not x.levels and [r["k"] for r in x.sa.orderBy("r").collect()] == naive.suffix_array(t)
    with pytest.raises(ValueError, match="let go"):
        suffix.lcp(x)
