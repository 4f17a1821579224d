import pytest

from seqloom.functions import sizes
from seqloom.operators import bwt, ngram, runs, search, stats, suffix
from seqloom.plans import index
from seqloom.plans.sequence import from_table

RAW = [10, 30, 20, 30, 20, 10, 30, 20, 30, 20, 10, 40]


def column(df, name, by):
    return [r[name] for r in df.orderBy(by).collect()]


@pytest.fixture(scope="module")
def made(spark):
    rows = spark.createDataFrame(list(enumerate(RAW)), "pos long, val long")
    s = from_table(rows, ["pos"], "val")
    return s, index.build(s), index.build_plain(s)


def test_encoding(made):
    s, b, _ = made
    assert {(r["val"], r["id"]) for r in s.dict.collect()} == {(10, 1), (20, 2), (30, 3), (40, 4)}
    assert column(s.seq, "id", "k") == [1, 3, 2, 3, 2, 1, 3, 2, 3, 2, 1, 4]
    assert {tuple(r) for r in b.succ.collect()} == {(1, 3, 2, 1), (1, 4, 1, 2), (2, 1, 2, 1), (2, 3, 2, 2), (3, 2, 4, 1)}
    assert column(b.encoded, "s", "k") == [1, 1, 2, 1, 1, 1, 1, 2, 1, 1, 2, 0]
    assert b.kinds == 3
    assert column(b.index.base, "base", "sym") == [0, 1, 9, 12]
    assert round(stats.entropy(s.seq).first()["h0"], 6) == 1.855389
    assert round(stats.entropy(b.encoded, "s").first()["h0"], 6) == 1.188722


def test_transforms(made):
    s, b, (x, l) = made
    assert column(b.suffixes.sa, "k", "r") == [11, 3, 4, 8, 0, 5, 9, 1, 6, 10, 2, 7]
    assert column(b.bwt, "l", "i") == [2, 2, 1, 2, 0, 1, 1, 1, 1, 1, 1, 1]
    assert column(b.psi, "p", "i") == [4, 3, 2, 3, 1, 1, 2, 3, 3, 1, 2, 2]
    assert (runs.count_runs(b.bwt, "l"), runs.count_runs(b.psi, "p"), runs.count_runs(l, "l")) == (5, 9, 6)
    assert column(l, "l", "i") == [4, 0, 2, 2, 3, 3, 3, 3, 2, 2, 1, 1, 1]
    t = suffix.suffix_array(s.seq, s.n)
    assert column(t.sa, "k", "r") == [0, 5, 10, 4, 9, 2, 7, 3, 8, 1, 6, 11]
    u, primary = bwt.plain(t)
    assert column(u, "sym", "i") == [4, 2, 2, 3, 3, 3, 3, 2, 2, 1, 1, 1] and primary == 1
    aux = bwt.auxiliary(t, 4)
    assert column(aux, "isa1", "t") == [1, 4, 9]
    assert column(bwt.inverse(u, s.n, aux, 4), "id", "k") == column(s.seq, "id", "k")
    assert column(bwt.inverse_primary(u, s.n, primary), "id", "k") == column(s.seq, "id", "k")
    assert column(suffix.lcp(t), "lcp", "r") == [0, 6, 1, 0, 2, 1, 4, 0, 3, 2, 5, 0]
    assert column(suffix.plcp(t), "plcp", "k") == [0, 2, 1, 0, 0, 6, 5, 4, 3, 2, 1, 0]


def test_counts(spark, made):
    s, b, (x, _) = made
    golden = [([10], 3), ([30, 20], 4), ([20, 30, 20], 2), ([10, 30, 20, 30], 2), ([10, 40], 1), ([40], 1), ([40, 10], 0), ([99], 0), ([30, 30], 0), ([10, 30, 20, 30, 20, 10], 2), ([10] * 20, 0)]
    patterns = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(golden)], "pid long, p array<long>")
    for i in (b.index, x):
        for how in (True, False):
            assert column(index.count_values(i, s.dict, patterns, how), "n_occ", "pid") == [n for _, n in golden]
    empty = spark.createDataFrame([(0, [])], "pid long, p array<long>")
    assert [search.count(i, empty, how).first()["n_occ"] for i in (b.index, x) for how in (True, False)] == [12, 12, 13, 13]
    ids = spark.createDataFrame([(0, [3, 2]), (1, [])], "pid long, p array<long>")
    assert column(ngram.brute_force(s, ids), "n_occ", "pid") == [4, 12]


def test_sizes(made):
    _, b, plain = made
    rows = {r["form"]: r for r in index.size_rows(b, plain)}
    assert sizes.rankings(4, 5, 3) == 152
    assert [rows[f"order-1 {k}"]["bytes"] for k in ("explicit", "elias-fano", "huffman", "rl-huffman")] == [496, 496, 483, 675]
    assert [rows[f"plain {k}"]["bytes"] for k in ("explicit", "elias-fano", "huffman", "rl-huffman")] == [237, 224, 277, 477]
    assert [round(rows[k]["depth"], 4) for k in ("order-1 huffman", "order-1 rl-huffman", "plain huffman", "plain rl-huffman")] == [1.3333, 1.6, 2.1538, 2.3333]
    assert index.build_report(b).first().asDict() == {"n": 12, "sigma": 4, "kE": 3, "bwt_runs": 5, "psi_runs": 9, "bytes": 675}


def test_string_set(spark):
    sets = [[1, 2, 1, 2], [2, 1, 2], [1, 2]]
    rows = spark.createDataFrame([(d, i, v) for d, x in enumerate(sets) for i, v in enumerate(x)], "doc long, pos long, val long")
    s = from_table(rows, ["pos"], "val", group="doc")
    x, flat = suffix.generalized(s)
    assert flat.n == 12
    assert column(x.sa, "k", "r") == [4, 8, 11, 2, 6, 9, 0, 3, 7, 10, 1, 5]
    assert column(suffix.lcp(x), "lcp", "r") == [0, 0, 0, 0, 2, 2, 2, 0, 1, 1, 1, 3]
