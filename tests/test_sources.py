import os

import numpy as np
import pytest

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from seqloom import cli
from seqloom.functions import draws
from seqloom.plans import index
from seqloom.plans.sequence import SequenceError, from_table
from seqloom.sources import intseq
from seqloom.sources.synthetic import generate


@pytest.mark.parametrize("width", intseq.WIDTHS)
def test_round_trip(spark, tmp_path, width):
    values = np.array([0, 1, 200, 255, 7], dtype=np.uint64)
    intseq.write_ints(values, str(tmp_path / "x.bin"), width)
    rows = intseq.read_ints(spark, str(tmp_path / "x.bin"), width).orderBy("pos").collect()
    assert [(r["pos"], int(r["val"])) for r in rows] == list(enumerate(values.tolist()))


def test_ragged_tail_and_ranges(spark, tmp_path):
    path = str(tmp_path / "x.bin")
    with open(path, "wb") as f:
        f.write(np.arange(4, dtype="<u4").tobytes() + b"ab")
    spark.dataSource.register(intseq.IntSequenceSource)
    df = spark.read.format("intseq").option("width", 4).option("splitBytes", 8).load(path)
    assert df.rdd.getNumPartitions() == 2
    assert sorted(tuple(r) for r in df.collect()) == [(i, i) for i in range(4)]


def test_largest_value(spark, tmp_path):
    path = str(tmp_path / "x.bin")
    intseq.write_ints(np.array([2**64 - 1, 5], dtype=np.uint64), path, 8)
    s = intseq.sequence_of(spark, path, 8)
    assert [r["id"] for r in s.seq.orderBy("k").collect()] == [2, 1]
    with pytest.raises(Exception):
        intseq.read_ints(spark, path, 3).collect()


def test_folders(spark, tmp_path):
    """Flat files written by tasks and read as one sequence; a task that runs again writes the same file."""
    values = [(i * 7) % 1000 for i in range(5000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos long, val long").repartition(3)
    for width in (2, 8):
        for _ in range(2):
            assert intseq.save_ints(df, str(tmp_path / f"w{width}"), width, 1300) == 5000
        rows = intseq.read_ints(spark, f"file:{tmp_path}/w{width}", width).orderBy("pos").collect()
        assert [(r["pos"], int(r["val"])) for r in rows] == list(enumerate(values))
        files = sorted(os.listdir(tmp_path / f"w{width}"))
        assert len(files) == 4 and all(f.startswith("part-") for f in files)
    assert intseq.save_ints(df.limit(0), str(tmp_path / "none")) == 0 and intseq.read_ints(spark, str(tmp_path / "none")).count() == 0


def test_patterns_are_known_by_their_line(spark, tmp_path):
    lines = ["" if i % 7 == 3 else f"{i} {i + 1}" for i in range(3000)]
    (tmp_path / "p.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = {r["pid"]: [int(v) for v in r["p"]] for r in intseq.read_patterns(spark, str(tmp_path / "p.txt")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: [i, i + 1] for i in range(3000) if i % 7 != 3}


def test_patterns(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1 2\n\n1 2 x 3\nx\n  7\t8 \n-1 2\n18446744073709551615\n")
    got = [[int(v) for v in r["p"]] for r in intseq.read_patterns(spark, str(tmp_path / "p.txt")).orderBy("pid").collect()]
    assert got == [[1, 2], [1, 2], [7, 8], [2**64 - 1]]


def test_store_and_commands(spark, tmp_path, capsys):
    raw = [10, 30, 20, 30, 20, 10, 30, 20, 30, 20, 10, 40]
    intseq.write_ints(np.array(raw, dtype=np.uint64), str(tmp_path / "x.bin"))
    (tmp_path / "p.txt").write_text("30 20\n\n99\n10 40\n")
    assert cli.main(["build", str(tmp_path / "x.bin"), str(tmp_path / "ix")]) == 0
    assert "'bytes': 675" in capsys.readouterr().out
    assert cli.main(["count", str(tmp_path / "ix"), str(tmp_path / "p.txt")]) == 0
    assert capsys.readouterr().out.split() == ["4", "0", "1"]
    assert cli.main(["unknown"]) == 1
    spark.range(1).selectExpr("'{\"kind\": \"other\"}' as value").coalesce(1).write.mode("overwrite").text(str(tmp_path / "ix" / "meta"))
    with pytest.raises(ValueError, match="bad index file"):
        index.load(spark, str(tmp_path / "ix"))


def test_generator(spark):
    a, b = (sorted(tuple(r) for r in generate(spark, 50, 40, 5, 0.1).collect()) for _ in range(2))
    assert a == b and [p for p, _ in a] == list(range(200))
    exact = dict(generate(spark, 50, 40, 3, 0.0).collect())
    assert all(exact[p] == exact[p + 40] for p in range(80))


def test_generated_walk(spark):
    """Every symbol has few followers inside a stretch, the first by far the most frequent."""
    from seqloom.sources.synthetic import FOLLOWERS, STRETCH

    rows = [r["val"] for r in generate(spark, 20, 5000, 1, 0.0).orderBy("pos").collect()]
    after = {}
    for i, (a, b) in enumerate(zip(rows, rows[1:])):
        if (i + 1) % STRETCH:
            after.setdefault(a, Counter())[b] += 1
    assert len(set(rows)) <= 20 and max(len(c) for c in after.values()) <= FOLLOWERS
    most = sum(c.most_common(1)[0][1] for c in after.values()) / sum(c.total() for c in after.values())
    assert 0.45 < most < 0.8
    changed = [r["val"] for r in generate(spark, 20, 5000, 2, 0.3).orderBy("pos").collect()]
    assert 0.2 < sum(a != b for a, b in zip(changed, changed[5000:])) / 5000 < 0.6


def test_draws_agree(spark):
    x = np.array([0, 1, 2, 10**9, 2**40])
    got = [r[0] for r in spark.createDataFrame([(int(v),) for v in x], "x long").select(draws.draw(F.col("x"), 3)).collect()]
    assert got == draws.draws(x, 3).tolist() == [duckdb.sql(f"select {draws.draw_sql(str(v), 3)}").fetchall()[0][0] for v in x.tolist()]


def test_order_of_equal_rows_across_batches(spark):
    from seqloom.plans.order import OrderError, numbered

    rows = spark.createDataFrame([(None, 1), (None, 2), (3, 1), (3, 2)], "a long, b long")
    assert numbered(rows, ["a", "b"], check=True)[1] == 4
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        for twice in ((None, 2), (3, 1)):
            with pytest.raises(OrderError, match="1 rows"):
                numbered(rows.unionByName(spark.createDataFrame([twice], rows.schema)), ["a", "b"], check=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from seqloom.plans.lineage import shared_dir

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        sc = SimpleNamespace(getCheckpointDir=lambda: None, master=master)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None)))


def test_bad_tables(spark):
    with pytest.raises(SequenceError, match="null"):
        from_table(spark.createDataFrame([(0, 1), (1, None)], "pos long, val long"), ["pos"], "val")
    with pytest.raises(SequenceError, match="unique"):
        from_table(spark.createDataFrame([(0, 1), (0, 2)], "pos long, val long"), ["pos"], "val")
    empty = from_table(spark.createDataFrame([], "pos long, val long"), ["pos"], "val")
    b = index.build(empty)
    patterns = spark.createDataFrame([(0, [1]), (1, [])], "pid long, p array<long>")
    assert (empty.n, empty.sigma, b.kinds) == (0, 0, 1)
    for how in (True, False):
        assert [r["n_occ"] for r in index.search.count(b.index, patterns, how).orderBy("pid").collect()] == [0, 0]


def test_stamp_follows_the_files(spark, tmp_path):
    from seqloom.plans.lineage import stamp

    (tmp_path / "a").write_text("x")
    first = stamp(spark, str(tmp_path))
    assert first == stamp(spark, str(tmp_path))
    (tmp_path / "a").write_text("xy")
    assert first != stamp(spark, str(tmp_path))
