import random
from pathlib import Path
from urllib.parse import urlparse

import pytest

from seqloom import queries
from seqloom.operators import packed, suffix
from seqloom.plans.lineage import shared_dir
from seqloom.plans.sequence import SequenceError


def plain(docs):
    """(grp, pos) in order: words compare as bytes, an end comes before every word, equal suffixes by group."""
    words = [(g, [w.encode() for w in (t or "").split(" ") if w]) for g, t in docs]
    every = [(ws[p:], g, p) for g, ws in words if ws for p in range(len(ws) + 1)]
    return [(g, p) for _, g, p in sorted(every)]


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(5)
    some = [" ".join(draw.choice(("a", "b", "ab", "é", "\x01", "zz", "B")) for _ in range(draw.randrange(1, 40))) for _ in range(30)]
    return [*enumerate(some), (40, some[3]), (41, some[3]), (-7, some[3] + " b"), (50, None), (51, ""), (52, "a " * 70), (53, "a " * 64)]


@pytest.mark.parametrize("local", [0, None])
def test_order_by_rounds_and_in_one_task(spark, docs, monkeypatch, local):
    for name, size in (("SLICE", 200), ("BUCKET", 300), ("WORDS", 64), ("PASSES", 2)):
        monkeypatch.setattr(packed, name, size)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = packed.array(packed.documents(df), spark, local=local).toPandas().sort_values("r")
    want = plain(docs)
    assert list(got["r"]) == list(range(len(want)))
    assert list(zip(got["grp"], got["pos"], strict=True)) == want


def test_pairs_stand_where_the_array_has_them(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    words = {g: (t or "").split() for g, t in docs}
    ids = {w: i + 1 for i, w in enumerate(sorted({w for ws in words.values() for w in ws}, key=str.encode))}
    want = {}
    for r, (g, p) in enumerate(plain(docs)):
        if p + 1 < len(words[g]):
            want.setdefault((ids[words[g][p]], ids[words[g][p + 1]]), []).append(r)
    got = {(x["a"], x["b"]): (x["cnt"], x["low"], x["high"]) for x in packed.heads(packed.documents(df), spark).collect()}
    assert got == {k: (len(v), v[0], v[-1]) for k, v in want.items()}


def test_ids_are_unique_and_nothing_is_an_empty_array(spark):
    with pytest.raises(SequenceError):
        packed.documents(spark.createDataFrame([(1, "a b"), (1, "c")], "doc_id long, text string"))
    assert not packed.array(packed.documents(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")), spark).count()


@pytest.mark.parametrize("name", ["gsa_docs", "gsa_docs_heads"])
def test_a_suffix_takes_few_bytes_of_disk(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(suffix, "LOCAL_SYMBOLS", 0)
    draw = random.Random(1)
    base = " ".join(str(draw.randrange(3000)) for _ in range(20_000))
    spark.createDataFrame([(1, base), (2, base + " x"), (3, base[::-1])], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    at = Path(urlparse(shared_dir(spark)).path)
    size = lambda: sum(f.stat().st_size for f in at.rglob("*") if f.is_file())
    before = size()
    queries.QUERIES[name](spark, str(tmp_path)).count()
    assert size() - before < 60_000 * 60  # all that was stored on the way, in the rounds as well
