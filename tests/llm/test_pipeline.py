"""The pipeline against its stages' plain models on a small corpus."""

import hashlib
import random

import public_tokenizers as P
import pytest

import corpus_pipeline as pipe
from seqloom.llm import bpe, quality, secretscan, simhash


def corpus():
    draw = random.Random(9)
    line = lambda: " ".join(draw.choice("rain river stone field bird road town light water cloud hill tree".split()) for _ in range(12)) + "."
    docs = [(i, "\n".join(line() for _ in range(6)), "en", f"s{i % 3}", 1) for i in range(60)]
    docs += [(100 + i, docs[i][1], "en", "s0", 1) for i in range(10)]  # exact copies
    docs += [(200 + i, docs[20 + i][1] + "\nAll rights reserved.", "en", "s0", 1) for i in range(5)]  # copies once cleaned
    docs += [(300 + i, "of%%% the&&& in$$$ was### it*** " * 8, "en", "s1", 1) for i in range(5)]  # junk
    docs += [(400, " ".join(line() for _ in range(3)) + " token=" + "k" * 16 + " " + line(), "en", "s2", 1), (401, None, None, None, None), (402, "", "en", "s", 0), (59, docs[59][1], "en", "s2", 1)]
    return docs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame([(*d, "more") for d in corpus()], "doc_id long, text string, lang string, source string, n_chars long, fp string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder, tmp_path):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(pipe.STAGES):
        out = stage(spark, docs, folder)
        if i < len(pipe.STAGES) - 1:
            assert out.columns == list(pipe.COLUMNS)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs.collect())
    kept, single, scanned, mixed, coded = seen
    # quality rules
    want = {}
    for d in corpus():
        base = quality.base_measures((d[1] or "").encode(), len(d[1] or ""))
        text, lost = quality.cleaned(d[1] or "")
        if not (base[0] < 20 or 100 * base[4] > 30 * base[0]) and lost <= quality.MOST_LOST:
            want.setdefault(d[0], text)
    assert {r["doc_id"]: r["text"] for r in kept} == want and all(r["n_chars"] == len(r["text"]) for r in kept)
    # one of each group
    fps = {i: simhash.fingerprint(t) for i, t in want.items()}
    root = {i: min(j for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3) for i in fps}
    assert sorted(r["doc_id"] for r in single) == sorted(i for i in fps if root[i] == i)
    ids = {r["doc_id"] for r in single}
    assert len(single) == len(ids) and 400 in ids and not ids & {*range(100, 110), *range(200, 205), *range(300, 305)}
    # secrets
    assert {r["doc_id"]: r["text"] for r in scanned} == {r["doc_id"]: secretscan.redacted(r["text"], secretscan.scanner()(r["text"])) for r in single}
    assert "[ASSIGN]" in next(r["text"] for r in scanned if r["doc_id"] == 400)
    # clean documents stay in the mix
    assert {r["doc_id"] for r in mixed} == {r["doc_id"] for r in scanned}
    # coding
    encode = bpe.Encoder(bpe._vocabulary(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), P.PATTERN)
    by = {r["doc_id"]: r["text"] for r in mixed}
    assert len(coded) == len(mixed)
    for r in coded:
        raw = encode([by[r["doc_id"]]])[0]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(raw) // 4, hashlib.sha256(raw).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(by[r["doc_id"]].encode()).hexdigest()


def test_run_and_empty(spark, folder, tmp_path):
    assert pipe.run(spark, folder).count() >= 55
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipe.run(spark, str(tmp_path)).count() == 0


def test_null_ids_and_texts_of_one_id_reach_the_mix(spark, folder):
    text = [" ".join(f"w{k}x{i}" for i in range(40)) + "." for k in range(4)]
    rows = [(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), *((i, f"plain words of a clean document {i}.") for i in range(0, 60, 2))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(((r["doc_id"], r["text"]) for r in pipe.mix_sources(spark, docs, folder).collect()), key=str) == sorted(rows, key=str)


def test_run_returns_exactly_the_documents_that_are_left(spark, folder):
    """None of the 61 goes in the mix: all labelled rows are clean, so every rate is one at least.

    Before, copies 100-109 and 200-204 and the repeated 59 go to near-dedup; 300-304, 401 and 402 fail quality.
    """
    assert sorted(r["doc_id"] for r in pipe.run(spark, folder).collect()) == [*range(60), 400]


def test_long_texts(spark, folder):
    """A text of 200,000 different words passes every stage whole."""
    text = "\n".join(" ".join(f"w{i * 10 + k}" for k in range(10)) + "." for i in range(20_000))
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, "short.", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipe.STAGES[:3]:
        docs = stage(spark, docs, folder)
    assert [(r["doc_id"], r["text"]) for r in docs.collect()] == [(1, text)]
    assert bpe.digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).first()["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
