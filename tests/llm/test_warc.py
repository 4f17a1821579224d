import hashlib
import os

import pytest

from seqloom.llm import warc

PAGES = [(i, f"http://h/{i}", "same" if i % 3 == 0 else f"page {i} " * (i % 5)) for i in range(60)] + [(60, None, None), (61, "http://x y\r\n/", "é" * 50), (62, "u", "x" * 300_000), (5, "http://h/5", "page 5 " * 0), (62, "u", "x" * 300_000)]
SCHEMA = "page_id long, url string, html string, shard int, digest string"


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)


def archive(spark, folder, parts, **more):
    warc.write(frame(spark).repartition(parts), str(folder), "page_id", "url", "html", **more)
    return {f: open(os.path.join(folder, f), "rb").read() for f in sorted(os.listdir(folder)) if f.endswith(".gz")}


def test_same_bytes_whatever_the_partitions(spark, tmp_path):
    small = {"roll_bytes": 2000, "shard_bytes": 20_000}
    a, b = archive(spark, tmp_path / "a", 1, **small), archive(spark, tmp_path / "b", 5, **small)
    assert a == b and len(a) > 5
    manifest = [r.asDict() for r in warc.manifest(spark, str(tmp_path / "a")).collect()]
    assert {m["name"] for m in manifest} == set(a)
    assert all(m["bytes"] == len(a[m["name"]]) for m in manifest) and sum(m["records"] for m in manifest) == len(PAGES)
    firsts = [m["first_id"] for m in sorted(manifest, key=lambda m: m["name"])]
    assert firsts == sorted(firsts)  # files follow the ids
    assert any(n.endswith("-0001.warc.gz") for n in a)  # rolled by size


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, tmp_path, least):
    warc.write(frame(spark), str(tmp_path / "w"), "page_id", "url", "html", least_bytes=least)
    rows = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(rows) == len(PAGES)
    last = {}
    for i, _, html in PAGES:
        last[html or ""] = max(i, last.get(html or "", i))
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        again = len(data) >= least and i < last[html or ""]
        want.append((i, "revisit" if again else "response", len(data), warc.digest32(data), last[html or ""] if again else None))
    key = lambda r: (r[0], r[2], str(r))
    assert sorted(((r["id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in rows), key=key) == sorted(want, key=key)
    for r in rows:
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).digest() and warc.digest32(bytes(r["payload"])) == r["payload_digest"]


def test_what_a_lost_attempt_leaves_goes(spark, tmp_path):
    os.makedirs(tmp_path / "w" / warc.TEMPORARY)
    (tmp_path / "w" / warc.TEMPORARY / "9.9-part-000000-0000.warc.gz").write_bytes(b"half")
    warc.write(frame(spark), str(tmp_path / "w"), "page_id", "url", "html")
    assert not [f for f in os.listdir(tmp_path / "w") if f.startswith("_temporary")]


def test_moves_that_run_again(spark, tmp_path):
    """A task of the commit that is repeated finds its files in place; a file that is nowhere is an error."""
    os.makedirs(tmp_path / warc.TEMPORARY)
    (tmp_path / warc.TEMPORARY / "1.1-a").write_bytes(b"x")
    (tmp_path / "b").write_bytes(b"moved before")
    row = lambda name: (name, f"{warc.TEMPORARY}/1.1-{name}", 1, 1, 1, 1)
    files = spark.createDataFrame([row("a"), row("b")], warc._MANIFEST_SCHEMA)
    assert sorted(r["name"] for r in warc.commit(str(tmp_path), files).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="No such file"):
        warc.commit(str(tmp_path), spark.createDataFrame([row("c")], warc._MANIFEST_SCHEMA))


def test_even_shards_whatever_the_ids(spark, tmp_path):
    """Outlying, negative, very wide and null ids, and one id that holds a third of all rows."""
    rows = [(i, "u", f"page {i} " * 20) for i in range(300)] + [(7, "u", f"another {i} " * 20) for i in range(150)]
    rows += [(-9 * 10**18, "u", "low"), (9 * 10**18, "u", "high"), (-3, "u", "page 5 " * 20), (None, "u", "none"), (None, "u", "high")]
    warc.write(frame(spark, rows), str(tmp_path / "w"), "page_id", "url", "html", shard_bytes=10_000)
    files = warc.manifest(spark, str(tmp_path / "w")).collect()
    shards = {}
    for f in files:
        shards[f["name"][:11]] = shards.get(f["name"][:11], 0) + f["records"]
    assert len(shards) > 20 and max(shards.values()) < 4 * len(rows) / len(shards)
    got = {(r["id"], r["payload_digest"]): r["refers_to"] for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert len(got) == len(rows) and got[(-3, warc.digest32(b"page 5 " * 20))] == 5 and got[(None, warc.digest32(b"high"))] == 9 * 10**18


def test_empty_and_broken(spark, tmp_path):
    warc.write(frame(spark, []), str(tmp_path / "w"), "page_id", "url", "html")
    assert warc.read(spark, str(tmp_path / "w")).count() == 0
    data = warc.page_record(1, "u", b"body", None)
    assert [b for _, b in warc.parse(iter([data[:10], data[10:]]))][0].endswith(b"body")
    with pytest.raises(ValueError):
        list(warc.parse(iter([data[:-20]])))
    with pytest.raises(FileNotFoundError):
        warc.read(spark, str(tmp_path / "none"))
