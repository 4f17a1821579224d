from pyspark.sql import functions as F

from seqloom.llm import urlfilter as u

URLS = ["http://WWW.Example.com/en/1?x=2#y", "https://a.example.com/en/x", "http://example.com/fr/", "http://notexample.com/en/", "http://net/es/1", "http://a.net/fr/x", "http://a.net/de/x", "http://b.org/x", "https://www.b.org:443/x/?utm_source=q#f", "http://b.org/x?b=2&a=1", "http://b.org/x?a=1&b=2", "ftp://com", "http://com/", "no url", "", None, "x://h://p/q", "http://\u00c9.com/\u00fc", "http://h.org?q=/en/", "http://b.org/\nx"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = "".join(rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))])
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_and_list(spark):
    rows = spark.createDataFrame([(i, x, "clash", "k") for i, x in enumerate(URLS)], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([("http://b.org/x",), ("http://b.org/x?a=1&b=2",), (None,), ("junk",), ("http://net/es/1",)], "url string")
    got = {r["page_id"]: r for r in u.judge(rows, listed).collect()}
    assert len(got) == len(URLS)
    for i, x in enumerate(URLS):
        host, path = parts(x)
        name, verdict = rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, name), x
        assert got[i]["verdict"] == (verdict or ("block" if i in (7, 8, 9, 10) else "allow")), x
    assert {r["verdict"] for r in u.judge(rows.where("page_id > 4"), listed.limit(0)).collect()} == {"allow", "block"}
    assert u.judge(rows.limit(0), listed).count() == 0


def test_filter_has_no_false_negatives(spark, monkeypatch):
    urls = spark.range(5000).select(F.concat(F.lit("h.org/"), "id").alias("url"))
    pages = spark.range(2500, 12_500).select(F.col("id").alias("page_id"), F.concat(F.lit("h.org/"), "id").alias("url"))
    for limit in (u.BROADCAST_BYTES, 0):
        monkeypatch.setattr(u, "BROADCAST_BYTES", limit)
        r = u.possible(pages, urls, 5000).groupBy((F.col("page_id") < 5000).alias("listed"), "maybe").count().collect()
        by = {(x["listed"], x["maybe"]): x["count"] for x in r}
        assert by[True, True] == 2500 and (True, False) not in by
        assert by.get((False, True), 0) < 0.03 * 7500


def test_repeated(spark):
    rows = spark.createDataFrame([(1, "http://a.org/x/"), (2, "https://www.a.org/x#1"), (3, "http://a.org/y"), (4, None), (5, "none")], "page_id long, url string")
    assert [r["url"] for r in u.repeated(rows).collect()] == ["a.org/x"]


def test_long_urls_and_repeated_pages(spark):
    long_ = "http://www.example.com/en/" + "x/" * 100_000 + "?" + "&".join(f"k{i}=v" for i in range(5000))
    rows = spark.createDataFrame([(1, long_), (1, long_), (None, "http://net/es/"), (2, "http://EXAMPLE.com/en/" + "y" * 300_000)], "page_id long, url string")
    got = sorted(((r["page_id"], len(r["path"]), r["rule"], r["verdict"]) for r in u.judge(rows, u.repeated(rows), listed_canonical=True).collect()), key=str)
    assert got == sorted([(1, 200_004, "www.example.com/en/", "allow")] * 2 + [(None, 4, "net/es/", "block"), (2, 300_004, "example.com/en/", "block")], key=str)
