"""URL filters: rules by host and path, and a list of URLs behind a blocked Bloom filter.

DataFrame operations only. Listed URLs are made canonical and hashed; a hash names one 256-bit block
of the filter and eight bits in it, so a probe reads one row. The filter is a table (block, four
64-bit lanes) built by a grouped bit_or. URLs whose bits are all set are possible hits; only they go
to an exact hash join with the list, which takes out the false positives.

The filter is broadcast while its size, known before it is built, is at most ``BROADCAST_BYTES``;
beyond that the probe is a join by block. A hot URL or host costs no more than its rows: blocks are
broadcast or joined in a way Spark may split, and counts are combined before the shuffle.

Edge cases: a null URL or one without ``://`` has empty host and path, matches no rule and is never
listed; repeated pages are judged each; an empty list blocks nothing; clashing extra columns are not
read.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

BITS_PER_URL = 12
BLOCK_BITS = 256
BROADCAST_BYTES = 64_000_000
_ROW_BYTES = 48

#: (verdict, host, path): the rules of the registered query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, n: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, n), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return _part(url, 2)


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default ports, path without closing slashes, sorted parameters without campaign tags.

    Scheme and fragment go; a URL that can't be split is empty.
    """
    host = F.regexp_replace(host_of(url), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    kept = F.array_join(F.array_sort(F.filter(F.split(_part(url, 3), "&"), lambda x: (x != "") & ~x.startswith("utm_"))), "&")
    return F.concat(host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule,verdict> of the longest rule that fits, else null. A rule fits its host and every subdomain."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, under in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(under)
        out = F.when(fits, F.struct(F.lit(at + under).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks).cast("long"))


def _lanes(url: Column) -> list[Column]:
    """Two bits of each of the block's four lanes."""
    h = F.xxhash64(url, F.lit(1))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(4)]


def bloom_filter(urls: DataFrame, count: int) -> tuple[DataFrame, int]:
    """The filter of canonical urls (column ``url``) and its number of blocks."""
    blocks = max(1, ceil(count * BITS_PER_URL / BLOCK_BITS))
    rows = urls.select(_block(F.col("url"), blocks).alias("block"), *(x.alias(f"w{i}") for i, x in enumerate(_lanes(F.col("url")))))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4))), blocks


def possible(pages: DataFrame, urls: DataFrame, count: int) -> DataFrame:
    """Add ``maybe``: whether the page's canonical url (column ``url``) passes the filter of the listed ones."""
    lanes, blocks = bloom_filter(urls, count)
    if blocks * _ROW_BYTES <= BROADCAST_BYTES:
        lanes = F.broadcast(lanes)
    probed = pages.withColumn("block", _block(F.col("url"), blocks)).join(lanes, "block", "left")
    passed = [F.col(f"w{i}").bitwiseAND(x) == x for i, x in enumerate(_lanes(F.col("url")))]
    return probed.withColumn("maybe", F.coalesce(passed[0] & passed[1] & passed[2] & passed[3], F.lit(False))).drop("block", "w0", "w1", "w2", "w3")


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, listed_canonical: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict) of pages (page_id, url), given blocked URLs (column ``url``)."""
    urls = listed.select((F.col("url") if listed_canonical else canonical(F.col("url"))).alias("url")).where("url <> ''").distinct()
    urls = cut(urls)  # counted, hashed into the filter and joined
    url = F.col("raw")
    rows = pages.select("page_id", F.col("url").alias("raw")).select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(canonical(url), F.lit("")).alias("url"))
    rows = possible(rows, urls, urls.count())
    hits = rows.where("maybe").join(urls.select("url", F.lit(True).alias("listed")), "url", "left")
    rest = rows.where("not maybe").withColumn("listed", F.lit(None).cast("boolean"))
    both = hits.unionByName(rest, allowMissingColumns=False).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(F.coalesce("listed", F.lit(False)), "block").otherwise("allow")
    return both.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"))


def repeated(pages: DataFrame) -> DataFrame:
    """The list of the registered query: canonical URLs that stand for more than one page."""
    named = pages.select(canonical(F.col("url")).alias("name")).where("name <> ''").groupBy("name").count().where("count > 1")
    return named.select(F.col("name").alias("url"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, repeated(pages), listed_canonical=True)


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 3), '') AS query
  FROM pages
), c AS (
  SELECT *, regexp_replace(host, '^www\.|:(80|443)$', '', 'g') || regexp_replace(path, '/+$', '') AS stem,
    array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS kept
  FROM u
), n AS (SELECT *, stem || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS name FROM c),
r(verdict, host_end, under) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT *, count(*) OVER (PARTITION BY name) AS times FROM n)
SELECT page_id, host, path,
  (SELECT arg_max(host_end || under, length(host_end || under)) FROM r WHERE (host = host_end OR ends_with(host, '.' || host_end)) AND starts_with(path, under)) AS rule,
  coalesce((SELECT arg_max(verdict, length(host_end || under)) FROM r WHERE (host = host_end OR ends_with(host, '.' || host_end)) AND starts_with(path, under)),
    CASE WHEN name <> '' AND times > 1 THEN 'block' ELSE 'allow' END) AS verdict
FROM f
"""
