"""Near duplicates by SimHash, found through an inverted index of byte positions.

A 64-bit fingerprint is eight bytes. Two fingerprints that differ in at most three bits differ in at
most three bytes, so they share at least five (position, byte) entries: the guaranteed minimum. A
posting list of a single byte holds 1/256 of the corpus, which pairs up quadratically, so the index
posts under small sets of positions instead, chosen so that any five of the eight positions contain
one of the sets; every pair that reaches the minimum meets under at least one key. Inside a posting
list, the shared positional bytes of two fingerprints are tallied, pairs below the minimum dropped
and the others verified by their differing bits.

Equal fingerprints collapse before the index. A posting list reports only a spanning forest of its
links (at most one edge per fingerprint, never all pairs), and a task turns its forests into stars.
Lists longer than ``LONG_LIST`` go to keys of five positions, which lose nothing either: a pair shares
five. Such a list has at most 2**24 different fingerprints, 128 MB; a long one is searched for every
difference of three bits in the 24, which is linear in its length. Components are joined by rounds of
neighbourhood minima on checkpointed edges.

Why sets of positions and not single bytes: the index is still one of positional bytes, and the tally and
its guaranteed minimum decide which pairs are verified, but a pair is only tallied where the posting key
already stands for four of its shared bytes.

Edge cases: null or wordless text has fingerprint zero and links like any other; texts shorter than a
shingle are one shingle; equal rows share a component; an empty table gives an empty result; clashing
extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, released, sliced, table

#: Distinct fingerprints under one four-position key beyond which five-position keys take over.
LONG_LIST = 20_000
#: Lists of more fingerprints may be looked up by differences instead of compared.
PROBED_LIST = 8_000
#: Links that a task holds before it draws them together.
MOST_LINKS = 500_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def majority(hashes) -> int:
    """SimHash of arrays of 64-bit hashes; a bit is set if over half of them have it."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for h in hashes:
        counts += np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles; a bit is set if over half of the shingle hashes have it."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()  # bytes.split() takes 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed = xxhash.xxh64_intdigest
    parts = (range(a, min(a + 65_536, len(starts))) for a in range(0, len(starts), 65_536))
    return majority(np.array([hashed(joined[s:e], seed) for s, e in zip(starts[p.start : p.stop].tolist(), ends[p.start : p.stop].tolist())], dtype="<u8") for p in parts)


def fingerprints(df: DataFrame, id_col: str = "doc_id", column: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): fingerprints as signed longs."""

    def run(batches):
        for b in sliced(batches, 1):
            out = np.array([fingerprint(x, width, seed) for x in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(column)).mapInArrow(released(run), "id long, fp long")


def covering(size: int, shared: int, bytes_in: int = 8) -> list[int]:
    """Position sets, as 64-bit masks: every ``shared`` of the eight positions contain one (greedy)."""
    open_, picked = set(combinations(range(bytes_in), shared)), []
    while open_:
        best = max(combinations(range(bytes_in), size), key=lambda s: (sum(set(s) <= set(x) for x in open_), s))
        picked.append(best)
        open_ = {x for x in open_ if not set(best) <= set(x)}
    return [sum(255 << 8 * p for p in s) for s in picked]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _probes(fps: np.ndarray, bits: int) -> list[int]:
    """What a fingerprint of the list can differ by from one it is linked to: up to so many of the bits that vary in the list."""
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    ones = [1 << i for i in range(64) if varying >> i & 1]
    return [sum(x) for k in range(1, bits + 1) for x in combinations(ones, k)]


def _list_links(fps: np.ndarray, bits: int, least: int) -> list[tuple[int, int]]:
    """Links that join every component among the sorted distinct fingerprints of one posting list.

    A list longer than there are differences to look for is looked up by these, so that no list costs the
    square of its length.
    """
    links, rest = [], fps
    if len(fps) > PROBED_LIST and len(probes := _probes(fps, bits)) * 4 < len(fps):
        for d in probes:
            other = fps ^ np.uint64(d)
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            hit = (fps[at] == other) & (other > fps)
            links += zip(fps[hit].tolist(), other[hit].tolist())
            if len(links) > MOST_LINKS:
                links = _joined(links)
        return links
    while rest.size > 1:
        wave, rest = [rest[0]], rest[1:]
        while wave and rest.size:
            own = wave.pop()
            other = rest ^ own
            shared = np.count_nonzero(other.view(np.uint8).reshape(-1, 8) == 0, axis=1)  # positional bytes in common
            near = shared >= least
            near[near] = np.bitwise_count(other[near]) <= bits
            if near.any():
                links += [(int(own), int(x)) for x in rest[near]]
                wave += rest[near].tolist()
                rest = rest[~near]
    return links


def _joined(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The links as (node, smallest node it is joined to by them)."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in root if root[x] != x]


def _linked(postings: DataFrame, bits: int, least: int) -> DataFrame:
    """(a, b) of posting lists; rows (mask, fp) come dealt and sorted by (mask, fp & mask)."""

    def run(batches):
        left_m, left_f, found = np.zeros(0, np.uint64), np.zeros(0, np.uint64), []

        def links(m, f, last):
            nonlocal left_m, left_f
            key = f & m
            new = np.flatnonzero((m[1:] != m[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = np.concatenate(([0], new, [len(m)])) if len(m) else np.zeros(1, np.int64)
            if not last and len(bounds) > 1:  # the last list may go on in the next batch
                left_m, left_f = m[bounds[-2] :], f[bounds[-2] :]
                bounds = bounds[:-1]
            for at in np.flatnonzero(np.diff(bounds) > 1).tolist():
                found.extend((_signed(a), _signed(b)) for a, b in _list_links(np.unique(f[bounds[at] : bounds[at + 1]]), bits, least))
                if len(found) > MOST_LINKS:  # a star for each component so far
                    found[:] = _joined(found)

        for b in batches:
            m = np.concatenate((left_m, b.column(0).to_numpy().view(np.uint64)))
            f = np.concatenate((left_f, b.column(1).to_numpy().view(np.uint64)))
            left_m, left_f = m[:0], f[:0]
            links(m, f, False)
        links(left_m, left_f, True)
        stars = np.array(_joined(found), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1])], names=["a", "b"])

    dealt = postings.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    return dealt.repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "fp").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): enough links between the distinct fingerprints (column fp) to join every component.

    ``bits`` differing bits leave at least ``8 - bits`` shared positional bytes.
    """
    least = 8 - bits
    if not 1 < least <= 8:
        raise ValueError("bits must be from 0 to 6")
    size = max(1, least - 1)
    post = lambda masks: F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask")
    first = distinct.select("fp", post(covering(size, least)))
    key = F.col("fp").bitwiseAND(F.col("mask"))
    # At most rows / LONG_LIST keys can be so long: few enough to broadcast, by the same ratio at every size.
    long_ = cut(first.groupBy("mask", key.alias("key")).count().where(F.col("count") > LONG_LIST).select("mask", "key"))
    if long_.isEmpty():
        return _linked(first, bits, least)
    keyed = first.withColumn("key", key)
    short = keyed.join(long_, ["mask", "key"], "left_anti").select("fp", "mask")
    over = keyed.join(long_, ["mask", "key"], "left_semi").select("fp", F.col("mask").alias("was"))
    finer = F.array(*(F.lit(_signed(m)) for m in covering(least, least)))
    again = over.select("fp", F.explode(F.filter(finer, lambda m: m.bitwiseAND(F.col("was")) == F.col("was"))).alias("mask")).distinct()
    return _linked(short, bits, least).unionByName(_linked(again, bits, least))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of an edge, the smallest node it is joined to.

    Alternating rounds of large and small stars; both work by minima over neighbourhoods, so a hub
    costs a partial aggregate and a join that Spark may split, never a list of its neighbours.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        around = both(edges)
        low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = cut(small.where("a <> b").distinct())
        edges = after
        # stars: no node is both a child and a root, and each child has one root
        roles = after.select(F.col("a").alias("node"), F.lit(1).alias("child")).unionByName(after.select(F.col("b").alias("node"), F.lit(0).alias("child")))
        if roles.groupBy("node").agg(F.sum("child").alias("up"), F.count_if(F.col("child") == 0).alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", column: str = "text", width: int = 3, bits: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp, component): one row per document; component is the smallest id reachable by links."""
    docs = cut(fingerprints(df, id_col, column, width, seed))
    distinct = cut(docs.groupBy("fp").agg(F.min("id").alias("first")))
    roots = cut(components(links(distinct.select("fp"), bits)))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component"))
    classes = named.join(smallest, "root").select("fp", "component")
    return docs.join(classes, "fp").select("id", "fp", "component")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
