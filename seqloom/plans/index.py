"""Building, storing, measuring and checking indexes."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sizes
from ..operators import bwt, ngram, runs, search, stats
from ..operators.suffix import Suffixes, suffix_array
from .lineage import cut
from .sequence import Sequence, pattern_ids

KIND = "order1"


@dataclass
class Built:
    """Everything that a build makes: the index and the tables it came from."""

    sequence: Sequence
    succ: DataFrame
    encoded: DataFrame
    suffixes: Suffixes
    bwt: DataFrame
    psi: DataFrame
    index: search.Order1
    kinds: int


def build(s: Sequence) -> Built:
    """The order-1 index of a sequence."""
    succ = cut(stats.successors(s))
    encoded = cut(stats.encode(s, succ))
    kinds = succ.agg(F.coalesce(F.max("rk"), F.lit(0)) + 1).first()[0]
    x = suffix_array(encoded, s.n, "s")
    l, p = cut(bwt.circular(x)), cut(bwt.symbols_at(x, s.seq))
    base = cut(stats.cumulative(stats.histogram(encoded, "s"), kinds))
    index = search.Order1(succ, base, runs.runs(l, "l", s.n), runs.runs(p, "p", s.n), s.n, s.sigma)
    return Built(s, succ, encoded, x, l, p, index, kinds)


def build_plain(s: Sequence) -> tuple[search.Plain, DataFrame]:
    """The index on the terminated text, and its transform (i, l)."""
    closed = cut(bwt.with_terminator(s.seq, s.n))
    x = suffix_array(closed, s.n + 1)
    l = cut(bwt.circular(x))
    base = cut(stats.cumulative(stats.histogram(closed), s.sigma + 1))
    return search.Plain(base, runs.runs(l, "l", s.n + 1), s.n + 1, s.sigma), l


def save(b: Built, folder: str) -> None:
    """The index as a folder of Parquet tables; the metadata are written last."""
    i = b.index
    for name, df in (("succ", i.succ), ("base", i.base), ("bwt_runs", i.bwt_runs), ("psi_runs", i.psi_runs), ("dict", b.sequence.dict)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    meta = json.dumps({"kind": KIND, "n": i.n, "sigma": i.sigma, "kinds": b.kinds})
    b.succ.sparkSession.range(1).select(F.lit(meta).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def load(spark: SparkSession, folder: str) -> tuple[search.Order1, DataFrame]:
    """The index of a folder and its dictionary."""
    meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
    if meta.get("kind") != KIND:
        raise ValueError("bad index file")
    t = {n: spark.read.parquet(f"{folder}/{n}") for n in ("succ", "base", "bwt_runs", "psi_runs", "dict")}
    return search.Order1(t["succ"], t["base"], t["bwt_runs"], t["psi_runs"], meta["n"], meta["sigma"]), t["dict"]


def count_values(index, words: DataFrame, patterns: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """(pid, n_occ) for patterns of raw values."""
    return search.count(index, pattern_ids(patterns, words), broadcast)


def build_report(b: Built) -> DataFrame:
    """(n, sigma, kE, bwt_runs, psi_runs, bytes): one row; bytes of the default form."""
    i = b.index
    made = i.bwt_runs.agg(F.count("*").alias("bwt_runs")).crossJoin(i.psi_runs.agg(F.count("*").alias("psi_runs"))).first()
    size = next(r["bytes"] for r in size_rows(b) if r["form"] == "order-1 rl-huffman")
    return b.succ.sparkSession.range(1).select(*(F.lit(int(v)).cast("long").alias(k) for k, v in (("n", i.n), ("sigma", i.sigma), ("kE", b.kinds), ("bwt_runs", made[0]), ("psi_runs", made[1]), ("bytes", size))))


def size_rows(b: Built, plain: tuple[search.Plain, DataFrame] | None = None) -> list[dict]:
    """Modelled bytes of each form; the plain index's four if it is given."""
    i = b.index

    def by_symbol(table):
        return sizes.frequencies(table, "c")

    out = []
    n, sig = i.n, i.sigma
    shared = sizes.rankings(sig, b.succ.count(), b.kinds)
    bwt_by, psi_by = by_symbol(i.bwt_runs), by_symbol(i.psi_runs)
    r, rp = (sum(f * c for f, c in x) for x in (bwt_by, psi_by))
    d = sum(c for _, c in bwt_by)
    psi_ef = sizes.ef_rank(n, rp, sig + 1)
    cost, head = sizes.huffman_cost(sizes.frequencies(b.bwt, "l")), sizes.huffman_cost(bwt_by)
    for form, size in (
        ("order-1 explicit", sizes.run_rank(n, r, b.kinds, bwt_by) + sizes.run_rank(n, rp, sig + 1, psi_by)),
        ("order-1 elias-fano", sizes.ef_rank(n, r, b.kinds) + psi_ef),
        ("order-1 huffman", sizes.huffman_tree(cost, b.kinds, d) + psi_ef),
        ("order-1 rl-huffman", sizes.run_huffman(head, n, r, b.kinds, d) + psi_ef),
    ):
        out.append({"form": form, "bytes": shared + size, "depth": cost / n if "rl" not in form and n else head / r if r else 0.0})
    if plain is not None:
        x, l = plain
        by = by_symbol(x.bwt_runs)
        r, d, base = sum(f * c for f, c in by), sum(c for _, c in by), 8 * (sig + 2)
        cost, head = sizes.huffman_cost(sizes.frequencies(l, "l")), sizes.huffman_cost(by)
        for form, size in (
            ("plain explicit", sizes.run_rank(x.n, r, sig + 1, by)),
            ("plain elias-fano", sizes.ef_rank(x.n, r, sig + 1)),
            ("plain huffman", sizes.huffman_tree(cost, sig + 1, d)),
            ("plain rl-huffman", sizes.run_huffman(head, x.n, r, sig + 1, d)),
        ):
            out.append({"form": form, "bytes": base + size, "depth": cost / x.n if "rl" not in form else head / r if r else 0.0})
    return out


def size_report(b: Built, plain=None) -> DataFrame:
    """(form, bytes, depth, shown)"""
    rows = [F.struct(F.lit(r["form"]).alias("form"), F.lit(int(r["bytes"])).cast("long").alias("bytes"), F.lit(float(r["depth"])).alias("depth"), F.lit(sizes.megabytes(r["bytes"])).alias("shown")) for r in size_rows(b, plain)]
    return b.succ.sparkSession.range(1).select(F.inline(F.array(*rows)))


def disagreements(b: Built, plain: search.Plain, patterns: DataFrame) -> DataFrame:
    """(pid, brute, order1, plain) where the indexes, in either plan, and brute force don't all agree."""
    brute = ngram.brute_force(b.sequence, patterns).withColumnRenamed("n_occ", "brute")
    found = brute
    for name, index, how in (("order1", b.index, True), ("plain", plain, True), ("order1_joined", b.index, False), ("plain_joined", plain, False)):
        found = found.join(search.count(index, patterns, how).withColumnRenamed("n_occ", name), "pid", "left")
    return found.where("not (brute <=> order1 and brute <=> plain and brute <=> order1_joined and brute <=> plain_joined)")


def perturbed(patterns: DataFrame, sigma: int) -> DataFrame:
    """Patterns of which every third has one symbol replaced, by a hash of its number."""
    at = F.pmod(F.xxhash64("pid", F.lit(1)), F.size("p"))
    sym = F.pmod(F.xxhash64("pid", F.lit(2)), F.lit(sigma)) + 1
    return patterns.withColumn("p", F.when(F.col("pid") % 3 == 0, F.transform("p", lambda x, i: F.when(i == at, sym).otherwise(x))).otherwise(F.col("p")))


def bench_report(b: Built, plain: tuple[search.Plain, DataFrame]) -> DataFrame:
    """(metric, value): n, sigma, h0, kE, bigrams, run counts."""
    one = stats.summary(b.sequence, b.succ).first()
    rows = [("n", one["n"]), ("sigma", one["sigma"]), ("h0", one["h0"]), ("kE", one["kE"]), ("bigrams", one["bigrams"]), ("runs_bwt_s", b.index.bwt_runs.count()), ("runs_psi", b.index.psi_runs.count()), ("runs_bwt_t", plain[0].bwt_runs.count())]
    return b.succ.sparkSession.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), F.lit(float(v)).alias("value")) for k, v in rows))))
