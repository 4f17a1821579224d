"""Suffix arrays and longest common prefixes by prefix doubling.

The first ranks come from as many symbols as two words hold, packed, in one pass. In a round, only suffixes
that still share their rank look at the rank ``h`` further on; the pairs are counted, and the counts inside
a rank give the new ranks, so no global window is needed. Suffixes whose rank is theirs alone are written
once, when they get it, and never again: a round costs a look-up and a grouping of what is unresolved.
Every round's ranks stay in the shared folder, as LCPs go down through them, unless no LCPs are wanted.

A sequence whose counted length is at most ``LOCAL_SYMBOLS`` is sorted by the same doubling inside one
task, on arrays: below that size the rounds' shuffles would cost far more than the sorting.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut
from ..plans.order import following, prefix_sum
from ..plans.sequence import Sequence, separated

#: Symbols that one packed word holds at most.
PACKED = 12
#: About 40 bytes a symbol, and 4 more for every round, in one task.
LOCAL_SYMBOLS = 6_000_000


@dataclass
class Suffixes:
    """sa(r, k) of a sequence (k, id); levels: (symbols compared, ranks (k, r)) by round, unless let go of (not ranked)."""

    sa: DataFrame
    seq: DataFrame
    n: int
    levels: list[tuple[int, DataFrame]] = field(default_factory=list)
    start: int = 1
    lcps: DataFrame | None = None
    ranked: bool = True


def sort_suffixes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCPs of non-negative numbers, in memory."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    dense = np.unique(t, return_inverse=True)[1] + 1  # 0 stands past the end
    width = max(1, min(62 // int(dense.max()).bit_length(), n))
    key = np.zeros(n, dtype=np.int64)
    for j in range(width):  # as many symbols as a word holds
        key = key * (int(dense.max()) + 1)
        key[: n - j] += dense[j:]
    rank, h = np.empty(n, dtype=np.int32), width
    order = np.argsort(key)
    run = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(run, np.arange(n), 0))
    levels = [(h, rank.copy())]
    size = np.diff(np.append(np.flatnonzero(run), n))
    todo = order[np.repeat(size > 1, size)]
    while todo.size:
        then = np.where(todo + h < n, rank[np.minimum(todo + h, n - 1)] + 1, 0).astype(np.int64)
        pair = rank[todo].astype(np.int64) * (n + 1) + then
        by = np.argsort(pair)
        todo, pair = todo[by], pair[by]
        old, at = rank[todo], np.arange(len(todo))
        group = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), at, 0))
        run = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[todo] = old + (np.maximum.accumulate(np.where(run, at, 0)) - group)
        size = np.diff(np.append(np.flatnonzero(run), len(todo)))
        todo, h = todo[np.repeat(size > 1, size)], 2 * h
        levels.append((h, rank.copy()))
    sa = np.empty(n, dtype=np.int64)
    sa[rank] = np.arange(n)
    p, q, common = sa[1:], sa[:-1], np.zeros(n - 1, dtype=np.int64)

    def grow(values, step):
        a, b = p + common, q + common
        inside = (a < n) & (b < n)
        same = inside & (values[np.minimum(a, n - 1)] == values[np.minimum(b, n - 1)])
        common[same] += step
        return same

    while levels:
        grow(levels[-1][1], levels[-1][0])
        levels.pop()
    for _ in range(width):
        if not grow(dense, 1).any():
            break
    return sa, np.concatenate(([0], common))


def _local(rows: DataFrame, n: int) -> DataFrame:
    def run(batches):
        t = np.zeros(n, dtype=np.int64)
        for b in batches:
            t[b.column(0).to_numpy()] = b.column(1).to_numpy()
        sa, common = sort_suffixes(t)
        for a in range(0, n, 500_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, min(n, a + 500_000))), pa.array(sa[a : a + 500_000]), pa.array(common[a : a + 500_000])], names=["r", "k", "lcp"])

    return cut(rows.select("k", "id").coalesce(1).mapInArrow(run, "r long, k long, lcp long"))


def suffix_array(seq: DataFrame, n: int, column: str = "id", local: int | None = None, lcps: bool = True) -> Suffixes:
    """Suffixes of (k, column) in order; one that is a prefix of another comes first.

    Up to ``local`` symbols (LOCAL_SYMBOLS) are sorted in one task, more in distributed rounds, of which
    no ranks stay if no ``lcps`` are wanted.
    """
    rows = cut(seq.select("k", F.col(column).cast("long").alias("id")))
    if n == 0:
        return Suffixes(rows.select(F.col("k").alias("r"), "k"), rows, 0)
    if n <= (LOCAL_SYMBOLS if local is None else local):
        sorted_ = _local(rows, n)
        return Suffixes(sorted_.select("r", "k"), rows, n, lcps=sorted_)
    largest = rows.agg(F.max("id")).first()[0]
    base = largest + 2  # 0 stands past the end
    width = max(1, min(PACKED, 62 // base.bit_length()))
    start = 2 * width
    symbol = lambda j: F.coalesce(F.col(f"x{j}") + 1, F.lit(0).cast("long"))
    word = lambda a: reduce(lambda x, j: x * base + symbol(j), range(a + 1, a + width), symbol(a))
    grams = following(rows, start).select("k", word(0).alias("high"), word(width).alias("low"))
    counts, _ = prefix_sum(grams.groupBy("high", "low").agg(F.count("*").alias("cnt")), ["high", "low"], "cnt", "r")
    state = cut(grams.join(counts, ["high", "low"]).select("k", "r", "cnt"))
    single, open_ = state.where("cnt = 1").select("k", "r"), cut(state.where("cnt > 1").select("k", "r"))
    levels, h = [(start, state.select("k", "r"))] if lcps else [], start
    if not lcps:
        single = cut(single)  # the others are in open_, so the first state goes
        del state, grams, counts
    while not open_.isEmpty():
        further = single.unionByName(open_).select((F.col("k") - h).alias("k"), F.col("r").alias("r2"))
        pairs = open_.join(further, "k", "left").select("k", "r", F.coalesce("r2", F.lit(-1).cast("long")).alias("r2"))
        sizes = pairs.groupBy("r", "r2").agg(F.count("*").alias("cnt"))
        before = F.coalesce(F.sum("cnt").over(Window.partitionBy("r").orderBy("r2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        finer = cut(pairs.join(sizes.withColumn("now", F.col("r") + before), ["r", "r2"]).select("k", F.col("now").alias("r"), "cnt"))
        if lcps:
            levels.append((2 * h, single.unionByName(finer.select("k", "r"))))
        single, open_ = single.unionByName(finer.where("cnt = 1").select("k", "r")), finer.where("cnt > 1").select("k", "r")
        h *= 2
    return Suffixes(single.select("r", "k"), rows, n, levels, start=start, ranked=lcps)


def generalized(s: Sequence, local: int | None = None, lcps: bool = True) -> tuple[Suffixes, Sequence]:
    """Suffixes of the groups of a sequence, with separators in group order below every symbol."""
    flat = separated(s)
    return suffix_array(flat.seq, flat.n, local=local, lcps=lcps), flat


def lcp(x: Suffixes) -> DataFrame:
    """(r, k, lcp): common prefix with the suffix before in order, 0 for the first.

    Distinct separators never match, so in a generalized array no prefix crosses one.
    """
    if x.lcps is not None:
        return x.lcps
    if not x.ranked:
        raise ValueError("the ranks of the rounds were let go of")
    above = x.sa.select((F.col("r") + 1).alias("r"), F.col("k").alias("q"))
    state = x.sa.join(above, "r", "left").select("r", "k", "q", F.lit(0).cast("long").alias("l"))
    for i, (h, ranks) in enumerate(reversed(x.levels)):
        left = ranks.select(F.col("k").alias("_p"), F.col("r").alias("_rp"))
        right = ranks.select(F.col("k").alias("_q"), F.col("r").alias("_rq"))
        state = state.join(left, F.col("k") + F.col("l") == F.col("_p"), "left").join(right, F.col("q") + F.col("l") == F.col("_q"), "left")
        state = state.select("r", "k", "q", (F.col("l") + F.when(F.col("_rp") == F.col("_rq"), h).otherwise(0)).alias("l"))
        if i % 4 == 3:
            state = cut(state)
    grams = following(x.seq, x.start).select("k", F.array(*(f"x{j}" for j in range(x.start))).alias("g"))
    left, right = grams.select(F.col("k").alias("_p"), F.col("g").alias("_gp")), grams.select(F.col("k").alias("_q"), F.col("g").alias("_gq"))
    state = state.join(left, F.col("k") + F.col("l") == F.col("_p"), "left").join(right, F.col("q") + F.col("l") == F.col("_q"), "left")
    same = F.zip_with("_gp", "_gq", lambda a, b: F.coalesce(a == b, F.lit(False)))
    more = F.when(F.col("_gp").isNull() | F.col("_gq").isNull(), 0).otherwise(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.lit(x.start)))
    return state.select("r", "k", F.when(F.col("q").isNull(), 0).otherwise(F.col("l") + more).cast("long").alias("lcp"))


def plcp(x: Suffixes) -> DataFrame:
    """(k, plcp): the same by position."""
    return lcp(x).select("k", F.col("lcp").alias("plcp"))
