"""Order-1 statistics of a sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut
from ..plans.order import following, prefix_sum
from ..plans.sequence import Sequence


def histogram(df: DataFrame, column: str = "id") -> DataFrame:
    """(sym, cnt)"""
    return df.groupBy(F.col(column).alias("sym")).agg(F.count("*").alias("cnt"))


def entropy(df: DataFrame, column: str = "id") -> DataFrame:
    """(h0): empirical entropy of order 0 in bits; 0 for no rows."""
    counts = histogram(df, column)
    total = F.sum("cnt").alias("n"), F.sum(F.col("cnt") * F.log2("cnt")).alias("x")
    return counts.agg(*total).select(F.coalesce(F.log2("n") - F.col("x") / F.col("n"), F.lit(0.0)).alias("h0"))


def pairs(s: Sequence) -> DataFrame:
    """(k, a, b): each position with the next symbol, null at the end (of its group)."""
    return following(s.seq, 2, group=s.group).select("k", F.col("x0").alias("a"), F.col("x1").alias("b"))


def bigrams(s: Sequence) -> DataFrame:
    """(a, b, cnt)"""
    return pairs(s).where("b is not null").groupBy("a", "b").agg(F.count("*").alias("cnt"))


def successors(s: Sequence) -> DataFrame:
    """(a, b, cnt, rk): rank of b among the successors of a, by count, then by smaller id."""
    return bigrams(s).withColumn("rk", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cnt"), "b")).cast("long"))


def encode(s: Sequence, succ: DataFrame | None = None) -> DataFrame:
    """(k, id, s): the rank of each next symbol, 0 where there is none."""
    succ = successors(s) if succ is None else succ
    found = pairs(s).join(succ.select("a", "b", "rk"), ["a", "b"], "left")
    return found.select("k", F.col("a").alias("id"), F.coalesce("rk", F.lit(0)).cast("long").alias("s"))


def cumulative(counts: DataFrame, size: int) -> DataFrame:
    """(sym, base) for sym in 0..size: how many symbols are smaller, absent ones included.

    counts(sym, cnt). Symbols are numbers, so prefix sums over a range of them cost one range shuffle.
    """
    every = counts.sparkSession.range(size + 1).select(F.col("id").alias("sym"))
    rows = every.join(counts, "sym", "left").select("sym", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    return prefix_sum(rows, ["sym"], "cnt", "base")[0].select("sym", "base")


def summary(s: Sequence, succ: DataFrame | None = None) -> DataFrame:
    """(n, sigma, bigrams, kE, h0): one row."""
    succ = cut(successors(s)) if succ is None else succ
    counted = succ.agg(F.count("*").alias("bigrams"), (F.coalesce(F.max("rk"), F.lit(0)) + 1).alias("kE"))
    return counted.crossJoin(entropy(s.seq)).select(F.lit(s.n).cast("long").alias("n"), F.lit(s.sigma).cast("long").alias("sigma"), "bigrams", "kE", "h0")
