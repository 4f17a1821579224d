"""N-gram counts: the brute-force answer that every index must give, and pattern samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..plans.order import following
from ..plans.sequence import Sequence, bounded


def ngrams(s: Sequence, m: int) -> DataFrame:
    """(k, p): the m symbols from each position that has so many (in its group)."""
    rows = following(s.seq, m, group=s.group)
    return rows.where(F.col(f"x{m - 1}").isNotNull()).select("k", F.array(*(f"x{j}" for j in range(m))).alias("p"))


def ngram_counts(s: Sequence, m: int) -> DataFrame:
    """(p, n_occ) of every distinct m-gram; overlapping occurrences count."""
    rows = following(s.seq, m, group=s.group).where(F.col(f"x{m - 1}").isNotNull())
    names = [f"x{j}" for j in range(m)]
    return rows.groupBy(*names).agg(F.count("*").alias("n_occ")).select(F.array(*names).alias("p"), "n_occ")


def brute_force(s: Sequence, patterns: DataFrame) -> DataFrame:
    """(pid, n_occ) by n-gram counting, for patterns(pid, p array of ids), one job for each length."""
    lengths = sorted(r[0] for r in patterns.select(F.size("p")).distinct().collect())
    parts = []
    for m in lengths:
        own = patterns.where(F.size("p") == m)
        if m == 0:
            parts.append(own.select("pid", F.lit(s.n).cast("long").alias("n_occ")))
        elif m > s.n:
            parts.append(own.select("pid", F.lit(0).cast("long").alias("n_occ")))
        else:
            parts.append(own.join(ngram_counts(s, m), "p", "left").select("pid", F.coalesce("n_occ", F.lit(0)).alias("n_occ")))
    out = parts[0] if parts else patterns.select("pid", F.lit(0).cast("long").alias("n_occ"))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample_patterns(s: Sequence, m: int, queries: int) -> DataFrame:
    """(pid, p): ``queries`` substrings of length m at positions drawn from their numbers (the first 2**31 positions)."""
    if m > s.n:
        raise ValueError("the pattern is longer than the sequence")
    first = draw(F.col("id"), m) % (s.n - m + 1)
    places = s.seq.sparkSession.range(queries).select(F.col("id").alias("pid"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: F.struct(j.alias("j"), (first + j).alias("k")))).alias("x"))
    met = s.seq.join(bounded(places.select("pid", "x.j", "x.k"), queries * m), "k")
    found = met.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("j", "id")))["id"].alias("p"), *([F.count("grp").alias("n"), F.min("grp").alias("low"), F.max("grp").alias("high")] if s.grouped else []))
    return (found.where(f"n = {m} and low = high") if s.grouped else found).select("pid", "p")
