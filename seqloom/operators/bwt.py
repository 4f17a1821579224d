"""Burrows-Wheeler transforms from suffix arrays, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.order import numbered
from .suffix import LOCAL_SYMBOLS, Suffixes, suffix_array


def circular(x: Suffixes) -> DataFrame:
    """(i, l): the symbol before each suffix in order, the last symbol before position 0."""
    before = x.seq.select(((F.col("k") + 1) % max(x.n, 1)).alias("k"), F.col("id").alias("l"))
    return x.sa.join(before, "k").select(F.col("r").alias("i"), "l")


def symbols_at(x: Suffixes, seq: DataFrame, column: str = "id", out: str = "p") -> DataFrame:
    """(i, p): another sequence's symbol at each suffix in order."""
    return x.sa.join(seq.select("k", F.col(column).alias(out)), "k").select(F.col("r").alias("i"), out)


def with_terminator(seq: DataFrame, n: int) -> DataFrame:
    """The sequence closed by the symbol 0."""
    end = seq.sparkSession.range(1).select(F.lit(n).cast("long").alias("k"), F.lit(0).cast("long").alias("id"))
    return seq.select("k", "id").unionByName(end)


def terminated(seq: DataFrame, n: int) -> tuple[DataFrame, Suffixes]:
    """(i, l) of the closed sequence, and its suffixes."""
    x = suffix_array(with_terminator(seq, n), n + 1)
    return circular(x), x


def plain(x: Suffixes) -> tuple[DataFrame, int]:
    """(i, sym) without any terminator, and the primary index.

    Row 0 is the last symbol; then come the symbols before the suffixes in order, without the row of
    the whole text, whose row number plus one is the primary index.
    """
    if x.n == 0:
        return x.sa.select(F.col("r").alias("i"), F.col("k").alias("sym")), 0
    whole = x.sa.where("k = 0").first()["r"]
    rest = x.sa.where("k > 0").join(x.seq.select((F.col("k") + 1).alias("k"), F.col("id").alias("sym")), "k")
    rest = rest.select(F.when(F.col("r") < whole, F.col("r") + 1).otherwise(F.col("r")).alias("i"), "sym")
    last = x.seq.where(F.col("k") == x.n - 1).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("sym"))
    return rest.unionByName(last), whole + 1


def check_rate(n: int, rate: int) -> None:
    """A sampling rate is a power of two, at least 2, or the length."""
    if rate != n and (rate < 2 or rate & (rate - 1)):
        raise ValueError("the sampling rate must be a power of two, at least 2, or the length")


def auxiliary(x: Suffixes, rate: int) -> DataFrame:
    """(t, isa1): suffix order plus one of every rate-th position; t = 0 is the primary index."""
    check_rate(x.n, rate)
    return x.sa.where(F.col("k") % rate == 0).select(F.expr(f"k div {rate}").alias("t"), (F.col("r") + 1).alias("isa1"))


def walk(t: np.ndarray, at: np.ndarray, pos: np.ndarray, rounds: int) -> np.ndarray:
    """Positions of the suffixes in order, in memory.

    t: the symbol before each, of which the sentinel is the smallest; at, pos: rows of known positions.
    """
    step = np.empty(len(t), dtype=np.int32 if len(t) < 1 << 31 else np.int64)
    step[np.argsort(t, kind="stable")] = np.arange(len(t), dtype=step.dtype)
    step[at] = at
    far, known = np.ones(len(t), dtype=np.int64), np.zeros(len(t), dtype=np.int64)
    far[at], known[at] = 0, pos
    for _ in range(rounds):
        then = step[step]
        if np.array_equal(then, step):
            break
        far += far[step]
        step = then
    return known[step] + far


def _walked(opened: DataFrame, n: int, primary: int, marks: DataFrame, rounds: int) -> DataFrame:
    """(k, id) by ``walk`` in one task; the rows of known positions come along with the others."""

    def run(batches):
        t, at, pos = np.zeros(n + 1, dtype=np.int64), [], []
        for b in batches:
            i, sym, p = (b.column(c) for c in range(3))
            known = p.is_valid().to_numpy(zero_copy_only=False)
            at.append(i.to_numpy()[known])
            pos.append(p.drop_null().to_numpy())
            t[i.to_numpy()[~known]] = sym.drop_null().to_numpy()
        t[primary] = np.iinfo(np.int64).min
        k = walk(t, np.concatenate(at), np.concatenate(pos), rounds) - 1
        for a in range(0, n + 1, 500_000):
            here = np.arange(a, min(n + 1, a + 500_000)) != primary
            yield pa.RecordBatch.from_arrays([pa.array(k[a : a + 500_000][here]), pa.array(t[a : a + 500_000][here])], names=["k", "id"])

    rows = opened.select("i", "sym", F.lit(None).cast("long").alias("pos")).unionByName(marks.select("i", F.lit(None).cast("long").alias("sym"), "pos"))
    return cut(rows.coalesce(1).mapInArrow(run, "k long, id long"))


def inverse(bwt: DataFrame, n: int, aux: DataFrame, rate: int | None = None, local: int | None = None) -> DataFrame:
    """(k, id) from (i, sym) and auxiliary indexes (t, isa1); the primary index alone is rate = n.

    The sentinel's row goes back in at the primary index. Each row's step leads to the suffix one
    position earlier; steps are doubled until every row has met a row whose position is known, in
    log2(rate) rounds. Up to ``local`` symbols (LOCAL_SYMBOLS) that is done in one task, on arrays.
    """
    rate = n if rate is None else rate
    check_rate(n, rate)
    if n == 0:
        return bwt.select(F.col("i").alias("k"), F.col("sym").alias("id"))
    marks = cut(aux.select(F.col("isa1").alias("i"), (F.col("t") * rate).alias("pos")))
    if not marks.where((F.col("i") < 1) | (F.col("i") > n)).isEmpty():
        raise ValueError("an index is outside 1..n")
    primary = marks.where("pos = 0").first()
    if primary is None:
        raise ValueError("the primary index is missing")
    at, rounds = primary["i"], max(1, rate.bit_length() + 1)
    opened = bwt.select(F.when(F.col("i") >= at, F.col("i") + 1).otherwise(F.col("i")).alias("i"), F.col("sym").cast("long").alias("sym"))
    if n <= (LOCAL_SYMBOLS if local is None else local):
        return _walked(opened, n, at, marks, rounds)
    sentinel = bwt.sparkSession.range(1).select(F.lit(at).cast("long").alias("i"), F.lit(None).cast("long").alias("sym"))
    stepped, _ = numbered(opened.unionByName(sentinel), ["sym", "i"], "nxt")  # null, the sentinel, comes first
    stepped = cut(stepped)
    state = stepped.join(marks, "i", "left").select("i", F.when(F.col("pos").isNull(), F.col("nxt")).alias("nxt"), F.coalesce("pos", F.lit(0)).alias("pos"), F.when(F.col("pos").isNull(), 1).otherwise(0).cast("long").alias("d"))
    for _ in range(rounds):
        state = cut(state)
        if state.where("nxt is not null").isEmpty():
            break
        target = state.select(F.col("i").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("pos").alias("pos2"), F.col("d").alias("d2"))
        moved = state.where("nxt is not null").join(target, "nxt").select("i", F.col("nxt2").alias("nxt"), F.col("pos2").alias("pos"), (F.col("d") + F.col("d2")).alias("d"))
        state = state.where("nxt is null").unionByName(moved)
    placed = state.select("i", (F.col("pos") + F.col("d")).alias("k"))
    return stepped.where("sym is not null").join(placed, "i").select((F.col("k") - 1).alias("k"), F.col("sym").alias("id"))


def inverse_primary(bwt: DataFrame, n: int, primary: int) -> DataFrame:
    """The text of a transform and its primary index."""
    one = bwt.sparkSession.range(1).select(F.lit(0).cast("long").alias("t"), F.lit(primary).cast("long").alias("isa1"))
    return inverse(bwt, n, one, n)
