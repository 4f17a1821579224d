"""Batched pattern counting by backward search.

Three plans give the same answers. If an index's run tables fit a broadcast (their sizes are counted
first), a kernel answers every pattern of an Arrow batch with array searches and no shuffle. Larger ones
that a task can hold are gathered, with the patterns, by one task that runs the same kernel, so that
nothing passes through the driver. Beyond that, the frontier of all patterns moves one symbol a step by
joins, and patterns that can't match any more drop out of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .runs import rank

#: Run and successor rows of an index that may be broadcast, about 16 bytes each.
BROADCAST_RUNS = 4_000_000
#: Such rows that one task may gather, about 50 bytes each, and symbols of patterns beside them.
GATHERED_RUNS = 16_000_000
GATHERED_SYMBOLS = 10_000_000


@dataclass
class Order1:
    """Order-1 index: succ(a, b, rk), base(sym, base), runs of BWT(S) and of the symbols at suffixes."""

    succ: DataFrame
    base: DataFrame
    bwt_runs: DataFrame
    psi_runs: DataFrame
    n: int
    sigma: int

    def tables(self) -> list[tuple[DataFrame, tuple[str, ...]]]:
        """Tables and columns that the kernel's arrays are made of."""
        return [(self.succ, ("a", "b", "rk")), (self.base, ("sym", "base")), (self.bwt_runs, ("c", "start", "fp")), (self.psi_runs, ("c", "start", "fp"))]

    def packer(self):
        return _order1_arrays(self.n, self.sigma)

    def kernel(self):
        return _order1_kernel(self.n, self.sigma)


@dataclass
class Plain:
    """Index on the terminated text: base(sym, base) and runs of its BWT; n counts the terminator."""

    base: DataFrame
    bwt_runs: DataFrame
    n: int
    sigma: int

    def tables(self) -> list[tuple[DataFrame, tuple[str, ...]]]:
        return [(self.base, ("sym", "base")), (self.bwt_runs, ("c", "start", "fp"))]

    def packer(self):
        return _plain_arrays(self.n)

    def kernel(self):
        return _plain_kernel(self.n, self.sigma)


class _Ranks:
    """rank_c(i) over sorted composite keys c * n + start and F positions."""

    def __init__(self, c: np.ndarray, start: np.ndarray, fp: np.ndarray, n: int):
        if len(c) and int(c.max() + 1) * (n + 1) >= 1 << 63:
            raise ValueError("symbols times length must stay below 2**63")
        order = np.argsort(c * n + start)
        self.n, self.keys, self.start = n, (c * n + start)[order], start[order]
        self.fp = np.concatenate((fp[order], [n]))

    def __call__(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        first = np.searchsorted(self.keys, c * self.n)
        last = np.searchsorted(self.keys, c * self.n + i) - 1  # the run before position i
        has = last >= first
        at = np.where(has, last, 0)
        if not len(self.keys):
            return np.zeros(len(c), dtype=np.int64)
        inside = np.minimum(i - self.start[at], self.fp[at + 1] - self.fp[at])
        low = self.fp[np.minimum(first, len(self.keys) - 1)]
        return np.where(has, self.fp[at] + inside - low, 0)


def _answered(pids: pa.Array, patterns: pa.Array, answer) -> pa.RecordBatch:
    lists = patterns.to_pylist()
    counts = np.zeros(len(lists), dtype=np.int64)
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    for m in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == m)
        counts[own] = answer(np.array([lists[i] for i in own.tolist()], dtype=np.int64).reshape(len(own), m))
    return pa.RecordBatch.from_arrays([pids, pa.array(counts)], names=["pid", "n_occ"])


def _broadcast(x: Order1 | Plain, patterns: DataFrame) -> DataFrame:
    made = x.packer()(*(_columns(t, *names) for t, names in x.tables()))
    shared, answer = patterns.sparkSession.sparkContext.broadcast(made), x.kernel()

    def run(batches):
        for b in batches:
            yield _answered(b.column(0), b.column(1), lambda p: answer(shared.value, p))

    kind = patterns.schema["pid"].dataType.simpleString()
    return patterns.select("pid", "p").mapInArrow(run, f"pid {kind}, n_occ long")


def _gathered(x: Order1 | Plain, patterns: DataFrame) -> DataFrame:
    kind = patterns.schema["pid"].dataType.simpleString()
    made, answer, widths = x.packer(), x.kernel(), [len(names) for _, names in x.tables()]
    nothing = lambda k: F.lit(None).cast(k)
    rows = patterns.select(F.lit(-1).alias("t"), *(nothing("long").alias(v) for v in "xyz"), "pid", F.col("p").cast("array<long>").alias("p"))
    for i, (table, names) in enumerate(x.tables()):
        values = [*(F.col(c).cast("long") for c in names), nothing("long")][:3]
        rows = rows.unionByName(table.select(F.lit(i).alias("t"), *(c.alias(v) for c, v in zip(values, "xyz")), nothing(kind).alias("pid"), nothing("array<long>").alias("p")))

    def run(batches):
        parts, asked = [[[] for _ in range(w)] for w in widths], []
        for b in batches:
            t = b.column(0).to_numpy()
            for v in np.unique(t).tolist():
                own = b.filter(pa.array(t == v))
                if v < 0:
                    asked.append((own.column(4), own.column(5)))
                else:
                    for j, part in enumerate(parts[v]):
                        part.append(own.column(1 + j).to_numpy())
        tables = []
        while parts:  # one table after the other, so that none is held twice for long
            tables.append([np.concatenate([np.zeros(0, np.int64), *part]) for part in parts.pop(0)])
        arrays = made(*tables)
        for pids, p in asked:
            yield _answered(pids, p, lambda p: answer(arrays, p))

    return cut(rows.coalesce(1).mapInArrow(run, f"pid {kind}, n_occ long"))


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a table that may be broadcast, as arrays."""
    table = df.select(*names).toArrow()
    return [table.column(n).to_numpy().astype(np.int64) for n in names]


def _base(sym: np.ndarray, base: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sym) + 1, dtype=np.int64)
    out[sym] = base
    return out


def _fits(index: Order1 | Plain, most: int) -> bool:
    return sum(t.limit(most + 1).count() for t, _ in index.tables()) <= most


def count(index: Order1 | Plain, patterns: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """(pid, n_occ) for patterns(pid, p array of ids); id 0 never matches.

    The empty pattern counts n in the order-1 index and n + 1, with the terminator, in the plain one.
    """
    if broadcast or broadcast is None and _fits(index, BROADCAST_RUNS):
        return _broadcast(index, patterns)
    if broadcast is None and _fits(index, GATHERED_RUNS) and (patterns.agg(F.sum(F.size("p"))).first()[0] or 0) <= GATHERED_SYMBOLS:
        return _gathered(index, patterns)
    return (_order1_joined if isinstance(index, Order1) else _plain_joined)(index, patterns)


def _order1_arrays(n: int, sigma: int):
    def made(succ, base, bwt_runs, psi_runs):
        a, b, rk = succ
        keys = a * (sigma + 1) + b
        order = np.argsort(keys)
        return _base(*base), keys[order], rk[order], _Ranks(*bwt_runs, n), _Ranks(*psi_runs, n)

    return made


def _order1_kernel(n: int, sigma: int):
    def answer(shared, p):
        before, pair_keys, pair_ranks, in_bwt, in_psi = shared
        m = p.shape[1]
        if m == 0 or n == 0:
            return np.full(len(p), n if m == 0 else 0)
        alive = np.flatnonzero(((p > 0) & (p <= sigma)).all(axis=1))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), n, np.int64)
        for j in range(m - 1, 0, -1):
            if not len(alive):
                break
            key = p[alive, j - 1] * (sigma + 1) + p[alive, j]
            at = np.minimum(np.searchsorted(pair_keys, key), max(len(pair_keys) - 1, 0))
            known = pair_keys[at] == key if len(pair_keys) else np.zeros(len(key), bool)
            c = np.where(known, pair_ranks[at] if len(pair_ranks) else 0, 0)
            low, high = before[c] + in_bwt(c, low), before[c] + in_bwt(c, high)
            keep = known & (low < high)
            alive, low, high = alive[keep], low[keep], high[keep]
        out = np.zeros(len(p), dtype=np.int64)
        out[alive] = in_psi(p[alive, 0], high) - in_psi(p[alive, 0], low)
        return out

    return answer


def _plain_arrays(n: int):
    return lambda base, bwt_runs: (_base(*base), _Ranks(*bwt_runs, n))


def _plain_kernel(n: int, sigma: int):
    def answer(shared, p):
        before, in_bwt = shared
        alive = np.flatnonzero(((p > 0) & (p <= sigma)).all(axis=1)) if p.shape[1] else np.arange(len(p))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), n, np.int64)
        for j in range(p.shape[1] - 1, -1, -1):
            c = p[alive, j]
            low, high = before[c] + in_bwt(c, low), before[c] + in_bwt(c, high)
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
        out = np.zeros(len(p), dtype=np.int64)
        out[alive] = high - low
        return out

    return answer


def _narrow(state: DataFrame, base: DataFrame, run_table: DataFrame) -> DataFrame:
    """One backward step of rows (pid, p, j, c, low, high); rows whose range becomes empty go."""
    ends = state.select("pid", "p", "j", "c", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("low").alias("i")), F.struct(F.lit(1).alias("end"), F.col("high").alias("i")))).alias("e")).select("pid", "p", "j", "c", "e.end", "e.i")
    ranked = rank(run_table, ends).join(base, F.col("c") == F.col("sym"))
    moved = ranked.groupBy("pid").agg(F.first("p").alias("p"), F.first("j").alias("j"), F.max(F.when(F.col("end") == 0, F.col("base") + F.col("rank"))).alias("low"), F.max(F.when(F.col("end") == 1, F.col("base") + F.col("rank"))).alias("high"))
    return cut(moved.where("low < high"))


def _order1_joined(x: Order1, patterns: DataFrame) -> DataFrame:
    state = cut(patterns.where("size(p) > 0 and forall(p, v -> v > 0)").select("pid", "p", F.size("p").alias("j"), F.lit(0).cast("long").alias("low"), F.lit(x.n).cast("long").alias("high")))
    longest = state.agg(F.max("j")).first()[0] or 0
    done = None
    for _ in range(longest):
        ready = state.where("j = 1")
        done = ready if done is None else done.unionByName(ready)
        todo = state.where("j > 1").withColumn("a", F.expr("p[j - 2]")).withColumn("b", F.expr("p[j - 1]")).join(x.succ.select("a", "b", F.col("rk").alias("c")), ["a", "b"])
        if todo.isEmpty():
            break
        state = _narrow(todo.withColumn("j", F.col("j") - 1), x.base, x.bwt_runs)
    found = None
    if done is not None:
        ends = done.select("pid", F.expr("p[0]").alias("c"), F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("low").alias("i")), F.struct(F.lit(1).alias("sign"), F.col("high").alias("i")))).alias("e")).select("pid", "c", "e.sign", "e.i")
        found = rank(x.psi_runs, ends).groupBy("pid").agg(F.sum(F.col("sign") * F.col("rank")).alias("found"))
    return _answers(patterns, found, x.n)


def _plain_joined(x: Plain, patterns: DataFrame) -> DataFrame:
    state = cut(patterns.where("size(p) > 0 and forall(p, v -> v > 0)").select("pid", "p", F.size("p").alias("j"), F.lit(0).cast("long").alias("low"), F.lit(x.n).cast("long").alias("high")))
    longest = state.agg(F.max("j")).first()[0] or 0
    done = None
    for _ in range(longest):
        state = _narrow(state.withColumn("c", F.expr("p[j - 1]")).withColumn("j", F.col("j") - 1), x.base, x.bwt_runs)
        ready = state.where("j = 0").select("pid", (F.col("high") - F.col("low")).alias("found"))
        done = ready if done is None else done.unionByName(ready)
        state = state.where("j > 0")
        if state.isEmpty():
            break
    return _answers(patterns, done, x.n)


def _answers(patterns: DataFrame, found: DataFrame | None, empty: int) -> DataFrame:
    """Every pattern gets a row; those that dropped out count 0."""
    if found is None:
        found = patterns.select("pid", F.lit(None).cast("long").alias("found")).limit(0)
    return patterns.join(found, "pid", "left").select("pid", F.when(F.size("p") == 0, empty).otherwise(F.coalesce("found", F.lit(0))).cast("long").alias("n_occ"))
