"""Sequences from ordered tables: positions, dictionary, dense ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .order import OrderError, numbered

#: A table of at most so many rows may be broadcast: its rows are a few longs and short strings.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """The table, marked for broadcast if its counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass
class Sequence:
    """seq(k, id[, grp]) with its dictionary dict(val, id); n symbols, sigma different ones."""

    seq: DataFrame
    dict: DataFrame
    n: int
    sigma: int
    grouped: bool = False

    @property
    def group(self) -> str | None:
        return "grp" if self.grouped else None


class SequenceError(ValueError):
    """The rows don't form a sequence."""


def dictionary(df: DataFrame, column: str = "val") -> tuple[DataFrame, int]:
    """dict(val, id): ids 1.. by ascending value, from the distinct values alone."""
    ranked, sigma = numbered(df.select(F.col(column).alias("val")).distinct(), ["val"])
    return ranked.select("val", (F.col("k") + 1).alias("id")), sigma


def from_table(df: DataFrame, order: list[str], symbol: str | Column, group: str | None = None) -> Sequence:
    """The sequence of a table's symbols in a unique order (inside groups, if given: groups by value)."""
    symbol = F.col(symbol) if isinstance(symbol, str) else symbol
    keys = [*([group] if group else []), *order]
    rows = df.select(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(keys)), symbol.alias("val"))
    try:
        placed, n = numbered(rows, [f"_o{i}" for i in range(len(keys))], check=True)
    except OrderError as e:
        raise SequenceError(f"the order {keys} is not unique: {e}") from None
    if nulls := placed.where("val is null").count():
        raise SequenceError(f"{nulls} symbols are null")
    words, sigma = dictionary(placed)
    words = cut(words)
    seq = placed.join(bounded(words, sigma), "val").select("k", "id", *([F.col("_o0").alias("grp")] if group else []))
    return Sequence(cut(seq), words, n, sigma, bool(group))


def separated(s: Sequence) -> Sequence:
    """The groups laid end to end, each closed by a separator of its own.

    Separators take the ids 1..groups in group order, below every symbol; symbols move up.
    """
    groups, n_groups = numbered(s.seq.groupBy("grp").agg(F.max("k").alias("last")), ["grp"], "g")
    groups = bounded(cut(groups), n_groups)
    rows = s.seq.join(groups.select("grp", "g"), "grp").select((F.col("k") + F.col("g")).alias("k"), (F.col("id") + n_groups).alias("id"))
    ends = groups.select((F.col("last") + 1 + F.col("g")).alias("k"), (F.col("g") + 1).alias("id"))
    words = s.dict.select("val", (F.col("id") + n_groups).alias("id"))
    return Sequence(cut(rows.unionByName(ends)), words, s.n + n_groups, s.sigma + n_groups)


def pattern_ids(patterns: DataFrame, words: DataFrame, column: str = "p") -> DataFrame:
    """patterns(pid, p array of values) to (pid, p array of ids); values outside the dictionary become 0."""
    each = patterns.select("pid", F.posexplode(column).alias("j", "val"))
    ids = each.join(words, "val", "left").groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("j", F.coalesce("id", F.lit(0)).alias("id")))).alias("x"))
    return patterns.select("pid").join(ids, "pid", "left").select("pid", F.coalesce(F.col("x.id"), F.array().cast("array<bigint>")).alias("p"))
