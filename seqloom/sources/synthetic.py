"""Synthetic repetitive sequences: copies of an order-1 source with point mutations.

Nothing is stored: which symbols may follow a symbol, which of them does at a position, and where copies
mutate are draws from the numbers concerned. A symbol has ``FOLLOWERS`` followers, the r-th with weight
``r ** -STEEPNESS``. The base is made in stretches of ``STRETCH`` positions, each begun at a drawn symbol,
so tasks make stretches side by side; inside a task all its stretches take their steps together. One
transition in ``STRETCH`` is therefore drawn from all symbols.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import PRIME, draw, draws

FOLLOWERS = 8
STEEPNESS = 1.5
STRETCH = 256
#: Symbols are written as distinct 32-bit values: multiples of an odd number.
SPREAD = 2_654_435_761
#: Salts of the draws, to which seeds are added in steps of ten.
FOLLOWER, CHOICE, START, WHERE, WHAT = range(5)


def thresholds() -> list[int]:
    """Draws from the r-th of these on choose the follower after the r-th."""
    weights = [(r + 1) ** -STEEPNESS for r in range(FOLLOWERS)]
    return [int(sum(weights[: r + 1]) / sum(weights) * PRIME) for r in range(FOLLOWERS - 1)]


def _base(spark: SparkSession, sigma: int, length: int, salt: int) -> DataFrame:
    """(off, sym): the base."""
    limits = np.array(thresholds())

    def run(batches):
        for b in batches:
            begins = b.column(0).to_numpy() * STRETCH
            at = begins[:, None] + np.arange(STRETCH)
            choice = np.searchsorted(limits, draws(at, salt + CHOICE), side="right")
            sym = np.empty_like(at)
            now = draws(begins, salt + START) % sigma
            for j in range(STRETCH):  # a step of every stretch
                sym[:, j] = now
                now = draws(now * FOLLOWERS + choice[:, j], salt + FOLLOWER) % sigma
            inside = at < length
            yield pa.RecordBatch.from_arrays([pa.array(at[inside]), pa.array(sym[inside])], names=["off", "sym"])

    return spark.range((length + STRETCH - 1) // STRETCH).mapInArrow(run, "off long, sym long")


def generate(spark: SparkSession, sigma: int, base_len: int, copies: int, mutation: float, seed: int = 1) -> DataFrame:
    """(pos, val): copies of the base; each position mutates with probability ``mutation``, maybe to its own symbol."""
    salt = 10 * seed
    rows = _base(spark, sigma, base_len if copies else 0, salt).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(copies, 1) - 1).cast("long"))))
    pos = F.col("copy") * base_len + F.col("off")
    sym = F.when(draw(pos, salt + WHERE) < int(mutation * PRIME), draw(pos, salt + WHAT) % sigma).otherwise(F.col("sym"))
    return rows.select(pos.alias("pos"), (sym * SPREAD % (1 << 32)).alias("val"))
