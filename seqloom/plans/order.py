"""Global order without a global window.

Rows are range-partitioned and sorted by the order columns; each partition sums up its own rows, and
the partitions' totals, one number each, are carried over on the driver. The same primitive numbers
rows and builds distributed prefix sums. Neighbours are looked up inside buckets of consecutive
positions that borrow the first rows of the next bucket.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .lineage import cut

#: Consecutive positions that one window group holds.
BUCKET = 1 << 16


class OrderError(ValueError):
    """Rows that should have an order of their own share one."""


def _repeats(batch: pa.RecordBatch, order: list[str], last: list[pa.Scalar] | None) -> int:
    """Rows whose order columns equal those of the row before; ``last`` are those before the batch."""
    if not batch.num_rows:
        return 0
    same = np.ones(batch.num_rows, dtype=bool)
    same[0] = last is not None and [x.as_py() for x in last] == [batch.column(c)[0].as_py() for c in order]
    for c in order:
        a, b = batch.column(c)[1:], batch.column(c)[:-1]
        equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        same[1:] &= equal.to_numpy(zero_copy_only=False)
    return int(same.sum())


def prefix_sum(df: DataFrame, order: list[str], value: str | None = None, out: str = "before", partitions: int | None = None, unique: bool = False) -> tuple[DataFrame, int]:
    """Add ``out``, the sum of ``value`` (each row: 1) over the rows before in ``order``; also the total.

    ``unique``: raise OrderError if rows share their order; equal rows meet in one sorted partition, so
    that costs a look at neighbours.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_in", T.LongType()), T.StructField("_own", T.LongType()), T.StructField("_same", T.LongType())])

    def run(batches):
        part, total, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            same = np.zeros(b.num_rows, dtype=np.int64)
            if unique and b.num_rows:
                same[0] = _repeats(b, order, last)
                last = [b.column(c)[-1] for c in order]
            own = np.ones(b.num_rows, dtype=np.int64) if value is None else pc.cast(b.column(value), pa.int64()).to_numpy(zero_copy_only=False)
            sums = np.cumsum(own)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, dtype=np.int32)), pa.array(total + sums - own), pa.array(own), pa.array(same)], names=schema.names)
            total += int(sums[-1]) if b.num_rows else 0

    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, schema))
    found = placed.groupBy("_part").agg(F.sum("_own").alias("t"), F.sum("_same").alias("same")).collect()  # two numbers for each partition
    if repeated := sum(r["same"] for r in found):
        raise OrderError(f"{repeated} rows share their order with another")
    totals = {r["_part"]: r["t"] for r in found}
    sums = [totals.get(p, 0) for p in range(max(totals, default=-1) + 1)]
    starts = [0, *accumulate(sums)]
    first = F.array(*map(F.lit, starts))[F.col("_part")] if len(starts) > 1 else F.lit(0)
    return placed.withColumn(out, (F.col("_in") + first).cast("long")).drop("_part", "_in", "_own", "_same"), starts[-1]


def numbered(df: DataFrame, order: list[str], out: str = "k", check: bool = False) -> tuple[DataFrame, int]:
    """Add ``out``: 0-based position in the order, which must be unique (``check``: or it is an error); also the number of rows."""
    return prefix_sum(df, order, None, out, unique=check)


def following(df: DataFrame, m: int, column: str = "id", key: str = "k", group: str | None = None, prefix: str = "x", bucket: int = BUCKET) -> DataFrame:
    """Add ``x0``..``x{m-1}``: the column at this and the next positions, null past the end (of the group)."""
    if m > bucket:
        raise ValueError("look further than a bucket by joining positions")
    keep = df.columns
    at = F.expr(f"{key} div {bucket}")
    own = df.withColumn("_b", at).withColumn("_own", F.lit(True))
    rows = own
    if m > 1:
        halo = df.where((F.col(key) >= bucket) & (F.col(key) % bucket < m - 1)).withColumn("_b", at - 1).withColumn("_own", F.lit(False))
        rows = own.unionByName(halo)
    w = Window.partitionBy("_b").orderBy(key)

    def ahead(j: int) -> Column:
        then = F.lead(column, j).over(w)
        return F.when(F.lead(group, j).over(w) == F.col(group), then) if group else then

    return rows.select(*keep, "_own", F.col(column).alias(f"{prefix}0"), *(ahead(j).alias(f"{prefix}{j}") for j in range(1, m))).where("_own").drop("_own")
