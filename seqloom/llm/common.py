"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, shared_dir

__all__ = ["cut", "released", "shared_dir", "sliced", "table", "text_of"]

#: Bytes of text that a task works on at once. An Arrow batch, up to 64 MB, is cut into such slices; a longer row is one of its own.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, through Spark's reader, so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """A text column with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def sliced(batches: Iterator[pa.RecordBatch], column: str | int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in zero-copy slices of about ``most`` bytes of a text or binary column."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        step = np.cumsum(sizes) // most
        for a, b in zip(cuts := [0, *(np.flatnonzero(np.diff(step)) + 1).tolist()], [*cuts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for mapInArrow that hands freed memory back at the end: workers are reused by later stages."""

    def own(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # no glibc
            pass

    return own
