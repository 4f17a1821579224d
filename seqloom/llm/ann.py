"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few directions, shifted, cut to a grid and numbered along a Hilbert curve, once
for each of several curves. The curves share one random rotation and take its directions in turn, so none
sees what another has seen; that finds more than directions drawn for each curve alone, with windows of
half the size. Spark range-partitions each ordering, so a partition is a key block of even size; a query is
compared with the blocks around its own, in every ordering, and the neighbouring windows' findings are
merged and ranked by exact distance on the original vectors.

The window is a share of the ordering (``window``), so recall doesn't fall as the table grows; on
vectors without any structure the work then grows with queries times rows, as any exact-enough search
does there, and a smaller share serves clustered data. All windows together are ``CURVES * WINDOW`` of the
rows, below one: less than comparing with every row. Blocks are cut so that a window is a few of them
(tables of a few thousand rows have wider ones, since a block has 64 rows at least). Ranges of the grid
are fitted on at most ``SAMPLE`` vectors; every vector is indexed.

Equal vectors are one class that carries the smallest ids it can need, so a vector that half the
table shares is one point of the index. Rows of a class are cut before the shuffle (a ranked window).

Edge cases: null or zero vectors, and those with a null or non-finite component or another length
than most, take no part; ties go to the smaller id; rows repeated in id and vector count once; fewer
candidates than asked for are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table

CURVES = 16
DIRECTIONS = 4
BITS = 15
WINDOW = 0.06
#: Blocks of a window, and rows of a block at most: what a task holds at once.
WINDOW_BLOCKS = 7
BLOCK_ROWS = 32_768
SAMPLE = 10_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of grid cells (rows of unsigned coordinates) along the Hilbert curve.

    Coordinates are turned to the transposed key by undoing the rotations of each level from the top,
    then Gray-decoded and interleaved.
    """
    axes = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(len(axes)):
            set_ = (axes[i] & bit) != 0
            swap = np.where(set_, 0, (axes[0] ^ axes[i]) & low).astype(np.uint64)
            axes[0] = np.where(set_, axes[0] ^ low, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap if i else axes[0]
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros(len(cells), dtype=np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((axes[-1] >> np.uint64(level)) & one != 0, (one << np.uint64(level)) - one, 0).astype(np.uint64)
    key = np.zeros(len(cells), dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for a in axes:
            key = (key << one) | (((a ^ flip) >> np.uint64(level)) & one)
    return key


class Curves:
    """Projections, grid ranges and shifts of all orderings."""

    def __init__(self, sample: np.ndarray, dim: int, seed: int = 2):
        rng = np.random.default_rng(seed)
        k = min(DIRECTIONS, dim)
        turns = np.hstack([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(ceil(CURVES * k / dim))])
        self.bits, self.frames = BITS, []
        for n in range(CURVES):
            turned = turns[:, n * k : (n + 1) * k]
            seen = sample @ turned
            low, high = np.quantile(seen, [0.001, 0.999], axis=0) if len(seen) else (np.zeros(k), np.ones(k))
            self.frames.append((turned, low, np.where(high > low, high - low, 1.0), rng.random(k) / 2))

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        out = []
        for turned, low, width, shift in self.frames:
            place = ((vectors @ turned - low) / width + shift) / 1.5
            cells = np.clip(place * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.uint64)
            out.append(hilbert_keys(cells, self.bits).astype(np.int64))
        return out


def _usable(df: DataFrame, id_col: str, column: str) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part, and their dimension."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(column, lambda x: x != 0)
    rows = df.where(F.col(id_col).isNotNull() & F.col(column).isNotNull()).where(good).select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("v"))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = sizes["dim"] if sizes else 1
    return rows.where(F.size("v") == dim), dim


def _packed(rows: DataFrame, dim: int, kind: str) -> DataFrame:
    """(id, v): the vector as bytes, negative zeros made plain."""

    def run(batches):
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (dim * flat.itemsize))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends.buffers()[1], pa.py_buffer(flat.tobytes())])], names=["id", "v"])

    return rows.mapInArrow(run, "id long, v binary")


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype=kind).reshape(len(column), -1).astype(np.float64) if raw else np.zeros((0, 1))


def nearest_rows(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """The k nearest rows of each query by (exact distance, id)."""
    out = []
    norms = (rows**2).sum(axis=1)
    step = max(1, 4_000_000 // max(1, len(rows)))
    for a in range(0, len(queries), step):
        q = queries[a : a + step]
        own = (q**2).sum(axis=1)
        rough = own[:, None] + norms[None, :] - 2 * q @ rows.T
        margin = 1e-9 * (own + norms.max()) + 1e-300
        bound = (np.partition(rough, k - 1, axis=1)[:, k - 1] if len(rows) > k else rough.max(axis=1)) + margin
        for i in range(len(q)):
            near = np.flatnonzero(rough[i] <= bound[i])
            exact = np.sqrt(((rows[near] - q[i]) ** 2).sum(axis=1))
            order = np.lexsort((ids[near], exact))[:k]
            out.append(list(zip(exact[order].tolist(), ids[near][order].tolist())))
    return out


def search(df: DataFrame, is_query, id_col: str = "vec_id", column: str = "embedding", k: int = 10, window: float = WINDOW) -> DataFrame:
    """(query_id, rank, id, score): the k nearest of each row for which ``is_query(id column)`` holds."""
    kind = "<f4" if isinstance(df.schema[column].dataType.elementType, T.FloatType) else "<f8"
    usable, dim = _usable(df, id_col, column)
    rows = _packed(usable, dim, kind)
    ranked = rows.withColumn("n", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = cut(ranked.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("c"), "v", "ids"))
    queries = cut(rows.where(is_query(F.col("id"))).join(classes.select("v", "c"), "v").select("id", "c").distinct())

    sample = classes.orderBy(F.xxhash64("c"), "c").limit(SAMPLE).select("v").toArrow().column(0)
    curves = Curves(_matrix(sample, kind), dim)

    def keyed(batches):
        for b in batches:
            for n, key in enumerate(curves.keys(_matrix(b.column(1), kind)) if b.num_rows else []):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, n, dtype=np.int32)), pa.array(key), b.column(0)], names=["curve", "key", "c"])

    def numbered(batches):
        own = TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, own, dtype=np.int32)), b.column(0), b.column(2)], names=["block", "curve", "c"])

    count = classes.count()
    size = min(BLOCK_ROWS, max(64, ceil(count * window / WINDOW_BLOCKS)))
    ordering = classes.select("c", "v").mapInArrow(keyed, "curve int, key long, c long")
    blocks = cut(ordering.repartitionByRange(max(1, ceil(count * CURVES / size)), "curve", "key", "c").mapInArrow(numbered, "block int, curve int, c long"))
    parts = blocks.agg(F.count_distinct("block")).first()[0]  # as many as the orderings were really cut into
    reach = max(1, round((window * parts / CURVES - 1) / 2))

    placed = blocks.join(classes.select("c", "v"), "c")
    asked = blocks.join(queries.select("c").distinct(), "c").select("c", "curve", F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach)).alias("block"))
    asked = asked.join(classes.select("c", "v"), "c")
    both = placed.select("block", "curve", F.lit(0).alias("tag"), "c", "v").unionByName(asked.select("block", "curve", F.lit(1).alias("tag"), "c", "v"))

    def windows(batches):
        at, ids, mats, held = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            block, curve, tag, c = (b.column(i).to_numpy() for i in range(4))
            vectors = _matrix(b.column(4), kind)
            change = np.flatnonzero((block[1:] != block[:-1]) | (curve[1:] != curve[:-1]) | (tag[1:] != tag[:-1])) + 1
            for s, e in zip([0, *change.tolist()], [*change.tolist(), b.num_rows]):
                if (block[s], curve[s]) != at:
                    at, ids, mats, held = (block[s], curve[s]), [], [], None
                if tag[s] == 0:
                    ids.append(c[s:e])
                    mats.append(vectors[s:e])
                elif ids:
                    held = held or (np.concatenate(mats), np.concatenate(ids))
                    found = nearest_rows(vectors[s:e], *held, k + 1)
                    lengths = [len(x) for x in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c[s:e], lengths)), pa.array([i for x in found for _, i in x], pa.int64()), pa.array([d for x in found for d, _ in x], pa.float64())], names=["q", "c", "score"])

    dealt = both.repartition("block", "curve").sortWithinPartitions("block", "curve", "tag")
    found = dealt.mapInArrow(windows, "q long, c long, score double").groupBy("q", "c").agg(F.min("score").alias("score"))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "c"))).where(F.col("n") <= k + 1)
    members = best.join(classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("id"))
    members = members.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).where(F.col("n") <= k + 1)
    lists = members.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("found"))  # k + 1 at most
    own = queries.select(F.col("id").alias("query_id"), F.col("c").alias("q")).join(lists, "q")
    others = own.select("query_id", F.slice(F.filter("found", lambda x: x.id != F.col("query_id")), 1, k).alias("found"))
    return others.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 100; candidates: all others."""
    found = search(table(spark, sf_dir, "embeddings"), lambda key: key % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
