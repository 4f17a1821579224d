"""Generalized suffix arrays of the words of whole documents, on packed arrays.

A row for each suffix takes several times the bytes of its word. Here all frames hold compressed arrays,
a few bytes a suffix. Documents are cut into slices of whole documents; suffixes are (slice, offset).
The first symbols, packed into two words, are sorted in buckets of the rank space, a part of the buckets
at a time, so that no more than a part of the keys is on disk. Then, in rounds, suffixes that still share
their rank send it, with the ranks some steps further on, to the bucket of their rank, and get finer ones
back. A suffix that shares its rank looks no further than its document's separator, so ranks are looked
up inside the slice. One whose last look-up left its set had a unique rank there, which the rows carry.
As in ``suffix``, at most ``LOCAL_SYMBOLS`` symbols are sorted in one task.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut, tidy
from ..plans.order import OrderError, numbered
from ..plans.sequence import SequenceError
from . import suffix

#: Words of a slice of documents, suffixes of a bucket and different words of a bucket, about.
SLICE = BUCKET = 1 << 21
WORDS = 1 << 20
#: Parts of the rank space that the first sort takes one after the other.
PASSES = 4
#: Samples for each bucket.
SAMPLES = 64
#: Suffixes that share their first symbols and that one task may hold, about.
LARGEST = 16_000_000
#: Ranks that a round compares; the first one, which has the most to send, compares two.
REACH = 4
#: to: slice or bucket; what tag and at mean is said where rows are made.
SCHEMA = "to int, tag int, at long, data binary"

Row = tuple[int, int, int, bytes]


class TooLarge(ValueError):
    """More suffixes share their first symbols than one task may hold."""


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers: differences if ascending, in as few bytes as they need, compressed."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.asarray(a, dtype=np.int64)
        first, rising = (int(a[0]) if len(a) else 0), len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        if rising:
            a = np.diff(a)
        least = int(a.min()) if len(a) else 0
        width = (int(a.max()) - least if len(a) else 0).bit_length() + 7 >> 3
        raw = np.ascontiguousarray((a - least).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
        data = pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True) if raw else b""
        out += [struct.pack("<qqqBBq", len(a), least, first, width, rising, len(data)), data]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(data[0]):
        n, least, first, width, rising, size = struct.unpack_from("<qqqBBq", data, at)
        at += struct.calcsize("<qqqBBq")
        a = np.full(n, least, dtype=np.int64)
        if width and n:
            raw = np.frombuffer(pa.Codec("zstd").decompress(data[at : at + size], n * width), dtype=np.uint8).reshape(width, n)
            for j in range(width):
                a += raw[j].astype(np.int64) << (8 * j)
        if rising:
            a = np.concatenate(([first], first + np.cumsum(a)))
        out.append(a)
        at += size
    return out


def _batch(row: Row) -> pa.RecordBatch:
    to, tag, at, data = row
    return pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([tag], pa.int32()), pa.array([at], pa.int64()), pa.array([data], pa.binary())], names=["to", "tag", "at", "data"])


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[Row]:
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in b.columns)


def each(df: DataFrame, f: Callable[[Row], Iterable[Row]]) -> DataFrame:
    """What f makes of each row."""

    def run(batches):
        for row in _rows(batches):
            yield from map(_batch, f(row))

    return df.mapInArrow(run, SCHEMA)


def gathered(df: DataFrame, n: int, f: Callable[[list[Row]], Iterable[Row]]) -> DataFrame:
    """What f makes of the rows of each ``to`` below n; each has a task of its own."""

    def run(batches):
        if rows := list(_rows(batches)):
            yield from map(_batch, f(rows))

    return df.repartitionById(n, "to").mapInArrow(run, SCHEMA)


def _starts(counts: dict[int, int], n: int) -> np.ndarray:
    return np.array([0, *accumulate(counts.get(i, 0) for i in range(n))], dtype=np.int64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys differ from those before."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


@dataclass
class Documents:
    """rows: (slice, 0, 0, symbols) and (slice, 1, 0, (ids, lengths in words)); symbols 1..groups separate, words follow in byte order."""

    rows: DataFrame
    slices: int
    n: int
    groups: int
    sigma: int

    @property
    def base(self) -> int:
        return self.groups + self.sigma + 1

    @property
    def width(self) -> int:
        return max(1, 62 // self.base.bit_length())


def _joined(words: pa.Array) -> bytes:
    raw = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py().encode()
    return struct.pack("<q", len(raw)) + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _words(data: bytes) -> pa.Array:
    raw = pa.Codec("zstd").decompress(data[8:], struct.unpack_from("<q", data)[0], asbytes=True)
    return pc.split_pattern(pa.array([raw.decode()]), "\n").flatten()


def documents(df: DataFrame) -> Documents:
    """The words of (whole number, text), split at ASCII whitespace; documents without words have no part."""

    def tokens(batches):
        """(0, 0, slice, (ids, lengths, codes)), (0, 1, slice, the words of the codes) of slices named by partition and count."""
        part, made, size, ids, lens, words = TaskContext.get().partitionId(), 0, 0, [], [], []

        def finish():
            named = part << 32 | made
            coded = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            yield _batch((0, 0, named, pack(np.concatenate(ids), np.concatenate(lens), rank[coded.indices.to_numpy()])))
            yield _batch((0, 1, named, _joined(coded.dictionary.take(pa.array(order)))))

        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < b.num_rows:
                z = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + 4 * SLICE, "right")))
                split = pc.ascii_split_whitespace(pc.fill_null(pc.cast(b.column(1).slice(a, z - a), pa.string()), ""))
                flat = split.flatten()
                full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
                ends = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))))
                length = np.diff(np.concatenate(([0], np.cumsum(full)))[ends])
                ids.append(b.column(0).slice(a, z - a).to_numpy(zero_copy_only=False).astype(np.int64)[length > 0])
                lens.append(length[length > 0])
                words.append(flat.filter(pa.array(full)))
                size, a = size + int(length.sum()), z
                if size >= SLICE:
                    yield from finish()
                    made, size, ids, lens, words = made + 1, 0, [], [], []
        if size:
            yield from finish()

    local = cut(df.mapInArrow(tokens, SCHEMA))
    slices = {r["at"]: i for i, r in enumerate(local.where("tag = 0").select("at").orderBy("at").collect())}  # one number a slice
    ns = len(slices)
    if not ns:
        return Documents(local, 0, 0, 0, 0)

    def ids(batches):
        for _, _, at, data in _rows(batches):
            own = unpack(data)[0]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), slices[at], dtype=np.int32)), pa.array(np.arange(len(own)))], names=["id", "to", "i"])

    try:
        order, groups = numbered(local.where("tag = 0").mapInArrow(ids, "id long, to int, i long"), ["id"], "g", check=True)
    except OrderError as e:
        raise SequenceError(f"documents share their id: {e}") from None

    def placed(batches):
        for b in batches:
            to, i, g = (b.column(c).to_numpy() for c in ("to", "i", "g"))
            by = np.lexsort((i, to))
            for part in np.split(by, np.flatnonzero(np.diff(to[by])) + 1):
                if len(part):
                    yield _batch((int(to[part[0]]), 2, 0, pack(i[part], g[part])))

    def sampled(batches):
        for row in _rows(batches):
            w = _words(row[3])
            some = w.take(pa.array(np.arange(0, len(w), max(1, WORDS // SAMPLES))))
            yield pa.RecordBatch.from_arrays([some, pa.array(np.full(len(some), len(w)))], names=["w", "n"])

    some = sorted(x["w"].encode() for x in local.where("tag = 1").mapInArrow(sampled, "w string, n long").select("w").collect())
    bounds = sorted(set(some[SAMPLES::SAMPLES]))
    nw = len(bounds) + 1

    def pieces(row):
        w = _words(row[3])
        cuts = [0, *(bisect_left(range(len(w)), x, key=lambda i: w[i].as_py().encode()) for x in bounds), len(w)]
        for j in range(nw):
            if cuts[j] < cuts[j + 1]:
                yield j, slices[row[2]], cuts[j], _joined(w.slice(cuts[j], cuts[j + 1] - cuts[j]))

    def ranked(rows):
        parts = [_words(r[3]) for r in rows]
        coded = pa.chunked_array(parts, pa.string()).combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        codes, at = rank[coded.indices.to_numpy()], 0
        yield 0, -1, rows[0][0], pack([len(order)])
        for r, p in zip(rows, parts, strict=True):
            yield r[1], 3, r[0] << 40 | r[2], pack(codes[at : at + len(p)])
            at += len(p)

    found = cut(gathered(each(local.where("tag = 1"), pieces), nw, ranked))
    counts = {r["at"]: int(unpack(bytes(r["data"]))[0][0]) for r in found.where("tag = -1").collect()}  # a number a bucket
    starts = _starts(counts, nw)

    def assembled(rows):
        own, length, codes = next(unpack(r[3]) for r in rows if r[1] == 0)
        value = np.zeros(int(codes.max()) + 1, dtype=np.int64)
        g = np.zeros(len(own), dtype=np.int64)
        for _, tag, at, data in rows:
            if tag == 2:
                i, v = unpack(data)
                g[i] = v + 1
            elif tag == 3:
                v = unpack(data)[0] + starts[at >> 40]
                first = at & (1 << 40) - 1
                value[first : first + len(v)] = v + groups + 1
        ends = np.cumsum(length + 1) - 1
        symbols = np.empty(int(ends[-1]) + 1, dtype=np.int64)
        within = np.ones(len(symbols), dtype=bool)
        within[ends] = False
        symbols[ends], symbols[within] = g, value[codes]
        yield rows[0][0], 0, len(symbols), pack(symbols)
        yield rows[0][0], 1, 0, pack(own, length)

    text = each(local.where("tag = 0"), lambda r: [(slices[r[2]], 0, 0, r[3])])
    rows = cut(gathered(text.unionByName(found.where("tag = 3")).unionByName(order.mapInArrow(placed, SCHEMA)), ns, assembled))
    n = rows.agg(F.sum("at")).first()[0]
    return Documents(rows, ns, n, groups, int(starts[-1]))


def _keys(symbols: np.ndarray, base: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2 * width symbols of every suffix in two numbers; behind its separator, which is unique, anything may follow."""
    more = np.concatenate((symbols, np.zeros(2 * width, dtype=np.int64)))
    out = []
    for a in (0, width):
        key = np.zeros(len(symbols), dtype=np.int64)
        for j in range(a, a + width):
            key = key * base + more[j : j + len(symbols)]
        out.append(key)
    return out[0], out[1]


def _bounds(d: DataFrame, n: int, keys: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Lower bounds of buckets but the first, from samples of the keys of rows of symbols."""
    step = max(1, BUCKET // SAMPLES)

    def run(batches):
        for _, _, _, data in _rows(batches):
            symbols = unpack(data)[0]
            hi, lo = keys(symbols)
            # one of each stretch, at a place that follows no period
            at = np.arange(0, len(symbols), step)
            at = np.minimum(at + (at * 2654435761 % (1 << 32) >> 7) % step, len(symbols) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(hi[at]), pa.array(lo[at])], names=["hi", "lo"])

    some = sorted(map(tuple, d.where("tag = 0").mapInArrow(run, "hi long, lo long").collect()))  # SAMPLES a bucket
    most = max(np.unique(np.array(some).reshape(-1, 2), axis=0, return_counts=True)[1], default=0)
    if most > 8 and most / len(some) * n > LARGEST:
        raise TooLarge(f"about {most / len(some) * n:.0f} suffixes begin with the same symbols")
    return sorted(set(some[SAMPLES::SAMPLES]))


def _split(hi: np.ndarray, lo: np.ndarray, bounds: list[tuple[int, int]]) -> list[int]:
    """Where buckets begin in sorted keys."""
    out = [0]
    for h, x in bounds:
        a, z = np.searchsorted(hi, h, "left"), np.searchsorted(hi, h, "right")
        out.append(int(a + np.searchsorted(lo[a:z], x, "left")))
    return [*out, len(hi)]


def _sent_back(where: np.ndarray, off: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The arrays by slice, in order of offsets."""
    by = np.argsort(where << 40 | off)
    where = where[by]
    edges = np.flatnonzero(_runs(where)).tolist() + [len(where)]
    for a, z in zip(edges, edges[1:], strict=False):
        yield int(where[a]), pack(off[by[a:z]], *(v[by[a:z]] for v in values))


def _first_ranks(d: Documents) -> tuple[list[DataFrame], np.ndarray]:
    """(slice, 0, bucket, (offset, rank inside the bucket and whether others share it)) by the first symbols; where buckets begin."""
    base, width = d.base, d.width
    bounds = _bounds(d.rows, d.n, lambda s: _keys(s, base, width))
    nb = len(bounds) + 1
    counts, parts = {}, []
    edges = sorted({nb * p // PASSES for p in range(PASSES + 1)})
    for first, last in zip(edges, edges[1:], strict=False):
        low, high, inner = (bounds[first - 1] if first else None), (bounds[last - 1] if last < nb else None), bounds[first : last - 1]

        def keyed(row, low=low, high=high, inner=inner):
            hi, lo = _keys(unpack(row[3])[0], base, width)
            take = np.ones(len(hi), dtype=bool)
            if low:
                take &= (hi > low[0]) | ((hi == low[0]) & (lo >= low[1]))
            if high:
                take &= (hi < high[0]) | ((hi == high[0]) & (lo < high[1]))
            off = np.flatnonzero(take)
            hi, lo = hi[off], lo[off]
            by = np.lexsort((lo, hi))
            off, hi, lo = off[by], hi[by], lo[by]
            at = _split(hi, lo, inner)
            for j, (a, z) in enumerate(zip(at, at[1:], strict=False)):
                if a < z:
                    yield j, row[0], 0, pack(hi[a:z], lo[a:z], off[a:z])

        def sorted_(rows, first=first):
            got = [unpack(r[3]) for r in rows]
            where = np.repeat(np.array([r[1] for r in rows], dtype=np.int64), [len(g[0]) for g in got])
            hi, lo, off = (np.concatenate([g[j] for g in got]) for j in range(3))
            del got
            by = np.lexsort((lo, hi))
            begin = np.flatnonzero(_runs(hi[by], lo[by]))
            size = np.diff(np.append(begin, len(by)))
            value = np.repeat(begin * 2 + (size > 1), size)
            bucket = first + rows[0][0]
            yield 0, -1, bucket, pack([len(by)])
            for to, data in _sent_back(where[by], off[by], value):
                yield to, 0, bucket, data

        tidy(d.rows.sparkSession, now=True)
        part = cut(gathered(each(d.rows.where("tag = 0"), keyed), last - first, sorted_))
        counts |= {r["at"]: int(unpack(bytes(r["data"]))[0][0]) for r in part.where("tag = -1").collect()}  # a number a bucket
        parts.append(part.where("tag = 0"))
    return parts, _starts(counts, nb)


def _by_bucket(slice_: int, starts: np.ndarray, r: np.ndarray, *values: np.ndarray) -> Iterator[Row]:
    by = np.argsort(r, kind="stable")
    r = r[by]
    at = np.searchsorted(r, starts)
    at[-1] = len(r)
    for j in np.flatnonzero(np.diff(at)):
        a, z = at[j], at[j + 1]
        yield int(j), slice_, 0, pack(r[a:z], *(v[by[a:z]] for v in values))


def _finer(rows: list[Row]) -> Iterator[Row]:
    """(slice, 0, 0, (offset, rank, whether others share it, the first of the ranks further on)) of suffixes of a bucket."""
    got = [unpack(r[3]) for r in rows]
    where = np.repeat(np.array([r[1] for r in rows], dtype=np.int64), [len(g[0]) for g in got])
    r, off, *then = (np.concatenate([g[j] for g in got]) for j in range(len(got[0])))
    del got
    by = np.lexsort((*then[::-1], r))
    r, then = r[by], [x[by] for x in then]
    at = np.arange(len(r))
    group, run = _runs(r), _runs(r, *then)
    begin = np.flatnonzero(run)
    size = np.diff(np.append(begin, len(r)))
    now = r + np.repeat(begin, size) - np.maximum.accumulate(np.where(group, at, 0))
    for to, data in _sent_back(where[by], off[by], now, np.repeat(size > 1, size), then[0]):
        yield to, 0, 0, data


def _local(d: Documents) -> DataFrame:
    """(slice, 0, 0, (ids, lengths, offset, rank)) of all suffixes, sorted in one task."""

    def sorted_(rows):
        rows.sort(key=lambda r: r[2] * 2 + r[1])  # of each slice its symbols, then its documents
        symbols = [unpack(r[3])[0] for r in rows[::2]]
        sa = suffix.sort_suffixes(np.concatenate(symbols))[0]
        rank = np.empty(len(sa), dtype=np.int64)
        rank[sa] = np.arange(len(sa))
        first = 0
        for x, r in zip(symbols, rows[1::2], strict=True):
            yield r[2], 0, 0, pack(*unpack(r[3]), np.arange(len(x)), rank[first : first + len(x)])
            first += len(x)

    return cut(gathered(each(d.rows, lambda r: [(0, r[1], r[0], r[3])]), 1, sorted_))


def suffixes(d: Documents, local: int | None = None) -> list[DataFrame]:
    """Frames of (slice, 0, 0, (ids, lengths, offset, rank)); together they have every suffix once."""
    if d.n <= (suffix.LOCAL_SYMBOLS if local is None else local):
        return [_local(d)]
    spark = d.rows.sparkSession
    parts, starts = _first_ranks(d)
    nb, h = len(starts) - 1, 2 * d.width
    about = cut(d.rows.where("tag = 1"))
    d.rows = None  # its symbols are needed no more
    tidy(spark, now=True)

    def dense(rows):
        own, length = next(unpack(r[3]) for r in rows if r[1] == 1)
        r = np.zeros(int((length + 1).sum()), dtype=np.int64)
        shared = np.zeros(len(r), dtype=bool)
        for _, tag, at, data in rows:
            if tag == 0:
                off, value = unpack(data)
                r[off] = starts[at] + (value >> 1)
                shared[off] = value & 1
        yield rows[0][0], 0, int(shared.sum()), pack(own, length, r, shared)

    ranks = about
    for p in parts:
        ranks = ranks.unionByName(p)
    ranks = cut(gathered(ranks, d.slices, dense))
    del parts, p

    def single(row):
        own, length, r, shared = unpack(row[3])
        off = np.flatnonzero(shared == 0)
        yield row[0], 0, 0, pack(own, length, off, r[off])

    done = [each(ranks, single)]
    left = ranks.agg(F.sum("at")).first()[0]

    def first(row, h=h):
        _, _, r, shared = unpack(row[3])
        off = np.flatnonzero(shared)
        yield from _by_bucket(row[0], starts, r[off], off, r[off + h])

    def merged(rows):
        own, length = next(unpack(r[3]) for r in rows if r[1] == 1)
        got = [unpack(r[3]) for r in rows if r[1] == 0]
        if got:
            off, r, shared, then = (np.concatenate([g[j] for g in got]) for j in range(4))
            by = np.argsort(off)
            yield rows[0][0], 0, int(shared.sum()), pack(own, length, off[by], r[by], shared[by], then[by])

    def settled(row):
        own, length, off, r, shared, _ = unpack(row[3])
        over = shared == 0
        if over.any():
            yield row[0], 0, 0, pack(own, length, off[over], r[over])

    sent, reach = each(ranks, first), 2
    del ranks
    while left:
        tidy(spark, now=True)
        state = cut(gathered(about.unionByName(gathered(sent, nb, _finer)), d.slices, merged))
        del sent
        done.append(cut(each(state, settled)))
        left = state.agg(F.sum("at")).first()[0]

        def further(row, before=h, step=h * reach):
            _, _, off, r, shared, then = unpack(row[3])

            def look(t):
                i = np.minimum(np.searchsorted(off, t), len(off) - 1)
                here = off[i] == t
                j = np.minimum(np.searchsorted(off, t - before), len(off) - 1)
                return np.where(here, r[i], then[j]), here & (shared[i] == 1)

            k = off[shared == 1]
            ranks, on, t = [], np.ones(len(k), dtype=bool), k.copy()
            for _ in range(REACH - 1):  # behind a unique rank nothing counts
                t[on] += step
                rank = np.full(len(k), -1, dtype=np.int64)
                rank[on], still = look(t[on])
                on[on] = still
                ranks.append(rank)
            yield from _by_bucket(row[0], starts, r[shared == 1], k, *ranks)

        h, reach, sent = h * reach, REACH, each(state, further)
        del state
    return done


def array(d: Documents, spark: SparkSession, kind: T.DataType | None = None, local: int | None = None) -> DataFrame:
    """(r, grp, pos) of the generalized suffix array; pos = length is the separator."""
    kind = kind or T.LongType()
    schema = T.StructType([T.StructField("r", T.LongType()), T.StructField("grp", kind), T.StructField("pos", T.LongType())])
    if not d.slices:
        return spark.createDataFrame([], schema)
    to = pa.from_numpy_dtype({"tinyint": "i1", "smallint": "i2", "int": "i4"}.get(kind.simpleString(), "i8"))

    def run(batches):
        for row in _rows(batches):
            own, length, off, r = unpack(row[3])
            begin = np.concatenate(([0], np.cumsum(length + 1)[:-1]))
            for a in range(0, len(off), 200_000):
                o = off[a : a + 200_000]
                i = np.searchsorted(begin, o, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(r[a : a + 200_000]), pa.array(own[i]).cast(to), pa.array(o - begin[i])], names=["r", "grp", "pos"])

    done = suffixes(d, local)
    tidy(spark, now=True)
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    return every.mapInArrow(run, schema)


def heads(d: Documents, spark: SparkSession) -> DataFrame:
    """(a, b, cnt, low, high): suffixes that begin with two words, and their first and last ranks, which have no others between."""
    schema = "a long, b long, cnt long, low long, high long"
    if not d.slices:
        return spark.createDataFrame([], schema)
    base, groups = d.base, d.groups

    def pairs(symbols):
        then = np.append(symbols[1:], 0)
        return np.where(symbols > groups, symbols, 0), np.where(symbols > groups, np.where(then > groups, then, 0), symbols)

    bounds = _bounds(d.rows, 0, pairs)  # each slice counts its pairs, so none is large
    whole = base * base < 1 << 63

    def counted(a, b, cnt):
        by = np.argsort(a * base + b, kind="stable") if whole else np.lexsort((b, a))
        a, b, cnt = a[by], b[by], cnt[by]
        begin = np.flatnonzero(_runs(a, b))
        return a[begin], b[begin], np.add.reduceat(cnt, begin)

    def own(row):
        a, b = pairs(unpack(row[3])[0])
        a, b, cnt = counted(a, b, np.ones(len(a), dtype=np.int64))
        at = _split(a, b, bounds)
        for j, (x, z) in enumerate(zip(at, at[1:], strict=False)):
            if x < z:
                yield j, 0, 0, pack(a[x:z], b[x:z], cnt[x:z])

    def together(rows):
        got = [unpack(r[3]) for r in rows]
        a, b, cnt = counted(*(np.concatenate([g[j] for g in got]) for j in range(3)))
        yield rows[0][0], 0, int(cnt.sum()), pack(a, b, cnt)

    found = cut(gathered(each(d.rows.where("tag = 0"), own), len(bounds) + 1, together))
    starts = _starts({r["to"]: r["at"] for r in found.select("to", "at").collect()}, len(bounds) + 1)  # a number a bucket

    def run(batches):
        for row in _rows(batches):
            a, b, cnt = unpack(row[3])
            low = starts[row[0]] + np.cumsum(cnt) - cnt
            for x in range(0, len(a), 200_000):
                s = slice(x, x + 200_000)
                w = b[s] > groups
                w &= a[s] > groups
                yield pa.RecordBatch.from_arrays([pa.array(v[s][w]) for v in (a - groups, b - groups, cnt, low, low + cnt - 1)], names=["a", "b", "cnt", "low", "high"])

    return found.mapInArrow(run, schema)
