"""Byte-level BPE by merge replay.

A task turns its slice of the corpus into distinct pre-tokens ("words"), lays their bytes out in one
array and builds an inverted index from the rank of a token pair to the positions where that pair
stands. The merges are then replayed in rank order over all words at once: each takes its positions
from the index, joins the two tokens there, and looks up only the two pairs that the join has
changed. Documents are put together from the token runs of their words.

Replaying all places of a rank at once is the rule of single merges as long as no merge opens a pair
of lower rank. Words where one does are told by two tests (of the pairs that stand after a step, and of
those that stood for a moment between neighbouring merges of one step) and follow the rule one merge at
a time, from a heap.

No shuffle is needed: a slice never looks outside its task. A task holds one Arrow batch, the working
arrays of ``CHUNK_BYTES`` of text (of the longest text, if that is longer: about 40 bytes for each byte of
its words that are no tokens) and ``CACHE_WORDS`` remembered words, whatever the size of the partition.

Edge cases: null text counts as empty and gives no ids; one very long text is one chunk; repeated
rows are encoded alike; input columns named like an output column are replaced by it.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, sliced, table

#: Bytes of text that are encoded, and decoded again, at once.
CHUNK_BYTES = 2_000_000
CACHE_WORDS = 150_000
_SHIFT = 20


class Vocabulary:
    """Ranks of a tiktoken file as arrays."""

    def __init__(self, data: bytes):
        self.encoder = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
        self.decoder = {r: t for t, r in self.encoder.items()}
        if max(self.decoder) >= 1 << _SHIFT:
            raise ValueError("ranks must be below 2**20")
        self.byte_ids = np.array([self.encoder[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, ranks, get = [], [], self.encoder.get
        for whole, rank in self.encoder.items():
            for cut in range(1, len(whole)):
                a = get(whole[:cut])
                if a is not None and (b := get(whole[cut:])) is not None:
                    keys.append(a << _SHIFT | b)
                    ranks.append(rank)
        order = np.argsort(keys) if keys else np.zeros(0, dtype=np.int64)
        self.keys, self.ranks = np.array([*keys, -1], dtype=np.int64)[[*order, len(keys)]], np.array([*ranks, -1], dtype=np.int64)[[*order, len(keys)]]
        self.keys[-1] = np.iinfo(np.int64).max  # a guard beyond every key

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, -1 where they don't merge."""
        key = a.astype(np.int64) << _SHIFT | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def one_by_one(self, word: bytes) -> list[int]:
        """The rule itself on one word: always the lowest rank, leftmost first; a heap holds the pairs."""
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        nxt, prev, get = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1)), self.encoder.get
        heap = [(r, i) for i in range(len(word) - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if parts[i] is None or (j := nxt[i]) == len(word) or get(whole := parts[i] + parts[j]) != r:
                continue  # one of the two has changed
            parts[i], parts[j], nxt[i] = whole, None, nxt[j]
            if nxt[i] < len(word):
                prev[nxt[i]] = i
            for a, b in ((prev[i], i), (i, nxt[i])):
                if a >= 0 and b < len(word) and (r := get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [self.encoder[x] for x in parts if x is not None]


@lru_cache(maxsize=4)
def _vocabulary(data: bytes) -> Vocabulary:
    return Vocabulary(data)


@lru_cache(maxsize=8)
def _splitter(pattern: str):
    """findall of the pattern.

    Texts without characters beyond Latin Extended-B or rare controls take the standard library's
    engine, with ``\\p{L}`` and ``\\p{N}`` spelled out for that range; it is twice as fast there.
    """
    import regex

    full = regex.compile(pattern).findall

    def spelled(kind: str) -> str:
        return "".join(re.escape(c) for c in map(chr, range(0x250)) if regex.match(kind, c))

    narrow = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\p{L}", spelled(r"\p{L}")).replace(r"\p{N}", spelled(r"\p{N}")), pattern)
    for kind in (r"\p{L}", r"\p{N}"):
        narrow = narrow.replace(kind, f"[{spelled(kind)}]")
    if "\\p" in narrow:
        return full
    fast, beyond = re.compile(narrow).findall, re.compile("[^\t-\r -~\x85\xa0-\u024f]").search
    return lambda text: full(text) if beyond(text) else fast(text)


def replay(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after the other, and how many each has. Words are not empty."""
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = int(ends[-1])
    place = np.int32 if n < 1 << 31 else np.int64
    tok = vocab.byte_ids.astype(np.int32)[np.frombuffer(b"".join(words), dtype=np.uint8)]
    nxt, prev = np.arange(1, n + 1, dtype=place), np.arange(-1, n - 1, dtype=place)
    nxt[ends - 1], prev[starts] = -1, -1
    standing = np.full(n, -1, dtype=np.int32)  # rank of the pair that starts here
    alive = np.ones(n, dtype=bool)
    for a in range(0, n - 1, 1 << 18):
        standing[a : a + (1 << 18)][: n - 1 - a] = vocab.pair_ranks(tok[a : min(n - 1, a + (1 << 18))], tok[a + 1 : a + 1 + (1 << 18)])
    standing[ends - 1] = -1

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        bounds = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        firsts = ranks[bounds[:-1]].tolist()
        for rank, a, b in zip(firsts, bounds, bounds[1:]):
            if rank in index:
                index[rank].append(positions[a:b])
            else:
                index[rank] = [positions[a:b]]
                heapq.heappush(heap, rank)

    if (begin := np.flatnonzero(standing >= 0).astype(place)).size:
        enter(begin, standing[begin])
    del begin
    odd: list[np.ndarray] = []
    while heap:
        rank = heapq.heappop(heap)
        lists = index.pop(rank)
        p = np.unique(np.concatenate(lists))
        p = p[standing[p] == rank]
        if not p.size:
            continue
        q = nxt[p]
        chained = q[:-1] == p[1:]
        if chained.any():  # a a a: every second of a chain, from its left end
            at = np.arange(len(p))
            head = np.maximum.accumulate(np.where(np.concatenate(([False], chained)), 0, at))
            take = (at - head) % 2 == 0
            p, q = p[take], q[take]
        s = nxt[q]
        if (next_to := s[:-1] == p[1:]).any():  # after the left merge, before the right one, these two stood side by side
            between = p[:-1][next_to]
            first = tok[p[1:][next_to]]
            opened = vocab.pair_ranks(np.full(len(first), rank, dtype=np.int32), first)
            if (hidden := (opened >= 0) & (opened < rank)).any():
                odd.append(between[hidden])
        tok[p], nxt[p], alive[q], standing[q], standing[p] = rank, s, False, -1, -1
        has = s >= 0
        right, after = p[has], s[has]
        prev[after] = right
        before = prev[p]
        before = before[before >= 0]
        touched = np.concatenate((right, before))
        if not touched.size:
            continue
        now = vocab.pair_ranks(tok[touched], tok[nxt[touched]])
        standing[touched] = now
        if (now >= 0).any():
            touched, now = touched[now >= 0], now[now >= 0]
            if now.min() < rank:
                odd.append(touched[now < rank])
            enter(touched, now)
    counts = np.add.reduceat(alive, starts, dtype=np.int64)
    ids = tok[alive]
    if odd:  # a pair of lower rank appeared late: such words follow the rule one merge at a time
        again = np.unique(np.searchsorted(ends, np.concatenate(odd), side="right"))
        runs = np.split(ids, np.cumsum(counts)[:-1])
        for w in again.tolist():
            runs[w] = np.array(vocab.one_by_one(words[w]), dtype=np.int64)
            counts[w] = len(runs[w])
        ids = np.concatenate(runs)
    return ids, counts


class Encoder:
    """Texts to ids; remembers the runs of words it has met."""

    def __init__(self, vocab: Vocabulary, pattern: str):
        self.vocab, self.findall = vocab, _splitter(pattern)
        self.forget()

    def forget(self) -> None:
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.ids, self.counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        seen, place = len(self.known), self.known.__getitem__
        rows = [np.fromiter(map(place, w), dtype=np.int64, count=len(w)) for w in (self.findall(x or "") for x in texts)]
        fresh = [w.encode() for w in list(self.known)[seen:]]
        whole = [self.vocab.encoder.get(w) for w in fresh]  # a word that is a token is not split
        runs, sizes = replay(self.vocab, [w for w, r in zip(fresh, whole) if r is None])
        counts = np.ones(len(fresh), dtype=np.int64)
        merged = np.fromiter((r is None for r in whole), dtype=bool, count=len(fresh))
        counts[merged] = sizes
        ids = np.zeros(int(counts.sum()), dtype=np.uint32)
        inside = np.repeat(merged, counts)
        ids[inside], ids[~inside] = runs, [r for r in whole if r is not None]
        self.ids, self.counts = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts))
        firsts = np.cumsum(self.counts) - self.counts
        out = []
        for row in rows:
            size = self.counts[row]
            shift = np.repeat(firsts[row] - (np.cumsum(size) - size), size)
            out.append(self.ids[shift + np.arange(len(shift))].astype("<u4").tobytes())
        return out


def _appended(df: DataFrame, **kinds: T.DataType) -> tuple[DataFrame, T.StructType]:
    df = df.drop(*kinds)
    return df, T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in kinds.items())])


def _broadcast(df: DataFrame, ranks_path: str):
    """The rank file, read on the driver; a vocabulary does not grow with the data."""
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _joined(vocab: Vocabulary, packed: list[bytes | None]) -> pa.Array:
    """The bytes that packed ids stand for."""
    token = vocab.decoder.__getitem__
    return pa.array([None if x is None else b"".join(map(token, np.frombuffer(x, dtype="<u4").tolist())) for x in packed], pa.binary())


def encode(df: DataFrame, ranks_path: str, pattern: str, column: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add ``out``: the ids of the whole text as little-endian unsigned 32-bit integers in a binary.

    ``decoded`` names a further column with the bytes that those ids decode to, made in the same pass.
    """
    ranks = _broadcast(df, ranks_path)
    df, schema = _appended(df, **{out: T.BinaryType()}, **({decoded: T.BinaryType()} if decoded else {}))

    def run(batches):
        vocab = _vocabulary(ranks.value)
        encoder = Encoder(vocab, pattern)
        for part in sliced(batches, column, CHUNK_BYTES):
            ids = encoder(part.column(column).to_pylist())
            more = [pa.array(ids, pa.binary()), *([_joined(vocab, ids)] if decoded else [])]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=schema.names)

    return df.mapInArrow(released(run), schema)


def decode(df: DataFrame, ranks_path: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that the packed ids stand for (null ids: null)."""
    ranks = _broadcast(df, ranks_path)
    df, schema = _appended(df, **{out: T.BinaryType()})

    def run(batches):
        vocab = _vocabulary(ranks.value)
        for part in sliced(batches, column, CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([*part.columns, _joined(vocab, part.column(column).to_pylist())], names=schema.names)

    return df.mapInArrow(released(run), schema)


def ids_array(df: DataFrame, column: str = "ids", out: str = "ids_array") -> DataFrame:
    """Unpack ids into an array<int> for readers that want one."""
    at = F.sequence(F.lit(0), (F.length(column) / 4).cast("int") - 1)
    byte = lambda i, k: F.conv(F.hex(F.substring(F.col(column), i * 4 + k + 1, F.lit(1))), 16, 10).cast("int")
    value = lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536 + byte(i, 3) * 16777216
    return df.withColumn(out, F.when(F.length(column) > 0, F.transform(at, value)).otherwise(F.array().cast("array<int>")))


def digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``df`` (doc_id, text)."""
    both = encode(df.select("doc_id", "text"), ranks_path, pattern, decoded="decoded")
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
