"""Near duplicates by word shingles: SimHash and its index, and links up to a similarity that SimHash leaves.

A text is the set of its shingles' 64-bit hashes, and texts of equal sets collapse first. The SimHash of a
set goes through the index of ``simhash`` (byte positions, tally of shared bytes with its guaranteed minimum,
at most ``BITS`` differing bits), and what that links is verified exactly, on the sets themselves.

Most texts whose five-word shingles have a Jaccard similarity of 0.8 or more differ in 4 to 11 of the 64 bits,
where no number of bytes is sure to be shared; the links still missing between joined sets need another
fingerprint in the same kind of index, and only lists that SimHash has left apart are looked at. That
fingerprint of a set has a byte for each of ``POSITIONS * MINIMA`` hash functions, of the set's
minimum under it; two sets agree in a byte with a chance of their similarity. The index posts under
``POSITIONS`` groups of ``MINIMA`` positions each. The shared positional bytes of a pair that meets are
tallied, pairs below the minimum (79 of 128 for 0.8) are dropped, and the others verified on the sets
themselves, exactly. A pair of similarity 0.8 meets nowhere with a chance of 5e-8 and falls below the
minimum with one of 3e-7, more similar pairs far less often: the only ways to miss a link.

Groups of copies cost their size. First every set of a posting list that is not joined yet meets only the list's most central one,
whose entries are shared by most sets: of copies of one text, that text or the copy closest to it. Then
lists of which not all sets are joined yet are taken again: every pair in one of at most ``SHORT_LIST``,
further central sets in a longer one. At last the long lists that are still not joined are dealt to tasks
with their sets; a task tallies the pairs that are apart, in blocks, verifies those that reach the minimum
(each in the first list that it shares) and lets go of nothing but links. A list beyond ``LONG_LIST`` is
posted once more under pairs of groups for that (a pair of similarity 0.8 shares two with a chance of
1 - 1e-6). No link between sets that aren't joined already is passed over.

Edge cases: null or wordless text is the empty set, equal to others like it; texts shorter than a shingle
are one shingle; null ids come after all others; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.sequence import bounded
from .common import cut, released, sliced, text_of
from .simhash import _LOWER, _signed, components, majority
from .simhash import links as simhash_links

WIDTH = 5
LEAST = 0.8
#: Bits of their SimHashes that sets linked by it differ in at most.
BITS = 3
POSITIONS = 32
MINIMA = 4
SHORT_LIST = 32
LONG_LIST = 10_000
#: Central sets that the others of a long list meet: one first, the others in the second round.
CENTRES = 3
_DRAW = np.random.default_rng(42)
_SEEDS = _DRAW.integers(0, 1 << 64, size=(POSITIONS * MINIMA, 1), dtype=np.uint64)
_ODD = _DRAW.integers(0, 1 << 64, size=(POSITIONS * MINIMA, 1), dtype=np.uint64) | np.uint64(1)


def digest(column: str = "text") -> Column:
    """128 bits that stand for a text, byte by byte; null reads as empty."""
    return F.unhex(F.md5(text_of(column).cast("binary")))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles (A-Z lowered, split at ASCII white space)."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    pairs = zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    return np.unique(np.fromiter((hashed(joined[s:e]) for s, e in pairs), dtype=np.uint64, count=n))


def fingerprint(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Of a set: for each group of positions a hash of the group and its minima, and a byte of each minimum."""
    import xxhash

    least = np.full(POSITIONS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), 1024):
        np.minimum(least, ((found[a : a + 1024] ^ _SEEDS) * _ODD).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(POSITIONS, MINIMA))]
    return np.array(keys, np.uint64).view(np.int64), (least & np.uint64(255)).astype(np.uint8).tobytes()


def fewest(least: float) -> int:
    """Bytes that sets of that similarity share, less five standard deviations."""
    n = POSITIONS * MINIMA
    return int(n * least - 5 * (n * least * (1 - least)) ** 0.5)


def _millionths(least: float) -> int:
    return round(least * 1_000_000)


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    if len(a) > len(b):
        a, b = b, a
    both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)) if len(a) else 0
    return both * 1_000_000 >= _millionths(least) * (len(a) + len(b) - both)


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, node, fp, n, entries, marks) of (doc_id, digest, text): node stands for the set, n is its size."""

    def run(batches):
        import xxhash

        for b in sliced(batches, 2):
            sets = [shingles(t) for t in b.column(2).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            fps = [_signed(majority([x])) for x in sets]
            found = [fingerprint(x) for x in sets]
            flat = np.concatenate([x for x, _ in found]) if sets else np.zeros(0, np.int64)
            ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * POSITIONS)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(node), pa.array(fps, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array([x for _, x in found], pa.binary())], names=["doc_id", "digest", "node", "fp", "n", "entries", "marks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "digest", "text").mapInArrow(released(run), f"doc_id {kind}, digest binary, node long, fp long, n long, entries array<long>, marks binary")


def _marks(column: pa.Array) -> np.ndarray:
    """A row of positional bytes for each value."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), POSITIONS * MINIMA)


def _own(used: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, own): the sets of some nodes; only the texts of these travel."""

    def hashed(batches):
        for b in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["node", "own"])

    used = cut(used.distinct().join(nodes.select("node", "digest"), "node"))
    texts = docs.select("digest", "text").join(bounded(used, used.count()), "digest").groupBy("node").agg(F.min("text").alias("text"))
    return cut(texts.mapInArrow(released(hashed), "node long, own binary"))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def alike(batches):
        for b in batches:
            one, other = (_marks(b.column(i)) for i in (2, 3))
            yield b.select([0, 1]).filter(pa.array(np.count_nonzero(one == other, axis=1) >= enough))

    def compare(batches):
        for b in sliced(sliced(batches, 2), 3):
            sets = ([np.frombuffer(x, np.uint64) for x in b.column(i).to_pylist()] for i in (2, 3))
            yield b.select([0, 1]).filter(pa.array([similar(x, y, least) for x, y in zip(*sets)], pa.bool_()))

    enough = fewest(least)
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("marks").alias(f"m_{x}"))
    sized = F.least("n_a", "n_b") * 1_000_000 >= F.greatest("n_a", "n_b") * _millionths(least)
    near = cut(pairs.join(of("a"), "a").join(of("b"), "b").where(sized).select("a", "b", "m_a", "m_b").mapInArrow(alike, "a long, b long"))
    sets = _own(near.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs)
    full = near.join(sets.toDF("b", "own_b"), "b").join(sets.toDF("a", "own_a"), "a").select("a", "b", "own_a", "own_b")
    return cut(full.mapInArrow(released(compare), "a long, b long"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _torn(lists: DataFrame) -> DataFrame:
    """The rows of lists (key, node, root, ...) that hold more than one root."""
    keys = lists.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return lists.join(keys, "key")


def _across(lists: DataFrame) -> DataFrame:
    """Pairs (x, y) of each list's nodes with different roots."""
    one, other = (lists.select("key", F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "xy")
    return one.join(other, "key").where("x < y and root_x <> root_y").select("x", "y")


def _apart(lists: DataFrame, nodes: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """(a, b): links between the nodes of each list (key, node, root) that have different roots."""
    enough, ratio = fewest(least), _millionths(least)

    def linked(key, node, root, n, entries, marks, sets):
        group = np.flatnonzero(entries[0] == key)  # none if the key stands for two groups
        step = max(1, 4_000_000 // len(node))
        for a in range(0, len(node), step):
            i, j = np.nonzero(root[a : a + step, None] != root[None, a + 1 :])
            i, j = (a + i)[j >= i], (a + 1 + j)[j >= i]
            for c in range(0, len(i), 50_000):
                x, y = i[c : c + 50_000], j[c : c + 50_000]
                ok = np.minimum(n[x], n[y]) * 1_000_000 >= np.maximum(n[x], n[y]) * ratio
                x, y = x[ok], y[ok]
                ok = np.count_nonzero(marks[x] == marks[y], axis=1) >= enough
                x, y = x[ok], y[ok]
                if len(group):  # a pair is looked at in the first list that it shares
                    ok = np.argmax(entries[x] == entries[y], axis=1) == group[0]
                    x, y = x[ok], y[ok]
                good = np.array([similar(sets[p], sets[q], least) for p, q in zip(x.tolist(), y.tolist())], dtype=bool)
                if good.any():
                    x, y = node[x[good]], node[y[good]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches):
        last, held = None, []

        def whole():
            columns = [np.concatenate(x) for x in list(zip(*held))[:5]]
            yield from linked(last, *columns, [z for x in held for z in x[5]])

        for b in batches:
            key = b.column(0).to_numpy()
            if not len(key):
                continue
            columns = [*(b.column(i).to_numpy() for i in (1, 2, 3)), b.column(4).flatten().to_numpy().reshape(-1, POSITIONS), _marks(b.column(5)), [np.frombuffer(x, np.uint64) for x in b.column(6).to_pylist()]]
            ends = [*(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for s, e in zip([0, *ends], ends):
                if key[s] != last and held:
                    yield from whole()
                    held = []
                last = key[s]
                held.append([x[s:e] for x in columns])
        if held:
            yield from whole()

    lists = cut(lists)
    rows = lists.join(nodes.select("node", "n", "entries", "marks"), "node").join(_own(lists.select("node"), nodes, docs), "node")
    dealt = rows.select("key", "node", "root", "n", "entries", "marks", "own").repartition("key").sortWithinPartitions("key")
    return cut(dealt.mapInArrow(released(run), "a long, b long"))


def close(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): sets that SimHash links, by its index of byte positions; of sets of one fingerprint, each with the smallest."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    near = simhash_links(first.select("fp"), bits).toDF("a", "b")
    across = near.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select("x", "y")
    return cut(_ordered(across.unionByName(nodes.join(first, "fp").select(F.col("node").alias("x"), F.col("first").alias("y")))))


def links(nodes: DataFrame, docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b): enough links between similar sets to join every component."""
    tried = close(nodes)
    found = _verified(tried, nodes, docs, least)

    def rooted(rows):
        return rows.join(cut(components(found)), "node", "left").withColumn("root", F.coalesce("root", "node"))

    def fresh(pairs):
        return cut(_ordered(pairs).join(tried, ["a", "b"], "left_anti"))

    post = nodes.select("node", F.explode("entries").alias("key"))
    lists = post.join(post.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key")
    lists = cut(_torn(cut(rooted(lists))).drop("root"))
    central = lists.groupBy("node").agg(F.struct(F.sum("size"), "node").alias("central"))
    lists = cut(lists.join(central, "node"))
    more = fresh(lists.join(lists.groupBy("key").agg(F.max("central")["node"].alias("y")), "key").select(F.col("node").alias("x"), "y"))
    tried, found = tried.unionByName(more), cut(found.unionByName(_verified(more, nodes, docs, least)))
    open_ = cut(_torn(rooted(lists)))
    long_ = open_.where(F.col("size") > SHORT_LIST)
    first = Window.partitionBy("key").orderBy(F.desc("central"))
    others = long_.select("key", F.col("node").alias("y"), F.row_number().over(first).alias("at")).where(F.col("at").between(2, CENTRES)).select("key", "y")
    more = fresh(_across(open_.where(F.col("size") <= SHORT_LIST)).unionByName(long_.join(others, "key").select(F.col("node").alias("x"), "y")))
    if more.isEmpty():
        return found
    tried, found = tried.unionByName(more), found.unionByName(_verified(more, nodes, docs, least))
    left = cut(_torn(rooted(long_.select("key", "node", "size"))))
    if left.isEmpty():
        return found
    beyond = left.where(F.col("size") > LONG_LIST).select("node").distinct()
    dealt = left.where(F.col("size") <= LONG_LIST).select("key", "node", "root")
    if not beyond.isEmpty():
        # a lambda for each pair of groups keeps the generated code small
        two = F.flatten(F.transform("entries", lambda x, i: F.transform(F.slice("entries", i + 2, F.lit(POSITIONS)), lambda y: F.xxhash64(x, y))))
        dealt = dealt.unionByName(_torn(rooted(nodes.join(beyond, "node").select("node", F.explode(two).alias("key")))).select("key", "node", "root"))
    return found.unionByName(_apart(dealt, nodes, docs, least))


def near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, digest, stays), one row for each row of docs (doc_id, digest, text).

    Of each component the rows of the smallest id stay, nulls last; among texts of that id one digest.
    """
    sets = cut(_sets(docs))
    nodes = cut(sets.select("node", "fp", "n", "digest", "entries", "marks").dropDuplicates(["node"]))
    roots = cut(components(links(nodes, docs, least)))
    rows = sets.select("doc_id", "digest", "node").join(roots, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("root"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    best = rows.groupBy("root").agg(F.min(own).alias("best"))
    return cut(rows.join(best, "root").select("doc_id", "digest", own.eqNullSafe(F.col("best")).alias("stays")))
