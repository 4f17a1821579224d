"""Modelled sizes, in bytes, of the physical forms an index can take, and Huffman costs."""

from __future__ import annotations

import heapq
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def elias_fano(n: int, universe: int) -> int:
    """Bytes of n non-decreasing numbers below the universe, with samples of one in 256."""
    low = (universe // n).bit_length() - 1 if n > 0 and universe // n > 1 else 0
    high = n + (universe >> low) + 2
    return 8 * ((n * low + 63) // 64 + 1 + high // 64 + 2 + ceil(n / 256) + ceil((high - n) / 256)) + 40


def run_rank(n: int, runs: int, symbols: int, runs_by_symbol: list[tuple[int, int]]) -> int:
    """Explicit run lists with jump tables; runs_by_symbol: (runs, how many symbols have so many)."""
    jump = 0
    for r, how_many in runs_by_symbol:
        if r >= 64:
            shift = 0
            while (n >> shift) > r // 8:
                shift += 1
            jump += how_many * ((n >> shift) + 2)
    return 16 * (symbols + 1) + 8 * (runs + symbols) + symbols + 4 * jump


def ef_rank(n: int, runs: int, symbols: int) -> int:
    return elias_fano(runs, symbols * n) + elias_fano(runs, n)


def huffman_tree(cost: int, symbols: int, distinct: int) -> int:
    """A wavelet tree shaped by a Huffman code; cost: the code bits of the whole sequence."""
    inner = max(distinct - 1, 0)
    return 72 * (cost // 512 + 1) + 9 * symbols + 8 * inner + 16 * (inner + 1)


def run_huffman(head_cost: int, n: int, runs: int, symbols: int, distinct: int) -> int:
    return huffman_tree(head_cost, symbols, distinct) + elias_fano(runs, n) + elias_fano(runs + 1, n + 1) + 4 * (symbols + 1)


def rankings(sigma: int, bigrams: int, kinds: int) -> int:
    return 8 * sigma + 8 * (sigma + 2) + 8 * bigrams + 8 * (kinds + 1)


def megabytes(size: int) -> str:
    return f"{size / 1048576:.2f} MB"


def huffman_cost(frequencies: list[tuple[int, int]]) -> int:
    """Code bits of a sequence: sum of frequency times code length, the same for every Huffman code.

    ``frequencies``: (frequency, how many symbols have it). Equal weights merge in bulk, so the work and
    memory follow the number of different frequencies, at most about the square root of twice the length.
    """
    many: dict[int, int] = {}
    for f, c in frequencies:
        many[f] = many.get(f, 0) + c
    heap, cost = list(many), 0
    heapq.heapify(heap)

    def put(weight: int, count: int) -> None:
        if weight in many:
            many[weight] += count
        else:
            many[weight] = count
            heapq.heappush(heap, weight)

    while heap:
        f = heapq.heappop(heap)
        c = many.pop(f)
        if c > 1:
            cost += 2 * f * (c // 2)
            put(2 * f, c // 2)
        if c % 2 and heap:
            other = heap[0]
            many[other] -= 1
            if not many[other]:
                heapq.heappop(heap)
                del many[other]
            cost += f + other
            put(f + other, 1)
    return cost


def huffman_lengths(counts: list[tuple[int, int]]) -> dict[int, int]:
    """Code length of each symbol for (symbol, frequency); a lone symbol has length 0."""
    heap = [(f, i, [s]) for i, (s, f) in enumerate(sorted(counts))]
    heapq.heapify(heap)
    lengths, serial = {s: 0 for s, _ in counts}, len(heap)
    while len(heap) > 1:
        (f, _, a), (g, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in (merged := a + b):
            lengths[s] += 1
        heapq.heappush(heap, (f + g, serial, merged))
        serial += 1
    return lengths


def frequencies(df: DataFrame, column: str) -> list[tuple[int, int]]:
    """(frequency, how many symbols have it) of a column, aggregated in Spark."""
    counts = df.groupBy(column).agg(F.count("*").alias("f")).groupBy("f").agg(F.count("*").alias("c"))
    return [(r["f"], r["c"]) for r in counts.collect()]
