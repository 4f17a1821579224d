"""Commands: build, count, bench, generate. Exit code 0, or 1 with a message."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    return SparkSession.builder.appName("seqloom").getOrCreate()


def build(a) -> int:
    from .plans import index
    from .sources.intseq import sequence_of

    began = time.time()
    made = index.build(sequence_of(_session(), a.input, a.width))
    index.save(made, a.index)
    print(index.build_report(made).first().asDict() | {"seconds": round(time.time() - began, 2)})
    return 0


def count(a) -> int:
    from .plans import index
    from .sources.intseq import read_patterns

    spark = _session()
    loaded, words = index.load(spark, a.index)
    began = time.time()
    for r in index.count_values(loaded, words, read_patterns(spark, a.patterns)).orderBy("pid").toLocalIterator():
        print(r["n_occ"])
    print(f"{time.time() - began:.2f} s", file=sys.stderr)
    return 0


def bench(a) -> int:
    from .operators import ngram, search
    from .plans import index
    from .sources.intseq import sequence_of

    s = sequence_of(_session(), a.input, a.width)
    made, plain = index.build(s), index.build_plain(s)
    index.bench_report(made, plain).show(truncate=False)
    index.size_report(made, plain).show(truncate=False)
    wrong = 0
    for m in a.lengths:
        if m > s.n:
            continue
        patterns = ngram.sample_patterns(s, m, a.queries).cache()
        patterns.count()
        for name, x in (("order1", made.index), ("plain", plain[0])):
            began = time.time()
            search.count(x, patterns).agg({"n_occ": "sum"}).collect()
            print(f"m={m} {name}: {(time.time() - began) / a.queries * 1e6:.2f} microseconds a query")
        check = index.perturbed(ngram.sample_patterns(s, m, 30), s.sigma)
        wrong += index.disagreements(made, plain[0], check).count()
    print("brute-force check:", "FAILED" if wrong else "ok")
    return int(wrong > 0)


def generate(a) -> int:
    from .sources.intseq import save_ints
    from .sources.synthetic import generate as make

    print(save_ints(make(_session(), a.sigma, a.base_len, a.copies, a.mutation), a.output), "values")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="seqloom")
    sub = p.add_subparsers(required=True)
    c = sub.add_parser("build")
    c.add_argument("input"), c.add_argument("index"), c.add_argument("width", type=int, nargs="?", default=4)
    c.set_defaults(run=build)
    c = sub.add_parser("count")
    c.add_argument("index"), c.add_argument("patterns")
    c.set_defaults(run=count)
    c = sub.add_parser("bench")
    c.add_argument("input"), c.add_argument("width", type=int, nargs="?", default=4), c.add_argument("queries", type=int, nargs="?", default=100_000)
    c.add_argument("lengths", type=int, nargs="*", default=[1, 2, 4, 8, 16, 32, 64])
    c.set_defaults(run=bench)
    c = sub.add_parser("generate")
    c.add_argument("output"), c.add_argument("sigma", type=int), c.add_argument("base_len", type=int), c.add_argument("copies", type=int), c.add_argument("mutation", type=float)
    c.set_defaults(run=generate)
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    try:
        return a.run(a)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
