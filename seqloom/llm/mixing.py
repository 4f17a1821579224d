"""Mixing to target weights with soft membership, in DataFrame operations only.

A classifier fitted on a table of labelled rows gives every document a posterior over domains: words
that speak for a domain are counted and set against the text's length, and the pattern of these levels is
looked up among the labelled rows' patterns, so posteriors are shares that really occurred, drawn towards
(and for patterns never met taken from) a naive Bayes over the levels. Document rates r >= 0 are then fitted so that the expected tokens of each
domain, sum_i r_i n_i p_id, meet the domain's target. The fit is projected gradient descent on the
squared residuals, each relative to the tokens its domain has:

    r_i <- max(0, r_i - sum_d p_id (sum_j r_j n_j p_jd - T_d) / E_d),   r = 1 at the start.

In that scaling no eigenvalue of the problem exceeds one, so the unit step always descends; all that
leaves the executors in a step is one residual for each domain. Rows of equal posteriors share their rate
at every step, so a step costs as much as there are distinct posteriors. Rates are cut to the shared folder
every ``CUT_EVERY`` steps so that expressions stay short.

The classifier sees at most ``most_labelled`` labelled rows (those of smallest hash) and keeps at
most ``most_features`` words; every document is scored on its whole text, and totals and rates run
over all documents. Nothing is keyed by source or domain in a shuffle, so hot ones cost nothing.

Edge cases: null or empty text has no tokens, its posterior is that of rows without hits; labelled rows with a null
or unknown domain are left out; without labelled rows the posterior is even; an empty table gives an
empty result; a repeated id is scored once for each row; null ids are documents like others, all rounded alike; clashing
extra columns are not read. Targets that nonnegative rates can't meet are missed by least squares and said.
"""

from __future__ import annotations

import logging
from functools import reduce
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sequence import bounded
from .common import cut, table, text_of

_LOG = logging.getLogger(__name__)

MOST_LABELLED = 10_000
MOST_FEATURES = 400
#: A word becomes a feature if it speaks for a domain with this log likelihood ratio (G)
LEAST_G = 30.0
#: and at least these log odds.
LEAST_ODDS = 1.5
CUT_EVERY = 8
MOST_STEPS = 80
#: Steps of plain descent; later ones are scaled by curvature.
PLAIN_STEPS = 48
TOLERANCE = 1e-4
MOST_EPOCHS = 2.0

#: Domains of the label table and the weights the mix is to have.
TARGETS = {"clean": 0.90, "low": 0.06, "toxic": 0.04}


#: Characters of a word that count; related forms then share their features.
STEM = 5
#: Levels of a domain's hits: none; one, sparse or dense; more, by half octaves of their share of the words.
LEVELS = 16
#: Half octaves below one at which the lowest and the densest level of many hits lie.
SPARSE, DENSE = 18, 6
#: Rows' worth of naive Bayes in the posterior of a pattern.
SHRINK = 2.0


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    """keep..., words: lower-case words, split at white space and commas or points."""
    return docs.select(*keep, F.split(F.lower(text_of()), r"[\s.,;:?\"()]+").alias("words"))


def signature(text: Column) -> Column:
    """Smallest hash of the text's three-word shingles, which near copies mostly share."""
    words = F.split(F.coalesce(text, F.lit("")), r"\s+")
    shingle = lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.transform(F.array(words), lambda w: F.array_min(shingle(w)))[0]


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the label table: low quality first, then toxic, else clean."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), "clean")
    return labels.select("doc_id", domain.alias("domain"))


def level(hits: Column, n_tokens: Column) -> Column:
    """The level of so many hits in so many words, from 0 to LEVELS - 1."""
    share = hits / F.greatest(n_tokens, F.lit(1))
    octave = F.floor(2 * F.log2(share)) + SPARSE
    many = F.greatest(F.lit(0), F.least(octave, F.lit(SPARSE - DENSE))) + 3
    return F.when(hits == 0, 0).when(hits == 1, F.when(share < 1 / 32, 1).otherwise(2)).otherwise(many).cast("int")


def hits(docs: DataFrame, features: dict[str, int], n_domains: int, *keep: str) -> DataFrame:
    """keep..., n_tokens, h0...: the level of a row's words that are features of each domain.

    Words meet the broadcast features (MOST_FEATURES at most), so what is left of a document before
    anything is shuffled is a few counts. An empty word carries documents without features.
    """
    table_ = F.inline(F.array(*(F.struct(F.lit(w).alias("stem"), F.lit(i).alias("speaks")) for w, i in {"": -1, **features}.items())))
    features_ = docs.sparkSession.range(1).select(table_)
    empty = lambda at: (F.element_at("words", at) == "").cast("int")  # noqa: E731  only the first and the last word can be empty
    n = F.greatest(F.lit(0), F.size("words") - empty(1) - empty(-1)).cast("long")
    rows = _words(docs.withColumn("row", F.monotonically_increasing_id()), "row", *keep)
    words = rows.select("row", *keep, n.alias("n_tokens"), F.explode(F.array_append("words", F.lit(""))).alias("word"))
    met = words.withColumn("stem", F.substring("word", 1, STEM)).join(F.broadcast(features_), "stem")
    return met.groupBy("row", *keep, "n_tokens").agg(*(level(F.count_if(F.col("speaks") == i), F.col("n_tokens")).alias(f"h{i}") for i in range(n_domains))).drop("row")


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], most_labelled: int = MOST_LABELLED, most_features: int = MOST_FEATURES) -> tuple[dict[str, int], dict[tuple[int, ...], list[float]], list[list[list[float]]]]:
    """Feature words with the domain they speak for, posteriors by pattern of levels, and the naive Bayes.

    The last holds, for each domain's hits and each domain, the log of the share of its rows at each
    level; the first of them contains the prior.
    """
    chosen = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("domain", "text")  # at most most_labelled ids
    rows = cut(rows.withColumn("signature", signature(F.col("text"))).dropDuplicates(["signature", "domain"]).select("domain", "text"))  # copies are no new evidence
    stems = F.array_distinct(F.transform("words", lambda w: F.substring(w, 1, STEM)))
    found = _words(rows, "domain").select("domain", F.explode(F.array_append(stems, F.lit(None).cast("string"))).alias("stem"))  # null counts rows
    counts = cut(found.groupBy("stem").agg(*(F.count_if(F.col("domain") == d).alias(f"c{i}") for i, d in enumerate(domains))))
    sizes = counts.where("stem is null").first()
    n = [float(sizes[f"c{i}"]) if sizes else 0.0 for i in range(len(domains))]
    total = sum(n)
    prior = [(x + 1) / (total + len(domains)) for x in n]
    c = [F.col(f"c{i}") for i in range(len(domains))]
    here = reduce(lambda a, b: a + b, c)

    def g(i: int) -> Column:
        share = here / F.lit(max(total, 1.0))
        part = lambda seen, of: F.when(seen > 0, seen * F.log(seen / (share * of))).otherwise(0.0) + F.when(seen < of, (of - seen) * F.log((of - seen) / ((1 - share) * of))).otherwise(0.0)
        own, rest = F.lit(n[i]), F.lit(total - n[i])
        odds = F.log((c[i] + 0.5) / (own - c[i] + 0.5)) - F.log((here - c[i] + 0.5) / (rest - here + c[i] + 0.5))
        return F.when(odds >= LEAST_ODDS, 2 * (part(c[i], own) + part(here - c[i], rest))).otherwise(0.0)

    speaks = F.array_max(F.array(*(F.struct(g(i).alias("g"), F.lit(i).alias("domain")) for i in range(len(domains)))))
    top = counts.where("stem is not null and stem <> ''").select("stem", speaks.alias("x")).where(F.col("x.g") >= LEAST_G).orderBy(F.desc("x.g"), "stem").limit(most_features).collect()
    features = {r["stem"]: r["x"]["domain"] for r in top}
    keys = [f"h{i}" for i in range(len(domains))]
    cells = hits(rows, features, len(domains), "domain").groupBy(*keys).agg(*(F.count_if(F.col("domain") == d).alias(f"c{i}") for i, d in enumerate(domains))).collect()  # LEVELS ** domains at most
    at = {tuple(r[k] for k in keys): [float(r[f"c{i}"]) for i in range(len(domains))] for r in cells}
    bayes = []
    for i in range(len(domains)):
        met = [[sum(c[d] for pattern, c in at.items() if pattern[i] == x) for x in range(LEVELS)] for d in range(len(domains))]
        bayes.append([[log((x + 0.5) / (sum(m) + 0.5 * LEVELS)) + (log(p) if i == 0 else 0.0) for x in m] for m, p in zip(met, prior)])
    seen = {}
    for pattern, c in at.items():
        drawn = [sum(bayes[i][d][x] for i, x in enumerate(pattern)) for d in range(len(domains))]
        share = [exp(x - max(drawn)) for x in drawn]
        seen[pattern] = [(x + SHRINK * p / sum(share)) / (sum(c) + SHRINK) for x, p in zip(c, share)]
    return features, seen, bayes


def posteriors(docs: DataFrame, domains: list[str], features: dict[str, int], cells: dict[tuple[int, ...], list[float]], bayes: list[list[list[float]]], *keep: str) -> DataFrame:
    """(keep..., n_tokens, p_<domain>...): one row for each row of docs; unseen patterns get the naive Bayes."""
    keep = keep or ("doc_id",)
    found = hits(docs, features, len(domains), *keep)
    drawn = F.array(*(reduce(lambda a, b: a + b, (F.get(F.array(*map(F.lit, bayes[i][d])), F.col(f"h{i}")) for i in range(len(domains)))) for d in range(len(domains))))
    share = F.transform("drawn", lambda x: F.exp(x - F.array_max("drawn")))
    out = F.transform("share", lambda x: x / F.aggregate("share", F.lit(0.0), lambda a, b: a + b))
    for pattern, p in cells.items():
        out = F.when(reduce(lambda a, b: a & b, (F.col(f"h{i}") == h for i, h in enumerate(pattern))), F.array(*map(F.lit, p))).otherwise(out)
    found = found.withColumn("drawn", drawn).withColumn("share", share)
    return found.select(*keep, "n_tokens", out.alias("p")).select(*keep, "n_tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)))


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a symmetric system of a few unknowns, drawn to zero where it is singular."""
    n = len(right)
    ridge = 1e-9 * max(1e-300, *(matrix[i][i] for i in range(n)))
    rows = [[*(x + (ridge if i == j else 0.0) for j, x in enumerate(row)), y] for i, (row, y) in enumerate(zip(matrix, right))]
    for i in range(n):
        top = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[top] = rows[top], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(n):
            if k != i:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i])]
    return [row[-1] for row in rows]


def rates(soft: DataFrame, targets: dict[str, float], budget: float | None = None, least: Column | None = None, most_epochs: float | None = MOST_EPOCHS, most_steps: int = MOST_STEPS, strict: bool = False) -> DataFrame:
    """Add ``rate``. Targets are weights; ``budget`` is the total of expected tokens.

    Without a budget the domain of the largest weight keeps the tokens it has and the others follow. No
    domain aims at more than ``most_epochs`` times what it has (None: no such bound). ``least``, a column
    of the posteriors, bounds rates from below. What a domain has, was asked for, aimed at and reached is
    logged, as a warning if a target is missed; ``strict`` makes that an error.

    The gradient at a row depends on its posteriors alone and all rates start equal, so rows of equal
    posteriors have equal rates at every step: the descent runs over the distinct posteriors and their tokens.
    """
    domains, ps = list(targets), [f"p_{d}" for d in targets]
    total = lambda d, r: F.sum(F.col("n_tokens") * F.col(f"p_{d}") * r)
    classes = cut(soft.groupBy(*ps).agg(F.sum("n_tokens").cast("double").alias("n_tokens")))

    def tokens(rows, rate):
        got = rows.agg(*(total(d, rate).alias(d) for d in domains)).first()
        return {d: float(got[d] or 0.0) for d in domains}

    have = tokens(classes, F.lit(1.0))
    weight = sum(targets.values())
    if budget is None:
        lead = max(domains, key=lambda d: targets[d])
        budget = have[lead] * weight / targets[lead]
    asked = {d: budget * targets[d] / weight for d in domains}
    aim = asked if most_epochs is None else {d: min(asked[d], most_epochs * have[d]) for d in domains}
    bound, scale = F.lit(0.0) if least is None else least, max(budget, 1.0)
    gap = lambda got: {d: got[d] - aim[d] for d in domains}
    far = lambda residual: max(map(abs, residual.values()))

    def descended(rate, residual):
        pull = reduce(lambda a, b: a + b, (F.col(f"p_{d}") * F.lit(residual[d] / have[d] if have[d] > 0 else 0.0) for d in domains))
        return F.greatest(bound, rate - pull)

    now, rate, residual = classes, F.lit(1.0), gap(have)
    for step in range(1, most_steps + 1):
        if far(residual) <= TOLERANCE * scale:
            break
        if step <= PLAIN_STEPS:
            rate = descended(rate, residual)
            if step % CUT_EVERY == 0 or step == PLAIN_STEPS:
                now, rate = cut(now.withColumn("rate", rate)), F.col("rate")
            was, residual = residual, gap(tokens(now, rate))
        else:  # slow: the gradient scaled by the curvature over the rates that aren't at their bound
            free = F.when(F.col("rate") > bound, F.col("n_tokens")).otherwise(0.0)
            bent = now.agg(*(F.sum(free * F.col(a) * F.col(b)).alias(f"{i} {j}") for i, a in enumerate(ps) for j, b in enumerate(ps))).first()
            pull = _solved([[float(bent[f"{i} {j}"] or 0.0) for j in range(len(ps))] for i in range(len(ps))], [residual[d] for d in domains])
            now = cut(now.withColumn("rate", F.greatest(bound, F.col("rate") - reduce(lambda a, b: a + b, (F.col(p) * F.lit(x) for p, x in zip(ps, pull))))))
            was, residual = residual, gap(tokens(now, F.col("rate")))
        if step > CUT_EVERY and far({d: residual[d] - was[d] for d in domains}) <= 1e-3 * TOLERANCE * scale:
            break  # settled: what is missing is out of reach
    reached = {d: aim[d] + residual[d] for d in domains}
    said = "; ".join(f"{d}: has {have[d]:.0f}, asked {asked[d]:.0f}, aimed {aim[d]:.0f}, reached {reached[d]:.0f}" for d in domains)
    if any(abs(reached[d] - asked[d]) > 10 * TOLERANCE * scale for d in domains):
        if strict:
            raise ValueError(f"targets of the mix are missed: {said}")
        _LOG.warning("tokens of the mix: %s", said)
    else:
        _LOG.info("tokens of the mix: %s", said)
    fitted = cut(now.select(*(F.col(p).alias(f"_{p}") for p in ps), rate.alias("rate")))
    fitted = bounded(fitted, fitted.count())
    same = reduce(lambda a, b: a & b, (F.col(p).eqNullSafe(F.col(f"_{p}")) for p in ps))
    return soft.drop("rate").join(fitted, same).drop(*(f"_{p}" for p in ps))


def copies(rate: Column, key: Column, seed: int = 10) -> Column:
    """How often a document is taken: its rate rounded up or down by a hash, so that it is right on average."""
    return F.floor(rate + F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))).cast("long")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None, keep: tuple[str, ...] = (), most_epochs: float | None = MOST_EPOCHS, strict: bool = False) -> DataFrame:
    """(doc_id, keep..., n_tokens, p_<domain>..., rate, copies) for every row of docs (doc_id, text, keep...).

    Without a budget, documents more likely than not of the domain of the largest weight stay: their
    rate is one at least. Null ids are rounded by the first column of ``keep``, if there is one.
    """
    domains = list(targets)
    lead = max(domains, key=lambda d: targets[d])
    least = F.when(F.col(f"p_{lead}") >= 0.5, 1.0).otherwise(0.0) if budget is None else None
    fitted = rates(cut(posteriors(docs, domains, *fit(docs, labelled, domains), "doc_id", *keep)), targets, budget, least, most_epochs, strict=strict)
    times = copies(F.col("rate"), F.col("doc_id"))
    if keep:
        times = F.when(F.col("doc_id").isNull(), copies(F.col("rate"), F.col(keep[0]))).otherwise(times)
    return fitted.withColumn("copies", times)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")))
