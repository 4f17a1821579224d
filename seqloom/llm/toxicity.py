"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, marks and mathematical letters taken apart, signs without width
dropped, look-alike letters of other scripts to Latin ones, digits and signs that stand for letters
inside a word. What stands for i may as well stand for l, so in words with such a sign both are written l,
and every entry is in the automaton in that spelling, too. The automaton runs over the folded words once
and matches lexicon entries, whole words or word beginnings, and exception phrases; an entry inside an
exception phrase does not count, and a word counts its heaviest entry. The summed weight, itself and
relative to the text's length, goes through a logistic curve.

Entries, weights, exception phrases (a matched word with a neighbour, met in clean rows alone) and the
curve are learned from labelled rows whose crc32 of the id is not divisible by five, at most
``most_labelled`` of them (those of smallest hash). Nothing but the text enters a score. The lexicon holds
at most ``most_entries`` entries, the most telling ones, and is shipped with the tasks; scoring is one
narrow pass over all whole texts, linear in their length.

Edge cases: null or empty text has no words and gets the curve's value for no matches; null labels
are left out, a doubly labelled id counts as its larger label; without labelled rows every score is 0;
repeated rows score alike; clashing extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, released, sliced, table

MOST_LABELLED = 8_000
MOST_ENTRIES = 600
#: Log likelihood ratio (G) that an entry must reach: far beyond what chance gives among millions of candidates.
LEAST_G = 30.0
LEAST_WEIGHT = 1.5
#: Lengths of the word beginnings that may enter the lexicon.
BEGINNINGS = (4, 5, 6, 7)
#: Clean rows that a learned exception phrase must be met in, without any toxic one, and how many are learned at most.
LEAST_CLEAN = 5
MOST_EXCEPTIONS = 2_000
#: Phrases in which a lexicon word is no insult, folded; others are learned.
EXCEPTIONS = ("trash can", "trash bin", "take out the trash", "clown fish", "circus clown", "pathetic fallacy", "pond scum", "not stupid", "not worthless", "no idiot")

#: Fixed look-alikes, by script, and what they fold to.
_ALIKE = str.maketrans(
    # Cyrillic
    "абвгдеёзіїјкмнорстухѕԁһԝ"
    # Greek
    "αβεηικνορτυχω"
    # Latin with marks that are drawn like plain letters, and full-width letters
    "ıłøɑɡⅰⅼａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ",
    "abvgdeeziijkmhopctyxsdhw" "abehikvoptuxw" "iloagilabcdefghijklmnopqrstuvwxyz",
)
#: Digits and signs that stand for a letter inside a word; the last three stand for i or l.
_STAND_IN = str.maketrans("034578@$1!|", "oeastbaslll")
_I_OR_L = re.compile("[1!|]").search
_WORDS = re.compile(r"[\w@$]+(?:[!|]+[\w@$]+)*").findall
#: Combining marks and signs without width; Latin letters lose theirs, others are folded with them.
_UNSEEN = re.compile("[\u0300-\u036f\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]+").sub


def folded_words(text: str | None) -> list[str]:
    text = text or ""
    if not text.isascii():  # decomposed, marks are characters of their own
        text = _UNSEEN("", unicodedata.normalize("NFKD", text))
    words = _WORDS(text.lower().translate(_ALIKE))
    return [w if w.isalpha() else _stand_in(w) for w in words]


def _stand_in(word: str) -> str:
    if not any(map(str.isalpha, word)):
        return word
    return word.translate(_STAND_IN) if not _I_OR_L(word) else word.translate(_STAND_IN).replace("i", "l")


@dataclass(frozen=True)
class Model:
    """Entries are " word " or " beginning"; the curve is over (1, log of the sum, log of its share)."""

    entries: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = ()
    exceptions: tuple[str, ...] = EXCEPTIONS

    def key(self):
        return tuple(self.entries.items()), self.exceptions


@lru_cache(maxsize=4)
def _automaton(key):
    import ahocorasick

    entries, exceptions = key
    found = ahocorasick.Automaton()
    for text, weight in sorted(entries, key=lambda x: x[1]):  # of entries spelled alike the heaviest stays
        found.add_word(text.replace("i", "l"), (len(text), weight))
    for text, weight in entries:
        found.add_word(text, (len(text), weight))
    for text in exceptions:
        found.add_word(f" {text} ", (len(text) + 2, None))
    found.make_automaton()
    return found if len(found) else None


def weigh(model: Model, text: str | None) -> tuple[float, int]:
    """Summed weight of the words that match, and the number of words."""
    words = folded_words(text)
    automaton = _automaton(model.key())
    if not words or automaton is None:
        return 0.0, len(words)
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for last, (size, weight) in automaton.iter(f" {' '.join(words)} "):
        start = last - size + 1
        if weight is None:
            spared.append((start, last))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if spared:
        spared.sort()
        reach, far = [], -1  # how far the phrases that begin up to here go
        for _, b in spared:
            reach.append(far := max(far, b))
        begins = [a for a, _ in spared]
        best = {s: w for s, w in best.items() if not ((at := bisect_right(begins, s)) and s < reach[at - 1])}
    return sum(best.values()), len(words)


def _inputs(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack((np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1))))


def score(model: Model, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    if not model.curve:
        return np.zeros(len(weight))
    return 1 / (1 + np.exp(-np.clip(_inputs(weight, words) @ np.array(model.curve), -30, 30)))


def _curve(weight: np.ndarray, words: np.ndarray, label: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    x, w = _inputs(weight, words), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), x.T @ (label - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5 == 0


def _signed(rows: DataFrame) -> DataFrame:
    """Rows (text, toxic) with the smallest hash of their three-word shingles, which near copies mostly share."""
    import xxhash

    def run(batches):
        for b in sliced(batches, 0):
            out = []
            for text in b.column(0).to_pylist():
                words = folded_words(text)
                out.append(min(xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))) >> 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=["text", "toxic", "signature"])

    return rows.mapInArrow(released(run), f"text string, toxic {rows.schema['toxic'].dataType.simpleString()}, signature long")


def _clean_phrases(rows: DataFrame, model: Model) -> tuple[str, ...]:
    """Pairs of neighbouring words that hold a match, met in LEAST_CLEAN clean rows or more and in no toxic one."""

    def run(batches):
        automaton = _automaton(model.key())
        for b in sliced(batches, 0):
            found = (Counter(), Counter())
            for text, toxic in zip(*(c.to_pylist() for c in b.columns)):
                words = folded_words(text)
                hit = [automaton is not None and any(w is not None for _, (_, w) in automaton.iter(f" {x} ")) for x in words]
                found[toxic].update({f"{x} {y}" for x, y, a, c in zip(words, words[1:], hit, hit[1:]) if a or c})
            names = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in found)], names=["phrase", "clean", "toxic"])

    counts = rows.mapInArrow(released(run), "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    top = counts.where((F.col("clean") >= LEAST_CLEAN) & (F.col("toxic") == 0)).orderBy(F.desc("clean"), "phrase").limit(MOST_EXCEPTIONS)
    return tuple(r["phrase"] for r in top.collect())


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, most_labelled: int = MOST_LABELLED, most_entries: int = MOST_ENTRIES) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic)."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # at most most_labelled ids
    rows = cut(_signed(rows).dropDuplicates(["signature", "toxic"]).select("text", "toxic"))  # copies would count as evidence over and over

    def count(batches):
        for b in sliced(batches, 0):
            found = (Counter(), Counter())
            for text, toxic in zip(*(c.to_pylist() for c in b.columns)):
                words = set(folded_words(text))
                found[toxic].update({f" {w} " for w in words if len(w) > 2} | {f" {w[:k]}" for w in words for k in BEGINNINGS if len(w) >= k})
                found[toxic][""] += 1  # documents
            names = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array([c[x] for x in names], pa.int64()) for c in found)], names=["entry", "clean", "toxic"])

    counts = cut(rows.mapInArrow(released(count), "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    sizes = counts.where("entry = ''").first()
    if sizes is None:
        return Model(exceptions=exceptions)
    t, c, n_t, n_c = F.col("toxic"), F.col("clean"), float(sizes["toxic"]), float(sizes["clean"])
    share = (t + c) / F.lit(max(n_t + n_c, 1.0))
    part = lambda seen, of: F.when(seen > 0, seen * F.log(seen / (share * of))).otherwise(0.0) + F.when(seen < of, (of - seen) * F.log((of - seen) / ((1 - share) * of))).otherwise(0.0)
    odds = F.log((t + 0.5) / (F.lit(n_t) - t + 0.5)) - F.log((c + 0.5) / (F.lit(n_c) - c + 0.5))
    ranked = counts.where("entry <> ''").select("entry", odds.alias("weight"), (2 * (part(t, F.lit(n_t)) + part(c, F.lit(n_c)))).alias("g"))
    top = ranked.where((F.col("g") >= LEAST_G) & (F.col("weight") >= LEAST_WEIGHT)).orderBy(F.desc("g"), F.length("entry"), "entry").limit(10 * most_entries).collect()
    entries: dict[str, float] = {}
    for r in top:  # what a chosen beginning already covers adds nothing
        if len(entries) < most_entries and not any(r["entry"][:k] in entries for k in range(2, len(r["entry"]))):
            entries[r["entry"]] = r["weight"]
    model = Model(entries, (), exceptions)
    model = Model(entries, (), (*exceptions, *_clean_phrases(rows, model)))
    seen = weighed(rows, model, keep="toxic").toPandas()  # at most a row for each labelled one
    curve = _curve(seen["weight"].to_numpy(), seen["n_words"].to_numpy(), seen["toxic"].to_numpy(dtype=float))
    return Model(model.entries, curve, model.exceptions)


def weighed(df: DataFrame, model: Model, keep: str, column: str = "text") -> DataFrame:
    """(keep, weight, n_words, score) of each text."""

    def run(batches):
        for b in sliced(batches, 1):
            found = [weigh(model, t) for t in b.column(1).to_pylist()]
            weight, words = np.array([x[0] for x in found], dtype=float), np.array([x[1] for x in found], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weight), pa.array(words), pa.array(score(model, weight, words))], names=[keep, "weight", "n_words", "score"])

    kept = df.select(keep, column)
    return kept.mapInArrow(released(run), f"{keep} {kept.schema[keep].dataType.simpleString()}, weight double, n_words long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = weighed(docs, learn(docs, table(spark, sf_dir, "labels")), keep="doc_id")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
