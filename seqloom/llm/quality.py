"""Quality rules, line first.

Every line of a document is judged by itself: a line without any sentence end, a navigation bar,
decoration, shouting, one word over and over, or legal boilerplate (a phrase in a short line, or phrases
all through a long one) fails and is taken out. A document
is rejected when the removed lines held more than ``most_lost`` of its non-space characters, or when
it fails the base measures (too few words, too much of it in repeated eight-word windows).

One pass in a task, no shuffle; memory is one Arrow batch, a slice of it at work, and the windows of one document.

Edge cases: null or empty text has no words, fails the base measures and is not kept; a text of one
long line is one line; repeated rows are judged alike; columns named like an output are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import released, sliced, table

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
MOST_LOST = 0.6

_SYMBOLS = b"#*$%&|<>"
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*(?:\s|$)").search
_BOILERPLATE = re.compile(
    r"all rights reserved|\bcopyright\b|\(c\) \d{4}|released under the|licensed under|is licensed|cookie policy|privacy policy|terms of (?:use|service)"
    r"|lorem ipsum|subscribe to our|click here|skip to (?:main )?content|javascript (?:is|must be) (?:enabled|disabled)",
    re.I,
)
#: A line of so many words at most is boilerplate for one phrase; a longer one if it has a phrase for each so many words.
BOILERPLATE_WORDS = 30


def base_measures(data: bytes, n_chars: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text's bytes."""
    words = data.split()  # bytes.split() takes exactly 0x20 and 0x09-0x0D
    chars = n_chars - (len(data) - len(data.translate(None, _SPACES)))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if (n := len(words) - WINDOW + 1) > 1:
        windows = list(zip(*(words[k:] for k in range(WINDOW))))
        if len(set(windows)) < n:
            first: dict[tuple, int] = {}
            edges = np.zeros(len(words) + 1, dtype=np.int64)
            for i, w in enumerate(windows):
                if (j := first.setdefault(w, i)) != i:
                    for at in {i, j}:
                        edges[at] += 1
                        edges[at + WINDOW] -= 1
            repeated = int(np.count_nonzero(np.cumsum(edges)))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def line_fault(line: str) -> str:
    """The first rule that a line with words fails, or nothing."""
    words = line.split()
    n = max(1, len(words))
    if not _SENTENCE_END(line):
        return "punctuation"
    bars = line.count("|")
    if bars >= 3 and bars * 5 >= n:
        return "navigation"
    if sum(map(line.count, "#*$%&<>")) * 2 > n:
        return "decoration"
    if n >= 5 and (line.count("!!") * 2 > n or 2 * sum(map(str.isupper, words)) > n + 4):
        return "shouting"
    if n >= 10 and len(set(words)) * 10 < n * 3:
        return "monotony"
    if _BOILERPLATE.search(line) and (n <= BOILERPLATE_WORDS or len(_BOILERPLATE.findall(line)) * BOILERPLATE_WORDS >= n):
        return "boilerplate"
    return ""


def cleaned(text: str) -> tuple[str, float]:
    """The text without its failing lines, and the share of non-space characters they held."""
    kept, lost, whole = [], 0, 0
    for line in text.split("\n"):
        size = len("".join(line.split()))
        whole += size
        if size and line_fault(line):
            lost += size
        else:
            kept.append(line)
    return "\n".join(kept), lost / whole if whole else 0.0


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(df: DataFrame, column: str = "text", most_lost: float = MOST_LOST, text_out: str | None = None) -> DataFrame:
    """Add the base measures, base_failed, lost_share and kept; ``text_out`` also names the cleaned text."""
    fields = [*(T.StructField(c, T.LongType()) for c in _MEASURES), T.StructField("base_failed", T.BooleanType()), T.StructField("lost_share", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    if text_out:
        fields.append(T.StructField(text_out, T.StringType()))
    df = df.drop(*(f.name for f in fields if f.name != column))

    def run(batches):
        for b in sliced(batches, column):
            texts = [t or "" for t in b.column(column).to_pylist()]
            rows = [base_measures(t.encode(), len(t)) for t in texts]
            failed = [r[0] < LEAST_WORDS or 100 * r[4] > MOST_REPEATED * r[0] for r in rows]
            clean = [cleaned(t) for t in texts]
            kept = [not f and c[1] <= most_lost for f, c in zip(failed, clean)]
            more = [*(pa.array(x, pa.int64()) for x in zip(*rows))] if rows else [pa.array([], pa.int64())] * len(_MEASURES)
            more += [pa.array(failed, pa.bool_()), pa.array([c[1] for c in clean], pa.float64()), pa.array(kept, pa.bool_())]
            if text_out:
                more.append(pa.array([c[0] for c in clean], pa.string()))
            old = [(n, c) for n, c in zip(b.schema.names, b.columns) if n != text_out]
            yield pa.RecordBatch.from_arrays([*(c for _, c in old), *more], names=[*(n for n, _ in old), *(f.name for f in fields)])

    schema = T.StructType([*(f for f in df.schema.fields if f.name != text_out), *fields])
    return df.mapInArrow(released(run), schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *_MEASURES, "base_failed", "kept", "lost_share")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can express."""
    return op5_quality_rules(spark, sf_dir).select("doc_id", *_MEASURES, "base_failed")


QUALITY_BASE_SQL = r"""
WITH x AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM x),
g AS (SELECT row, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) > 7),
k AS (SELECT row, i, array_to_string(words[i : i + 7], ' ') AS key FROM g),
r AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, key) AS n FROM k) WHERE n > 1),
c AS (SELECT row, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(8)) AS j) GROUP BY row),
l AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM x),
u AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda v: length(v))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN u USING (row) LEFT JOIN c USING (row))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
"""
