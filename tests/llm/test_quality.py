import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import quality

GOOD = "\n".join(f"This is sentence number {i} of a plain and honest text about {w}." for i, w in enumerate(["rain", "trees", "rivers", "stones", "roads", "birds", "fields", "towns"]))


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["a", "b", "é", "#x", "|", "\n", "\n\n", " ", "\t", "\x0b", "\u00a0", "\x1c", "a b"]), max_size=60))
def test_measures(parts):
    text = " ".join(parts)
    assert quality.base_measures(text.encode(), len(text)) == brute(text)


def test_repeats():
    draw = random.Random(2)
    for _ in range(50):
        text = " ".join(draw.choice("ab") for _ in range(draw.randrange(60)))
        assert quality.base_measures(text.encode(), len(text)) == brute(text)


def test_line_rules():
    assert quality.line_fault("A plain sentence.") == ""
    assert quality.line_fault("A plain sentence. and more after") == ""
    assert quality.line_fault("no end here") == "punctuation"
    assert quality.line_fault("Home | News | Sport | About us.") == "navigation"
    assert quality.line_fault("of%%% the&&& in$$$ was### it.") == "decoration"
    assert quality.line_fault("THIS!! IS!! LOUD!! VERY!! LOUD!!") == "shouting"
    assert quality.line_fault("spam " * 12 + "spam.") == "monotony"
    assert quality.line_fault("All rights reserved.") == "boilerplate"
    assert quality.cleaned(GOOD + "\nAll rights reserved.")[0] == GOOD


def test_verdicts(spark):
    junk = "\n".join(f"Menu{i} | News{i} | Sport{i} | Weather{i} | More{i}." for i in range(12))
    texts = [GOOD, junk, GOOD + "\n" + junk[:60], "", None, "short text.", " ".join(["one two three four five six seven eight."] * 10), "word. " * 50_000]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    rows = quality.judge(df, text_out="clean").orderBy("doc_id").collect()
    assert [r["kept"] for r in rows] == [True, False, True, False, False, False, False, False]
    assert [r["base_failed"] for r in rows] == [False, False, False, True, True, True, True, True]
    assert rows[2]["clean"] == GOOD and rows[7]["n_words"] == 50_000
    assert quality.judge(df.limit(0)).count() == 0
    over = quality.judge(df, text_out="text").orderBy("doc_id").first()
    assert over["text"] == GOOD


def test_a_phrase_in_a_long_line_is_no_boilerplate(spark):
    article = " ".join(f"River{i} runs past hill{i} to town{i} and field{i}." for i in range(20))
    said = article + " The author holds the copyright of the maps and links to a privacy policy."
    assert quality.line_fault(said) == "" and quality.cleaned(said) == (said, 0.0)
    assert quality.line_fault(" ".join(f"All rights reserved by owner{k}, copyright of holder{k} since year{k}, see terms of use number{k}." for k in range(4))) == "boilerplate"
    rows = quality.judge(spark.createDataFrame([(1, said)], "doc_id long, text string"), text_out="clean").collect()
    assert [(r["kept"], r["clean"]) for r in rows] == [(True, said)]


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, GOOD), (1, GOOD), (None, GOOD), (None, None)], "doc_id long, text string")
    rows = quality.judge(df).collect()
    assert sorted((r["kept"] for r in rows)) == [False, True, True, True] and len({r["n_words"] for r in rows}) == 2


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from(["A line that ends.", "no end here", "a | b | c | d.", "THIS!! IS!! LOUD!! VERY!! LOUD!!", "Cookie policy.", "of%%% the&&& in$$$.", "", "  ", "spam " * 12 + "."]), max_size=12))
def test_verdict_by_lines(lines):
    """What is kept, from each line judged alone."""
    text = "\n".join(lines)
    bad = [x for x in lines if x.strip() and quality.line_fault(x)]
    size = lambda xs: sum(len("".join(x.split())) for x in xs)
    clean, lost = quality.cleaned(text)
    assert clean == "\n".join(x for x in text.split("\n") if not (x.strip() and quality.line_fault(x)))
    assert lost == (size(bad) / size(lines) if size(lines) else 0.0)
    assert {quality.line_fault(x) for x in lines if x.strip()} <= {"", "punctuation", "navigation", "decoration", "shouting", "monotony", "boilerplate"}
