import random
from zlib import crc32

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import toxicity as t

WORDS = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(15) for j in range(15)]


def corpus(n=600, seed=1):
    draw = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [draw.choice(WORDS) for _ in range(draw.randrange(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(draw.randrange(1, 4)):
                words.insert(draw.randrange(len(words)), draw.choice(["grumblo", "snorkfa", "zlurp" + draw.choice("abcdef"), "gr\u043embl0"]))
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic), 7))
    return docs, labels


def test_folding():
    assert t.folded_words("Idi\u043et 1d10t $tupid 2024 st\u03c5pid \uff54oxic a@b") == ["idiot", "ldlot", "stupid", "2024", "stupid", "toxic", "aab"]
    assert t.folded_words(None) == t.folded_words(" .,! ") == []


def test_exceptions_and_weights():
    m = t.Model({" trash ": 2.0, " tras": 1.0, " clown ": 3.0})
    assert t.weigh(m, "Trash! trashy clown") == (6.0, 3)
    assert t.weigh(m, "a trash can and a circus clown") == (0.0, 7)
    assert t.weigh(m, "trash cannot") == (2.0, 2)
    assert t.weigh(t.Model(exceptions=()), "anything") == (0.0, 1)


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, weight int")
    model = t.learn(d, lab)
    rows = t.weighed(d, model, keep="doc_id").join(lab.drop("weight"), "doc_id").collect()
    out = [r for r in rows if crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = [(r["score"] >= 0.5) == bool(r["toxic"]) for r in out]
    assert len(out) > 80 and sum(right) / len(right) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = {r["doc_id"] for r in d.where(t.held_out(F.col("doc_id"))).collect()}
    assert held == {i for i in range(600) if crc32(str(i).encode()) % 5 == 0}


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    turned = [(i, 1 - x if crc32(str(i).encode()) % 5 == 0 else x, 0) for i, x, _ in labels]
    a, b = (t.learn(d, spark.createDataFrame(x, "doc_id long, toxic int, weight int")) for x in (labels, turned))
    assert a == b


def test_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "x " * 20_000)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    model = t.learn(d, none)
    assert [r["score"] for r in t.weighed(d, model, keep="doc_id").collect()] == [0.0] * 4
    assert t.weighed(d.limit(0), model, keep="doc_id").count() == 0
    twice = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert len(t.weighed(d, t.learn(d, twice), keep="doc_id").collect()) == 4


def test_signs_that_stand_for_i_or_l():
    m = t.Model({" idiot ": 3.0, " stink": 2.0, " fool ": 1.0}, exceptions=())
    for text in ("1d10t", "!d!ot", "Idi0t", "1di0t", "i​diot", "ídíot", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", "idiot", "1diot"):
        assert t.weigh(m, f"you {text} there")[0] == (3.0 if text != "!d!ot" else 0.0), text  # a sign at a word's edge is none of its letters
    assert t.weigh(m, "st1nker, stiñk st!nk")[0] == 6.0
    assert t.weigh(m, "f001 foo1 fooi food")[0] == 2.0


def test_many_exception_phrases_are_linear():
    import time

    m = t.Model({" trash ": 2.0})
    began = time.process_time()
    assert t.weigh(m, "trash can trash " * 50_000) == (100_000.0, 150_000)
    assert time.process_time() - began < 10


def test_exceptions_are_learned_from_clean_rows_alone(spark):
    docs, labels = corpus()
    docs = [(i, x + (" zlurpa stew" if i % 4 == 1 else ""), y) for i, x, y in docs]
    model = t.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int, weight int"))
    assert not any(w.startswith(" zlur") for w in model.entries) or "zlurpa stew" in model.exceptions
    assert t.weigh(t.Model({" zlurpa ": 2.0}, (), model.exceptions), "grumblo zlurpa")[0] == 2.0


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "plain words", 3.0, 5), (1, "plain words", 4.0, 6)], "doc_id long, text string, score double, n_words int")
    assert [r["n_words"] for r in t.weighed(d, t.Model({" plain ": 1.0}), keep="doc_id").collect()] == [2, 2]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from(["trash", "trashy", "can", "clown", "fish", "clownfish", "tr4sh", "c1own", "x", "not"]), max_size=30))
def test_against_a_plain_search(words):
    """Every entry and exception looked for at every word."""
    entries, exceptions = {" trash ": 2.0, " tras": 1.0, " clown": 3.0, " clown ": 4.0}, ("trash can", "clown fish", "not trash can")
    padded = " " + " ".join(t.folded_words(" ".join(words))) + " "
    spare = [(i, i + len(x) + 1) for x in exceptions for i in range(len(padded)) if padded.startswith(f" {x} ", i)]
    want, spelled = 0.0, {**{e.replace("i", "l"): w for e, w in entries.items()}, **entries}
    for i in range(len(padded)):
        heaviest = max((w for e, w in spelled.items() if padded.startswith(e, i)), default=0.0)
        if not any(a <= i < b for a, b in spare):
            want += heaviest
    assert t.weigh(t.Model(entries, exceptions=exceptions), " ".join(words)) == (want, len(words))
