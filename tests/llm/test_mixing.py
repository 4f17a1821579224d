import random

import numpy as np
import pytest

from seqloom.llm import mixing as m


def soft(spark, p, n):
    return spark.createDataFrame([(i, int(k), *map(float, x)) for i, (x, k) in enumerate(zip(p, n))], "doc_id long, n_tokens long, p_a double, p_b double, p_c double")


def gradient(p, n, aim, steps=48):
    """The same descent, in numpy."""
    have, r = (n[:, None] * p).sum(axis=0), np.ones(len(n))
    for _ in range(steps):
        gap = (r[:, None] * n[:, None] * p).sum(axis=0) - aim
        if np.abs(gap).max() <= m.TOLERANCE * max(aim.sum(), 1):
            break
        r = np.maximum(0, r - p @ np.where(have > 0, gap / np.where(have > 0, have, 1), 0))
    return r


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(3)
    p, n = rng.dirichlet([0.3, 0.3, 0.3], size=400), rng.integers(1, 500, size=400)
    rows = m.rates(soft(spark, p, n), {"a": 0.5, "b": 0.3, "c": 0.2}).orderBy("doc_id").collect()
    r = np.array([x["rate"] for x in rows])
    have, got = (n[:, None] * p).sum(axis=0), (r[:, None] * n[:, None] * p).sum(axis=0)
    aim = have[0] / 0.5 * np.array([0.5, 0.3, 0.2])
    assert (r >= 0).all() and np.abs(got - aim).max() < 0.005 * aim.sum()
    assert np.abs(r - gradient(p, n, aim)).max() < 1e-6


def test_a_target_out_of_reach_stays_nonnegative(spark):
    p, n = np.array([[0.5, 0.5, 0.0], [0.5, 0.5, 0.0], [0.0, 0.0, 1.0]]), np.array([10, 10, 10])
    rows = m.rates(soft(spark, p, n), {"a": 1.0, "b": 0.0, "c": 0.0}).orderBy("doc_id").collect()
    assert [round(x["rate"], 3) for x in rows] == [0.5, 0.5, 0.0]


def corpus(spark, n=400):
    draw = random.Random(4)
    words = [f"plain{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    docs, labels = [], []
    for i in range(n):
        kind = i % 5
        text = [draw.choice(["alpha", "beta", "gamma", "delta", *words]) for _ in range(draw.randrange(10, 60))]
        if kind == 0:
            text[2:2] = ["grumblo", "snorkfa"]
        if kind == 1:
            text = [w + "%%%" for w in text[:5]] + ["the###"] * 3
        docs.append((i, " ".join(text), "x"))
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string, rate string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_mix(spark):
    docs, labels = corpus(spark)
    rows = {r["doc_id"]: r for r in m.mix(docs, m.label_domains(labels)).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == 400
    for i, r in rows.items():
        assert abs(r["p_clean"] + r["p_low"] + r["p_toxic"] - 1) < 1e-9
        assert r["n_tokens"] == len(texts[i].split())
        assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
        if i % 5 > 1:
            assert r["p_clean"] > 0.8 and r["copies"] >= 1  # clean documents stay
    assert np.mean([rows[i]["p_toxic"] for i in range(0, 400, 5)]) > 0.8
    assert sum(rows[i]["copies"] for i in range(0, 400, 5)) < 60
    total = {d: sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in rows.values()) for d in m.TARGETS}
    assert total["toxic"] < 1.2 * m.TARGETS["toxic"] / m.TARGETS["clean"] * total["clean"] + 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (2, "", 3), (3, " one, two. ", 3), (4, "x " * 50_000, 3)], "doc_id long, text string, n_tokens int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = sorted((r["doc_id"], r["n_tokens"], round(r["p_clean"], 6)) for r in m.mix(docs, m.label_domains(none)).collect())
    assert rows == [(1, 0, 0.333333), (2, 0, 0.333333), (2, 0, 0.333333), (3, 2, 0.333333), (4, 50_000, 0.333333)]
    assert m.mix(docs.limit(0), m.label_domains(none)).count() == 0
    odd = spark.createDataFrame([(1, None, 1), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert m.mix(docs, m.label_domains(odd)).count() == 5


@pytest.mark.parametrize("rate", [0.0, 0.25, 1.0, 2.5])
def test_copies_are_right_on_average(spark, rate):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(4000).select(m.copies(F.lit(rate), F.col("id"))).collect()]
    assert abs(np.mean(got) - rate) < 0.03 and set(got) <= {int(rate), int(rate) + 1}


def test_long_clean_documents_with_a_few_feature_words_stay(spark):
    draw = random.Random(5)
    plain = [f"plain{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    docs, labels = [], []
    for i in range(400):
        text = [draw.choice(plain) for _ in range(draw.randrange(30, 90))]
        if i % 4 == 0:
            text[3:3] = ["grumblo", "snorkfa"] * 3
        if i % 40 == 1:  # clean, long, two to four hits by chance
            text = [draw.choice(plain) for _ in range(2000)]
            for at in range(2 + i // 40 % 3):
                text[100 * at] = ["grumblo", "snorkfa"][at % 2]
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 4 == 0)))
    got = m.mix(spark.createDataFrame(docs, "doc_id long, text string"), m.label_domains(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert all(rows[i]["copies"] >= 1 and rows[i]["p_clean"] > 0.5 for i in range(1, 400, 40))
    assert all(rows[i]["p_toxic"] > 0.8 for i in range(0, 400, 4))


def test_missed_targets_are_said(spark, caplog):
    p, n = np.array([[1.0, 0.0, 0.0]] * 9 + [[0.0, 1.0, 0.0]]), np.full(10, 10)
    with caplog.at_level("INFO", logger=m.__name__):
        m.rates(soft(spark, p, n), {"a": 0.5, "b": 0.5, "c": 0.0})
        m.rates(soft(spark, p, n), {"a": 0.9, "b": 0.1, "c": 0.0})
    assert [r.levelname for r in caplog.records] == ["WARNING", "INFO"]
    assert "b: has 10, asked 90, aimed 20, reached 20" in caplog.records[0].getMessage()


def test_targets_beyond_two_epochs_and_strict(spark):
    p, n = np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]), np.array([100, 100])
    want = {"a": 0.2, "b": 0.8, "c": 0.0}
    rows = m.rates(soft(spark, p, n), want, budget=400.0, most_epochs=None, strict=True).orderBy("doc_id").collect()
    assert [round(r["rate"], 3) for r in rows] == [0.8, 3.2]
    with pytest.raises(ValueError, match="b: has 100, asked 320, aimed 200, reached 200"):
        m.rates(soft(spark, p, n), want, budget=400.0, strict=True)


def test_close_posteriors_reach_their_targets(spark):
    """Ill-conditioned: plain steps alone leave a tenth of the shift undone."""
    rng = np.random.default_rng(5)
    a = rng.uniform(0.46, 0.54, 300)
    p, n = np.column_stack((a, 1 - a, np.zeros(300))), np.full(300, 100)
    rows = m.rates(soft(spark, p, n), {"a": 0.52, "b": 0.48, "c": 0.0}, budget=30_000.0, strict=True).collect()
    got = sum(r["rate"] * r["n_tokens"] * r["p_a"] for r in rows)
    assert abs(got - 15_600) < 30 and min(r["rate"] for r in rows) >= 0


def test_null_posteriors_and_ids(spark):
    rows = spark.createDataFrame([(None, 5, 0.5, 0.5, None), (1, 5, 0.5, 0.5, 0.0)], "doc_id long, n_tokens long, p_a double, p_b double, p_c double")
    assert m.rates(rows, {"a": 0.5, "b": 0.5, "c": 0.0}).count() == 2


def test_posteriors_against_a_plain_model(spark):
    """Hits, levels and the cell or naive Bayes of every document, in Python."""
    import math
    import re

    docs, labels = corpus(spark, 150)
    domains = list(m.TARGETS)
    features, cells, bayes = m.fit(docs, m.label_domains(labels), domains)
    rows = {r["doc_id"]: r for r in m.posteriors(docs, domains, features, cells, bayes).collect()}
    assert features and cells
    for d in docs.collect():
        words = [w for w in re.split(r"[\s.,;:?\"()]+", d["text"].lower()) if w]
        pattern = []
        for i in range(len(domains)):
            n = sum(features.get(w[: m.STEM]) == i for w in words)
            share = n / max(1, len(words))
            many = n and max(0, min(math.floor(2 * math.log2(share)) + m.SPARSE, m.SPARSE - m.DENSE)) + 3
            pattern.append(0 if n == 0 else (1 if share < 1 / 32 else 2) if n == 1 else many)
        drawn = [sum(bayes[i][k][x] for i, x in enumerate(pattern)) for k in range(len(domains))]
        soft_ = [math.exp(x - max(drawn)) for x in drawn]
        want = cells.get(tuple(pattern), [x / sum(soft_) for x in soft_])
        assert [rows[d["doc_id"]][f"p_{k}"] for k in domains] == pytest.approx(want)
