import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courseloom.llm import toxicity
from courseloom.llm.toxicity import GRADES, Model, fit, score, terms_of, train


def loss(weights, cuts, rows, columns, values, grades, ridge):
    z = np.bincount(rows, weights[columns] * values, len(grades))
    below = np.column_stack([np.zeros(len(z)), *(toxicity.sigmoid(c - z) for c in cuts), np.ones(len(z))])
    p = below[np.arange(len(z)), grades + 1] - below[np.arange(len(z)), grades]
    return -np.log(p).mean() + ridge / 2 * (weights ** 2).sum()


def test_fit_finds_the_minimum():
    rng = np.random.default_rng(4)
    n, d = 800, 6
    x = rng.random((n, d)) * (rng.random((n, d)) < 0.5)
    z = x @ np.array([3.0, -2, 1, 0, 0, 4]) + rng.logistic(size=n)
    grades = (z > 1.5).astype(int) + (z > 4)
    rows, columns = np.nonzero(x)
    args = (rows, columns, x[rows, columns], grades)
    weights, cuts = fit(*args, d, rounds=1500)
    assert cuts[0] < cuts[1]
    best = loss(weights, cuts, *args, toxicity.RIDGE)
    for _ in range(200):
        dw, dc = rng.normal(size=d) * 0.05, rng.normal(size=2) * 0.05
        assert loss(weights + dw, cuts + dc, *args, toxicity.RIDGE) > best - 1e-5


def test_terms():
    assert dict(terms_of(["ab", "abcdefgh", "ab"])) == {"ab": 2, "abcdefgh": 1, "abcde~": 1, "abcdefg~": 1}


def test_expected_severity():
    model = Model({"bad": 0}, np.array([3.0]), np.array([1.0, 4.0]))
    over = model.over(["bad", "x"])
    assert over == pytest.approx(1 / (1 + np.exp(np.array([1.0, 4.0]) - 3 * np.log(2))))
    assert (np.diff(model.over(["bad"] * 9)) < 0).all()


@pytest.fixture
def corpus(docs, spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(900):
        words = [rng.choice(["the", "of", "and", "to", "it"]) if rng.random() < 0.4 else f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 80))]
        bad = rng.random() < 0.2
        for _ in range(rng.randint(1, 8) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Idiot!", "scum", "vile**", "trashlike", "trashest"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    return rows, marks, docs, spark


def test_held_out(corpus):
    rows, marks, docs, spark = corpus
    df = docs(rows + [(2000, None), (None, ""), (2001, "scum idiot vile scum idiot"), (2001, "scum idiot vile scum idiot")])
    labels = spark.createDataFrame(marks + [(None, 1), (3, None)], "doc_id long, toxic int").withColumn("quality", F.lit(1))
    model = train(df, labels.filter("doc_id < 700 or doc_id is null"))
    assert len(model.cuts) == GRADES - 1 and model.cuts[0] < model.cuts[1]
    got = score(df, model).collect()
    assert len(got) == len(rows) + 4
    truth = dict(marks)
    held = [r for r in got if r["doc_id"] is not None and 700 <= r["doc_id"] < 900]
    hit = [r for r in held if truth[r["doc_id"]]]
    assert sum(r["toxic"] for r in hit) >= 0.85 * len(hit) and not any(r["toxic"] for r in held if not truth[r["doc_id"]])
    for r in got:
        assert 0 <= r["severity"] <= GRADES - 1 and r["severity"] >= r["p_toxic"] and 0 <= r["grade"] < GRADES
    assert all(r["toxic"] for r in got if r["doc_id"] == 2001) and not any(r["toxic"] for r in got if r["doc_id"] in (None, 2000))
    texts = dict(rows)
    few = [r["severity"] for r in hit if sum(w in texts[r["doc_id"]] for w in ("Idiot", "scum", "vile", "trash")) == 1]
    many = [r["severity"] for r in hit if sum(w in texts[r["doc_id"]] for w in ("Idiot", "scum", "vile", "trash")) == 4]
    assert np.mean(few) < np.mean(many)


def test_rows_as_the_model_has_them_and_repeated_ids(corpus):
    rows, marks, docs, spark = corpus
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    one, many = train(docs(rows[:300]), labels), train(docs(rows[:300] + [rows[5]] * 40 + [(7, None)] * 9), labels)
    assert one.place == many.place and np.array_equal(one.weights, many.weights) and np.array_equal(one.cuts, many.cuts)
    odd = [(3000, None), (3001, ""), (3002, "unknown words only"), (3003, "scum " * 20000)]
    texts = dict(rows[:300] + odd)
    for r in score(docs(rows[:300] + odd), one).collect():
        over = one.over(toxicity.words_of(texts[r["doc_id"]]))
        each = [1 - over[0], over[0] - over[1], over[1]]
        assert r["p_toxic"] == pytest.approx(over[0]) and r["severity"] == pytest.approx(over.sum())
        assert each[r["grade"]] == pytest.approx(max(each)) and r["toxic"] == (over[0] > toxicity.TOXIC_OVER)


def test_nothing_to_learn(corpus, docs):
    rows, marks, docs, spark = corpus
    none = spark.createDataFrame([], "doc_id long, toxic int")
    df = docs(rows[:20])
    for labels in (none, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")):
        assert not any(r["toxic"] for r in score(df, train(df, labels)).collect())
    assert score(docs([]), train(docs([]), none)).collect() == []
