"""Counted vocabulary and converging solver of the category model."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.ml import softmax

WORDS = ["bread", "milk", "rent", "flat", "bus", "train", "a", "the", "fee", "café"]


def rows(n, seed=1):
    rnd = random.Random(seed)
    kinds = {"food": [0, 1, 9], "home": [2, 3, 8], "travel": [4, 5, 8]}
    out = []
    for i in range(n):
        c = rnd.choice(list(kinds))
        w = [WORDS[rnd.choice(kinds[c] if rnd.random() < 0.7 else range(10))] for _ in range(rnd.randrange(1, 7))]
        out.append((str(i), 1, "expense", c, 5, "2024-01-05", " ".join(w)))
    return out


def features(data):
    """(X, y, vocabulary) as the model defines them, dense."""
    import re
    docs = []
    for r in data:
        w = re.findall(r"(?u)\b\w\w+\b", r[6].lower())
        docs.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    df, total = Counter(t for d in docs for t in d), Counter()
    for d in docs:
        total.update(d)
    vocab = sorted(df, key=lambda t: (-total[t], t))
    x = np.array([[d[t] * (math.log((len(docs) + 1) / (df[t] + 1)) + 1) for t in vocab] for d in docs])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1), np.array([sorted({r[3] for r in data}).index(r[3]) for r in data]), vocab


def test_solver_reaches_the_optimum(spark, make_ledger):
    data = rows(120)
    m = softmax.fit_softmax(make_ledger(data + [("n", 1, "expense", "food", 5, "2024-01-05", None), ("c", 1, "expense", None, 5, "2024-01-05", "x")]),
                            tol=1e-6)
    x, y, vocab = features(data)
    n, k = len(y), 3

    def value(p):
        w, b = p[:-k].reshape(-1, k), p[-k:]
        z = x @ w + b
        z -= z.max(1, keepdims=True)
        q = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        e = q - np.eye(k)[y]
        return (-np.log(q[np.arange(n), y]).mean() + (w * w).sum() / (2 * n), np.concatenate([((x.T @ e + w) / n).ravel(), e.mean(0)]))

    best, _, gradient, f = softmax.minimise(value, np.zeros((x.shape[1] + 1) * k), np.ones((x.shape[1] + 1) * k), tol=1e-9, max_steps=5000)
    assert gradient <= 1e-9 and m.gradient <= 1e-6 and m.steps < 100 and abs(m.objective - f) < 1e-8
    terms = {r["term"]: r for r in m.terms.collect()}
    assert set(terms) == set(vocab)
    w = best[:-k].reshape(-1, k)
    assert max(np.abs(np.array(terms[t]["w"]) - w[i]).max() for i, t in enumerate(vocab)) < 1e-3
    want = np.argmax(x @ w + best[-k:], axis=1)
    got = {r["tx_id"]: r for r in softmax.predict_softmax(m, make_ledger(data)).collect()}
    assert [got[r[0]]["predicted"] for r in data] == [m.labels[j] for j in want]
    assert all(1 / 3 <= r["probability"] <= 1 for r in got.values())
    assert softmax.evaluate_softmax(m, make_ledger(data)).first()["accuracy"] == pytest.approx(np.mean(want == y))


def test_bounded_vocabulary_and_odd_notes(spark, make_ledger):
    led = make_ledger(rows(40))
    m = softmax.fit_softmax(led, max_terms=5)
    assert m.terms.count() == 5
    odd = make_ledger([("1", 1, "expense", "food", 5, "2024-01-05", "never seen before"), ("2", 1, "expense", None, 5, "2024-01-05", ""),
                       ("3", 1, "expense", "x", 5, "2024-01-05", None), ("1", 1, "expense", "food", 5, "2024-01-05", "bread milk")])
    got = softmax.predict_softmax(m, odd.withColumn("id", F.lit("clash")).withColumn("z", F.lit(1))).collect()
    assert sorted(r["tx_id"] for r in got) == ["1", "1", "2"] and {r["id"] for r in got} == {"clash"}
    assert {r["predicted"] for r in got if r["note"] in ("", "never seen before")} == {m.labels[int(np.argmax(m.bias))]}
    assert softmax.fit_softmax(led.limit(0)) is None
    one = softmax.fit_softmax(led.filter("category = 'food'"))
    assert {r["predicted"] for r in softmax.predict_softmax(one, led).collect()} == {"food"}


def test_rows_without_arrow_conversion_and_long_notes(spark, make_ledger):
    """Sessions that convert row by row refuse numpy numbers; a long note costs time in proportion to its length."""
    before = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        long_note = " ".join(f"w{i}" for i in range(20_000))
        led = make_ledger([*rows(20), ("l", 1, "expense", "home", 5, "2024-01-05", long_note)])
        start = time.time()
        m = softmax.fit_softmax(led)
        got = {r["tx_id"]: r["predicted"] for r in softmax.predict_softmax(m, led).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", before)
    assert len(got) == 21 and got["l"] == "home" and time.time() - start < 120


def test_gradient_sums_of_many_classes():
    rnd = np.random.default_rng(1)
    place, x = np.sort(rnd.integers(0, 9, 50)), rnd.normal(size=(50, 40))
    place = place[place != 4]
    want = np.zeros((9, 40))
    np.add.at(want, place, x[:len(place)])
    assert np.allclose(softmax._sums(place, x[:len(place)], 9), want)
    assert np.allclose(softmax._sums(place, x[:len(place), :3], 9), want[:, :3])


def test_only_distinct_terms_are_shuffled_to_fit(spark, make_ledger, monkeypatch):
    """rows are counted and weighed in blocks where they are read."""
    led = make_ledger(rows(60))
    want = softmax.fit_softmax(led)
    shuffled = []
    real = softmax._stored
    monkeypatch.setattr(softmax, "_stored", lambda df, name, **o: (shuffled.append((name, "Exchange" in df._jdf.queryExecution().executedPlan().toString())),
                                                                   real(df, name, **o))[1])
    got = softmax.fit_softmax(led)
    assert dict(shuffled) == {"counted": False, "terms": True, "weighed": False, "model": False}     # only distinct terms of blocks are shuffled
    words = spark.createDataFrame([(1, ["b", "a", "b", "a"]), (2, []), (3, ["a"])], "id int, w array<string>").toArrow()["w"].combine_chunks()
    row, code, tf, terms = softmax.count_terms(words)
    assert sorted(zip(row.tolist(), terms.take(code).to_pylist(), tf.tolist())) == [(0, "a", 2), (0, "a b", 1), (0, "b", 2), (0, "b a", 2), (2, "a", 1)]
    assert list(softmax._pieces(words.slice(1))) == [(0, 2)]
    monkeypatch.setattr(softmax, "PIECE", 1)
    assert [p for p in softmax._pieces(words)] == [(0, 1), (1, 3)]
    assert got.labels == want.labels and abs(got.objective - want.objective) < 1e-6
    assert {r["term"] for r in got.terms.collect()} == {r["term"] for r in want.terms.collect()}


def test_rows_are_judged_where_they_are_read(spark, make_ledger):
    """neither rows nor their terms are shuffled or stored to be judged."""
    led = make_ledger(rows(30))
    m = softmax.fit_softmax(led)
    plan = softmax.predict_softmax(m, led)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1
