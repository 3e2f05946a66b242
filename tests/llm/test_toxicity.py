import random

import numpy as np
import pytest

from rimward.llm import toxicity
from tests.llm.helpers import awkward, empty, words


def test_finds_planted_words_and_grades_them():
    rng = random.Random(5)
    rows, bad = [], []
    for i in range(900):
        text = words(rng, 60, 400)
        n = rng.choice([1, 3, 8]) if i % 6 == 0 else 0
        text += " " + " ".join(rng.choice(["vexo", "grumb"]) + rng.choice(["ing", "ed", "an", "or"]) for _ in range(n))
        rows.append(toxicity.features(text))
        bad.append(int(n > 0))
    model = toxicity.fit(rows[:600], np.array(bad[:600]))
    sums = np.array([sum(model.weights.get(int(x), 0) for x in found) for found in rows[600:]])
    severity = model.expected(sums)
    assert np.mean((severity >= model.cut) == (np.array(bad[600:]) == 1)) > 0.97
    assert list(model.thresholds) == sorted(model.thresholds)
    assert severity.min() >= 0 and severity.max() <= toxicity.GRADES - 1


def test_fit_minimises_the_penalised_likelihood():
    """The objective is written out anew here; no small change of a weight or threshold may lower it."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 12)).astype(np.uint32) for _ in range(300)]
    toxic = np.array([int(rng.random() < (0.8 if (x < 4).any() else 0.15)) for x in rows])
    penalty = 0.01
    model = toxicity.fit(rows, toxic, penalty, steps=4000, least=1, most=100)
    names, score = toxicity.telling(rows, toxic, 1)
    y = toxicity.grades(rows, toxic, names, score)
    assert set(y) == {0, 1, 2, 3} and model.weights
    weight = min(5.0, (y == 0).sum() / (y > 0).sum())

    def objective(weights, thresholds):
        edges = [-np.inf, *thresholds, np.inf]
        total = 0.0
        for x, k in zip(rows, y, strict=True):
            s = sum(weights.get(int(f), 0.0) for f in x)
            below = lambda t: 1 / (1 + np.exp(min(700.0, s - t)))
            total -= (weight if k else 1.0) * np.log(below(edges[k + 1]) - below(edges[k]))
        return total / len(rows) + penalty * sum(map(abs, weights.values()))

    least = objective(model.weights, model.thresholds)
    for step in (0.02, -0.02):
        for f in range(40):
            assert objective({**model.weights, f: model.weights.get(f, 0.0) + step}, model.thresholds) >= least - 1e-6
        for i in range(3):
            assert objective(model.weights, [t + step * (i == j) for j, t in enumerate(model.thresholds)]) >= least - 1e-6
    found = model.expected(np.array([sum(model.weights.get(int(f), 0.0) for f in x) for x in rows[:20]]))
    for x, e in zip(rows, found, strict=False):
        s = sum(model.weights.get(int(f), 0.0) for f in x)
        assert e == pytest.approx(sum(1 - 1 / (1 + np.exp(s - t)) for t in model.thresholds))


def test_awkward_rows_and_missing_labels(spark):
    docs = awkward(spark).withColumnRenamed("lang", "severity")
    labels = spark.createDataFrame([(i, i % 2 if i % 5 else None, 1) for i in range(30)] + [(None, 1, 1), (3, 1, 1)], "doc_id long, toxic int, quality int")
    found = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(found) == docs.count() and all(0 <= r["severity"] <= 3 for r in found)
    nothing = toxicity.train(docs, labels.where("false"))
    assert not any(r["is_toxic"] or r["severity"] for r in toxicity.score(docs, nothing).collect())
    assert toxicity.without_toxic(docs, nothing).count() == docs.count()
    assert toxicity.score(empty(spark), toxicity.train(empty(spark), labels)).count() == 0


@pytest.mark.parametrize("severity, toxic, cut", [([3, 2, 1, 0], [1, 1, 0, 0], 1.5), ([1, 1], [1, 0], 0.5)])
def test_best_cut(severity, toxic, cut):
    assert toxicity.best_cut(np.array(severity, float), np.array(toxic)) == cut
