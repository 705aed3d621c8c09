"""op6's likelihood, gradient and severity against plain Python."""

import math
import random

import numpy as np
import pyarrow as pa

from lexiforge.llm import toxicity


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_loss(p, pairs, grades, m, l2):
    theta = [p[m], p[m] + math.exp(p[m + 1])]
    total = 0.0
    for i, g in enumerate(grades):
        s = sum(p[f] for d, f in pairs if d == i)
        above = [1.0, sigmoid(s - theta[0]), sigmoid(s - theta[1]), 0.0]
        total -= math.log(above[g] - above[g + 1])
    return total / len(grades) + l2 / 2 * sum(x * x for x in p[:m])


def test_likelihood_and_gradient():
    rng = random.Random(7)
    m, n = 6, 25
    pairs = [(d, f) for d in range(n) for f in range(m) if rng.random() < 0.4]
    d, f = (np.array(x) for x in zip(*pairs, strict=True))
    grades = np.array([rng.randrange(3) for _ in range(n)])
    for l2 in (0.0, 0.3):
        p = np.array([rng.uniform(-1, 1) for _ in range(m + 2)])
        loss, slope = toxicity.likelihood(p, d, f, grades, l2)
        assert abs(loss - plain_loss(p, pairs, grades, m, l2)) < 1e-9
        for k in range(m + 2):
            step = np.zeros(m + 2)
            step[k] = 1e-5
            by_steps = (plain_loss(p + step, pairs, grades, m, l2) - plain_loss(p - step, pairs, grades, m, l2)) / 2e-5
            assert abs(slope[k] - by_steps) < 1e-6, k


def test_severity(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    _, hashes, _, _ = toxicity.word_hashes(toxicity.texts(pa.array([" ".join(words)])))
    order = np.argsort(hashes)
    weights = np.array([0.5, 1.25, 2.0, 0.75])
    model = toxicity.Model(hashes[order], weights[order], np.array([0.4, 2.1]), 0.6)
    rows = [(0, "alpha alpha beta"), (1, "gamma delta alpha beta"), (2, ""), (3, None), (4, "other words"), (5, "other " * 400_000 + "gamma"), (0, "alpha alpha beta")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, *r.toxicity) for r in toxicity.grade(d, model).collect()]
    assert len(got) == len(rows)
    for (i, text), (j, severity, grade, chance, toxic) in zip(sorted(rows, key=lambda r: r[0]), sorted(got), strict=True):
        s = sum(w for x, w in zip(words, weights, strict=True) if x in (text or "").split())
        up = [sigmoid(s - 0.4), sigmoid(s - 2.1)]
        assert i == j and abs(severity - sum(up)) < 1e-9 and abs(chance - up[1]) < 1e-9
        assert grade == sum(x >= 0.5 for x in up) and toxic == (up[1] >= 0.6)
