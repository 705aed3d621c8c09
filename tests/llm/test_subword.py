"""Subword embeddings: features by plain Python, gradients by differences, held-out accuracy, and odd tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexiforge.llm import subword

MASK = (1 << 64) - 1
P, Q, R = int(subword._P), int(subword._Q), int(subword._R)


def bucket(h):
    h = (h ^ h >> 32) * Q & MASK
    return (h ^ h >> 29) % (subword.BUCKETS - 1) + 1


def mixed(c):
    x = (ord(c) + 1) * P & MASK
    return x ^ x >> 31


def brute(text):
    """Buckets of words, character n-grams and pairs of words, with their numbers."""
    found, ahead = Counter(), 0
    for w in re.findall(r"[^\x20\x09-\x0d]+", text or ""):
        m = [mixed(c) for c in f"<{w}>"]
        whole = sum(x * pow(Q, k, 1 << 64) for k, x in enumerate(m)) & MASK
        found[bucket((whole * R + 1) & MASK)] += 1
        for n in subword.CHARS:
            for i in range(len(m) - n + 1):
                h = 0
                for x in m[i : i + n]:
                    h = (h * Q + x) & MASK
                found[bucket((h * R + (n << 8)) & MASK)] += 1
        found[subword.AGAIN if whole == ahead else bucket((ahead * P & MASK) ^ (whole * R & MASK))] += 1
        ahead = whole
    return found


TEXTS = ["", " \t", "a", "Über  naïve naïve\nnaïve", "日本語 x1 don't !!", "x", "the the cat"]


def test_features():
    got = list(subword.document_features(pa.array([*TEXTS, None]).fill_null("")))
    assert [dict(zip(b.tolist(), n.tolist())) for b, n in got] == [dict(brute(t)) for t in [*TEXTS, None]]


def test_long_texts_go_on_across_parts():
    text = " ".join(["alpha", "beta", "beta", "Gamma"] * 200_000)
    whole = brute(text[:21])
    (b, n), _ = subword.document_features(pa.array([text, "alpha"]))
    got = dict(zip(b.tolist(), n.tolist()))
    assert len(text) > 2 << 20 and got[subword.AGAIN] == 200_000 and set(whole) <= set(got)
    rng = np.random.default_rng(1)
    model = subword.Model(rng.normal(size=subword.BUCKETS), np.ones(subword.BUCKETS, bool), 0.3)
    want = [float(1 / (1 + np.exp(-(0.3 + model.odds[b] @ n / n.sum())))) for b, n in subword.document_features(pa.array([text, "alpha", "x y"]))]
    assert np.allclose(model.scores(pa.array([text, "alpha", "x y"])), want)


def test_gradients():
    rng = np.random.default_rng(2)
    vectors, softmax, bias = rng.normal(size=(30, 4)), rng.normal(size=(2, 4)), rng.normal(size=2)
    size, label = np.array([3, 0, 5]), np.array([1, 0, 0])
    b, w = np.array([1, 4, 7, 1, 2, 4, 8, 29]), np.array([0.5, 0.25, 0.25, 0.2, 0.2, 0.2, 0.2, 0.2])
    loss = lambda v, s, c: subword.step(v, s, c, b, w, size, label)[0]
    _, of_softmax, of_bias, each, of_vectors = subword.step(vectors, softmax, bias, b, w, size, label)
    assert each.tolist() == sorted(set(b.tolist()))
    for array, at, got in [(vectors, (int(k), 2), of_vectors[i, 2]) for i, k in enumerate(each)] + [(softmax, (1, 3), of_softmax[1, 3]), (softmax, (0, 0), of_softmax[0, 0]), (bias, 0, of_bias[0])]:
        kept = array[at]
        array[at] = kept + 1e-6
        up = loss(vectors, softmax, bias)
        array[at] = kept - 1e-6
        down = loss(vectors, softmax, bias)
        array[at] = kept
        assert abs((up - down) / 2e-6 - got) < 1e-6


def tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return d, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    rows = subword.scored(spark, docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 80 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    poor = [r for r in rows if r.quality == 0]
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.97 and sum(r.predicted == 0 for r in poor) / len(poor) >= 0.8


def test_held_out_labels_and_other_columns_count_for_nothing(spark):
    docs, labels = tables(spark)
    some = docs.filter("doc_id < 300")
    held = labels.filter("crc32(cast(doc_id as string)) % 3 = 1").selectExpr("doc_id", "1 - quality as quality")
    other = labels.filter("crc32(cast(doc_id as string)) % 3 <> 1").select("doc_id", "quality").unionByName(held)
    clash = some.selectExpr("doc_id", "text", "'zz' as lang", "'q' as source", "1 as score", "2 as `order`", "3 as label")
    a, b = (sorted(map(tuple, subword.scored(spark, d, x, drawn=300).collect())) for d, x in ((some, labels), (clash, other)))
    assert a == b


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "good words here"), (1, "good words here"), (2, None), (None, "x"), (4, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 1), (9, 0)], "doc_id long, quality int")
    got = subword.scored(spark, docs, labels)
    rows = got.collect()
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0.5 and r.predicted == 1 for r in subword.scored(spark, docs, labels.limit(0)).collect())
    assert subword.scored(spark, docs.limit(0), labels).count() == 0
    with pytest.raises(Exception, match="quality"):
        subword.scored(spark, docs, labels.drop("quality"))
