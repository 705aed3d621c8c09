"""op8's benchmark side: passages, the distributed SVD, blocks, short items, very long texts."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexiforge.llm import decontam


def plain_passages(words):
    n, w = len(words), decontam.WINDOW
    at = sorted({*range(0, n - w + 1, decontam.ITEM_STRIDE), n - w}) if n > w else [0][:n]
    return [words[a : a + w] for a in at]


def items_of(rng, sizes, vocabulary):
    return [np.array([rng.randrange(vocabulary) for _ in range(n)]) for n in sizes]


def test_passages_and_their_lengths():
    rng = random.Random(3)
    items = items_of(rng, [1, 5, 12, 13, 14, 40, 57, 2, 90], 9)
    rows, item = decontam.passages(np.concatenate(items), np.array([len(x) for x in items]))
    want = [(j, p) for j, x in enumerate(items) for p in plain_passages(x.tolist())]
    assert [(j, [w for w in r if w >= 0]) for j, r in zip(item.tolist(), rows.tolist(), strict=True)] == want
    weights = np.array([rng.uniform(0.5, 3) for _ in range(9)])
    plain = [math.sqrt(sum((c * weights[w]) ** 2 for w, c in Counter(p).items())) for _, p in want]
    assert np.allclose(decontam.lengths(rows, weights), plain)


@pytest.mark.parametrize("parts", [1, 3])
def test_svd_spans_what_numpy_finds(spark, parts):
    rng = random.Random(4)
    words = np.array(sorted(rng.sample(range(1 << 32), 30)), np.uint32)
    weights = np.array([rng.uniform(0.5, 3) for _ in words])
    items = items_of(rng, [20, 30, 6, 44], len(words))
    dense = []
    for x in items:
        for p in plain_passages(x.tolist()):
            row = np.zeros(len(words))
            for w, c in Counter(p).items():
                row[w] = c * weights[w]
            dense.append(row / np.linalg.norm(row))
    rdd = spark.createDataFrame([(words[x].tobytes(),) for x in items], "words binary").repartition(parts).rdd
    got = decontam.randomised_svd(rdd, words, weights, 5)
    best = np.linalg.svd(np.array(dense))[2][:5]
    assert np.allclose(np.abs(best @ got), np.eye(5), atol=1e-3)  # up to the sign, which is free


def test_blocks_find_what_one_block_finds(spark, monkeypatch):
    """Exact copies, halves that changed places and repeated items, with the benchmark in one block and in many; item ids of two types."""
    rng = random.Random(5)
    items = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(14, 50))) for _ in range(40)]
    noise = lambda: " ".join(f"n{rng.randrange(500)}" for _ in range(40))
    docs = [(k, f"{noise()} {items[k].upper()}! {noise()}") for k in range(0, 40, 2)] + [(100 + k, noise()) for k in range(20)] + [(200, None), (201, "")]
    halves = items[1].split()
    docs.append((300, " ".join([*halves[len(halves) // 2 :], *halves[: len(halves) // 2]])))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(f"i{j}", x) for j, x in enumerate(items)] + [("i0", items[0]), (None, items[3]), ("blank", " \t"), ("none", None)], "item_id string, text string")
    want = {(k, f"i{k}") for k in range(0, 40, 2)} | {(300, "i1")}
    for block in (100_000, 60):
        monkeypatch.setattr(decontam, "BLOCK", block)
        got = [(r.doc_id, r.item_id) for r in decontam.contaminated(spark, d, bench).collect()]
        assert sorted(got) == sorted(want), block
    by_number = spark.createDataFrame([(j, x) for j, x in enumerate(items)], "item_id int, text string")
    got = [(r.doc_id, r.item_id) for r in decontam.contaminated(spark, d, by_number).collect()]
    assert sorted(got) == sorted((k, int(j[1:])) for k, j in want)


def test_short_items(spark):
    """Items of two to four words count where they stand unbroken and in order, at a text's edges too; single words don't by themselves."""
    items = [(2, "Quantum Flux"), (3, "red green blue"), (4, "a bee sees dew"), (1, "lonely")]
    filler = " ".join(f"f{i}" for i in range(30))
    rows = [
        (0, f"{filler} quantum flux, {filler}"),
        (1, f"{filler} quantum of flux {filler}"),
        (2, f"red green blue {filler}"),
        (3, f"{filler} a bee sees dew"),
        (4, f"{filler} bee a sees dew {filler}"),
        (5, f"{filler} lonely {filler}"),
        (6, "flux"),
        (7, "dew"),
        (8, "quantum flux"),
        (9, f"{filler} green blue red {filler}"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(0, 2), (2, 3), (3, 4), (8, 2)}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(spark, d, bench, cosine=1.01).collect()} == want  # without candidates by cosine
    assert want <= {(r.doc_id, r.item_id) for r in decontam.contaminated(spark, d, bench).collect()}


def test_an_item_at_the_end_of_a_very_long_text(spark):
    rng = random.Random(8)
    item = " ".join(f"i{k}" for k in range(30))
    long = " ".join(f"x{rng.randrange(5000)}" for _ in range(500_000))
    assert len(long) > 2 << 20
    d = spark.createDataFrame([(1, f"{long} {item}"), (2, long), (3, f"{item} {long}"), (4, "x" * (3 << 20))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.answered) for r in decontam.contaminated(spark, d, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {(1, 7, True), (3, 7, True)}


def test_words_are_hashed_alike():
    ids, counts = decontam.word_ids(pa.array(["The cat. THE", "", "cat"], pa.string()))
    assert counts.tolist() == [3, 0, 1] and ids[0] == ids[2] and ids[1] == ids[3] != ids[0]
