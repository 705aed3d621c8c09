"""op2's scores from their definition where words share groups, and how many tokens a round takes."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexiforge.llm import lm


def test_a_share_of_one_takes_every_token():
    for n in (1, 127, 128, 12_799, 12_801, 204_800, 204_801, 3_000_001):
        for first in (True, False):
            steps, size = lm.plan_steps(n, 1.0, first)
            assert steps * size >= n and size <= lm.BATCH
    steps, size = lm.plan_steps(10_000_000, lm.SHARE, True)
    assert abs(steps * size - lm.SHARE * 10_000_000) <= size


@pytest.mark.parametrize("share", [lm.SHARE, 1.0])
def test_scores_with_groups(spark, monkeypatch, share):
    """Three words are units of their own, the counts of six are held by workers, those of all others joined."""
    monkeypatch.setattr(lm, "OWN", 3)
    monkeypatch.setattr(lm, "HELD", 6)
    rng = random.Random(12)
    common = ["the", "of", "and", "walking", "talking", "nation", "station", "ration", "x1", "épée"]
    rows = [(i, " ".join(rng.choices(common, weights=range(20, 0, -2), k=rng.randrange(1, 40)) + [f"once{i}tion"])) for i in range(50)] + [(51, None), (52, "")]
    tok = {i: [*(t or "").split(), "\n"] for i, t in rows}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tok}
    c = Counter(w for i, t in tok.items() if not out[i] for w in t)
    own = [w for _, w in sorted((-k, w) for w, k in c.items() if w != "\n")][:3]
    group = lambda w: int(lm.suffix_group(pa.array([w]))[0])
    total, once = Counter(), Counter()
    for w, k in c.items():
        if w not in (*own, "\n"):
            total[group(w)] += k
            once[group(w)] += k == 1

    scores, p = lm.scored(spark, spark.createDataFrame(rows, "doc_id long, text string"), share)
    got = {r.doc_id: r for r in scores.collect()}

    def unit(w):
        return 0 if w == "\n" else own.index(w) + 1 if w in own else len(own) + 1 + group(w)

    def within(w):
        if w in (*own, "\n"):
            return 1.0
        unknown = (once[group(w)] + 0.5) / (total[group(w)] + 1) if total[group(w)] else 1.0
        return c[w] / total[group(w)] * (1 - unknown) if c[w] else unknown

    assert any(out[i] and any(not c[w] for w in t) for i, t in tok.items())
    for i, tokens in tok.items():
        ids, want = [unit(w) for w in tokens], 0.0
        for t, (u, w) in enumerate(zip(ids, tokens, strict=True)):
            before = [ids[t - k] if t >= k else 0 for k in (1, 2)]
            far = ids[max(t - 2 - lm.FAR, 0) : max(t - 2, 0)]
            q = p["c"][0] * p["r"][before[0]] + p["c"][1] * p["r"][before[1]]
            if far:
                q = q + p["c"][2] * sum(p["r"][f].astype(float) for f in far) / len(far)
            s = [float(q @ e + b) for e, b in zip(p["e"].astype(float), p["b"], strict=True)]
            want += (s[u] - max(s) - math.log(sum(math.exp(x - max(s)) for x in s))) / math.log(10) + math.log10(within(w))
        assert math.isclose(got[i].score, want, abs_tol=1e-3), i
        assert got[i].n_known == sum(c[w] > 0 for w in tokens) and got[i].n_tokens == len(tokens)


def test_rounds_take_every_token_once():
    for n, size in ((1, 128), (127, 128), (3_000, 128), (524_288, 1_747), (1_000_001, 2_048)):
        begins = [b for k in range(len(lm.RATES)) for b in lm.round_blocks(n, size, lm.SHARE, k, np.random.default_rng([7, n])).tolist()]
        assert sorted(begins) == list(range(0, n, size))
        assert sorted(lm.round_blocks(n, size, 1.0, 2, np.random.default_rng(1)).tolist()) == list(range(0, n, size))


def test_gradient_of_a_run_is_that_of_its_tokens():
    rng, units = np.random.default_rng(4), 11
    noise = rng.random(units) + 0.1
    p = {k: v.astype(np.float64) for k, v in lm.initial(noise / noise.sum()).items()}
    ids, first = rng.integers(0, units, 120), np.repeat([0, 3, 4, 50], [3, 1, 46, 70])
    drawn, times = np.unique(rng.integers(0, units, 9), return_counts=True)
    for lo, hi in ((0, 120), (0, 2), (3, 4), (20, 60), (49, 51), (70, 120)):
        at = np.arange(lo, hi)
        one, two, far = lm.context_of(ids, first, at, units)
        _, want = lm.nce_step(p, (one, two, far.astype(np.float64)), ids[at], np.repeat(drawn, times), np.log(noise))
        got = lm.run_gradient(p, ids, first, lo, hi, drawn, times, np.log(noise))
        assert all(np.allclose(got[k], want[k], atol=1e-7) for k in want)


def chances(p, ids, first):
    """log10 of each token's unit from the definition."""
    out = []
    for t, u in enumerate(ids):
        before = [ids[t - k] if t - k >= first[t] else 0 for k in (1, 2)]
        far = ids[max(t - 2 - lm.FAR, first[t]) : max(t - 2, first[t])]
        q = p["c"][0] * p["r"][before[0]] + p["c"][1] * p["r"][before[1]]
        if len(far):
            q = q + p["c"][2] * p["r"][far].mean(0)
        s = p["e"] @ q + p["b"]
        out.append((s[u] - s.max() - math.log(np.exp(s - s.max()).sum())) / math.log(10))
    return np.array(out)


@pytest.mark.parametrize("strength, by_products", [(1, True), (4, True), (12, False)])
def test_only_heads_of_texts_are_scored_by_vectors(monkeypatch, strength, by_products):
    """Behind the first FAR + 2 tokens of a text chances come from products of factors, unless these could leave double's range."""
    rng, units = np.random.default_rng(9), 23
    p = lm.initial(np.full(units, 1 / units))
    p = {k: (v * strength * 3 if k in "re" else v + rng.normal(0, 1, v.shape).astype(np.float32)) for k, v in p.items()}
    sizes = [1, 17, 18, 19, 20, 700, 2, 1500, 37, 5]
    ids, first = rng.integers(0, units, sum(sizes)), np.repeat(np.cumsum(sizes) - sizes, sizes)
    taken, heads = [], lm.head_chances
    monkeypatch.setattr(lm, "head_chances", lambda p, i, *rest: (taken.append(len(i)), heads(p, i, *rest))[1])
    monkeypatch.setattr(lm, "ROWS", 64)
    want = chances({k: v.astype(np.float64) for k, v in p.items()}, ids, first)
    assert np.allclose(lm.log_chances(p, ids, first), want, rtol=1e-4, atol=1e-4 * strength)
    spread = sum((x.max(1) - x.min(1)).max() / 2 for x in lm.parts_of_scores(p))
    assert (spread > 80) == (strength > 1) and (spread > 650) == (not by_products)
    assert taken == [sum(min(n, lm.FAR + 2) for n in sizes) if by_products else len(ids)]
    assert np.allclose(lm.log_chances(p, ids[:37], np.repeat([0, 1, 18, 36], [1, 17, 18, 1])), chances(p, ids[:37], np.repeat([0, 1, 18, 36], [1, 17, 18, 1])), rtol=1e-3, atol=1e-3)
    assert len(lm.log_chances(p, ids[:0], first[:0])) == 0


def test_gradient_of_runs_of_short_and_long_texts():
    rng, units = np.random.default_rng(6), 11
    noise = rng.random(units) + 0.1
    p = {k: v.astype(np.float64) * (3 if k == "r" else 1) for k, v in lm.initial(noise / noise.sum()).items()}
    sizes = [2, 1, 90, 3, 4, 5, 18, 19, 33, 1, 1, 200]
    ids, first = rng.integers(0, units, sum(sizes)), np.repeat(np.cumsum(sizes) - sizes, sizes)
    drawn, times = np.unique(rng.integers(0, units, 9), return_counts=True)
    for lo, hi in [(0, len(ids)), (0, 1), *((a, min(a + n, len(ids))) for n in (1, 7, 64) for a in range(0, len(ids), n))]:
        at = np.arange(lo, hi)
        one, two, far = lm.context_of(ids, first, at, units)
        _, want = lm.nce_step(p, (one, two, far.astype(np.float64)), ids[at], np.repeat(drawn, times), np.log(noise))
        got = lm.run_gradient(p, ids, first, lo, hi, drawn, times, np.log(noise))
        assert all(np.allclose(got[k], want[k], atol=1e-7) for k in want), (lo, hi)


def test_gradient_where_noise_is_certain_or_impossible():
    """Scores far beyond exp's bounds in either direction give chances of 1 and 0, neither a warning nor NaN."""
    units = 5
    p = lm.initial(np.full(units, 0.2))
    p["b"] = np.array([0, 500, -500, 90, -90], np.float32)
    with np.errstate(all="raise", under="ignore"):
        g = lm.run_gradient(p, np.arange(40) % units, np.zeros(40, int), 0, 40, np.arange(units), np.full(units, 2), np.zeros(units, np.float32))
    assert all(np.isfinite(x).all() for x in g.values())
    assert np.allclose(g["b"][[1, 3]], 2, atol=1e-2) and np.allclose(g["b"][[2, 4]], -0.2, atol=1e-2)


def test_small_corpora_train_alike_however_files_lie(spark, monkeypatch):
    """How many words workers hold changes the size of files, and so their order, but not what is learned."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"{int(rng.paretovariate(0.5))}{'xy'[i % 2]}" for _ in range(200))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    p = lm.scored(spark, d)[1]
    monkeypatch.setattr(lm, "HELD", 500)
    other = lm.scored(spark, d.repartition(3))[1]
    assert all(np.array_equal(p[k], other[k]) for k in p)
