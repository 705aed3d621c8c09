"""Each operator on small tables with nulls, empty and odd texts, repeated rows, clashing columns, and none at all."""

import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lexiforge.llm import chat, decontam, lm, mixing, pii, simhash, tokens, topk, toxicity, warc
from lexiforge.llm.common import Workspace
from lexiforge.llm.graph import components
from lexiforge.llm.xxh64 import hash_runs

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(1)
    words = ["alpha", "Beta", "gamma,", "delta.", "épée", "x1", "日本", "don't", " y"]
    rows = [(i, " ".join(random.choice(words) for _ in range(random.randint(0, 60))), "en", f"s{i % 4}", 0) for i in range(60)]
    rows += [(7, rows[7][1], "en", "s3", 0), (100, None, "en", None, 0), (101, "", "de", "s1", 0), (102, " \t\n", "de", "s1", 0), (None, "one two three", "de", "s0", 0), (103, "word " * 3000, "de", "s0", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp long")


def test_hash_runs():
    data = bytes(random.Random(2).randrange(256) for _ in range(4000))
    n = np.arange(0, 400) % 190
    at = np.arange(0, 400) * 9
    assert hash_runs(data, at, n, 42).tolist() == [xxhash.xxh64_intdigest(data[a : a + k], 42) for a, k in zip(at.tolist(), n.tolist())]


def brute_fingerprint(text):
    w = WORDS.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {k: min((rows[i][0] for i in range(len(rows)) if label[i] == k and rows[i][0] is not None), default=None) for k in set(label)}
    want = sorted(((d, f"{f:016x}", least[label[i]]) for i, (d, f) in enumerate(rows)), key=str)
    got = sorted((tuple(r) for r in simhash.simhash_components(spark, docs).collect()), key=str)
    assert got == want
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))


def test_simhash_hot_groups(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (60, 2))}
    ws = Workspace(spark, "test")
    d = spark.createDataFrame([(x if x < 2**63 else x - 2**64,) for x in fps], "fp long")
    roots = {g: {r.node: r.root for r in components(ws, simhash.links(ws, d, group=g), f"c{g}").collect()} for g in (8, 8192)}
    assert roots[8] == roots[8192] and len(set(roots[8].values())) <= 3


def test_store(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id)):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = tokens.store_and_read(spark, docs, TOKENIZER).select("doc_id", "start", "n_tokens", F.crc32("ids")).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    assert tokens.store_and_read(spark, docs.limit(0), TOKENIZER).count() == 0


def test_store_notices_changes(spark, docs, tmp_path):
    path = f"file://{tmp_path}"
    tokens.write_store(spark, docs, path, TOKENIZER)
    packs = tmp_path / "packs"
    name = next(f for f in os.listdir(packs) if f.endswith(".ids"))
    data = bytearray((packs / name).read_bytes())
    data[0] ^= 1
    (packs / name).write_bytes(data)
    for crc in packs.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="Merkle"):
        tokens.read_store(spark, path, 2).collect()


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(TOKENIZER), tokens.Encoder(TOKENIZER)
    random.seed(3)
    texts = ["".join(random.choice("aZé İß'’s. \n\t <|endoftext|>12本ﬁΣ-_&") for _ in range(random.randint(0, 40))) for _ in range(300)]
    ids, n = e.encode(pa.array(texts))
    at = 0
    for text, k in zip(texts, n.tolist(), strict=True):
        assert t.encode(text, add_special_tokens=False).ids == ids[at : at + k].tolist()
        at += k


def test_warc(spark):
    rows = [(3, "http://a/ü x", "<p>é</p>"), (1, None, "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (4, "u", ""), (None, "u", "z")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.write_and_read(spark, d).collect()
    assert sorted(((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str) == sorted(
        [(1, 9, "response", None), (1, 9, "revisit", 1), (3, 9, "revisit", 1), (2, 0, "response", None), (4, 0, "revisit", 2), (-1, 1, "response", None)], key=str
    )
    assert sum(r.record_type == "response" for r in got) == 3
    assert {r.payload_digest for r in got if r.payload_bytes == 0} == {"3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"}
    assert warc.write_and_read(spark, d.limit(0)).count() == 0


def test_warc_payload(spark, tmp_path):
    d = spark.createDataFrame([(i, f"http://x/{i}", "é" * i) for i in range(50)], "page_id long, url string, html string")
    index = warc.write_archives(spark, d, f"file://{tmp_path}")
    got = warc.read_archives(spark, f"file://{tmp_path}", index.filter("page_id % 7 = 0")).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {i: "é" * i for i in range(0, 50, 7)}


def test_chat(spark):
    odd = r"\### Assistant: </turn> &lt; <turn user>" + "\n&amp;"
    rows = [(1, 1, "assistant", odd), (1, 0, "user", odd), (2, 0, "user", None), (2, 0, "user", None), (3, 0, "a<b>", "x"), (None, None, None, None), (4, 0, "assistant", "x" * 100000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(d)
    got = {r.conv_id: r for r in made.select("*", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("segments")).alias("loss")).collect()}
    assert [tuple(x) for x in got[1].t] == [("user", odd), ("assistant", odd)] and got[1].loss == odd and got[1].valid
    assert [tuple(x) for x in got[2].t] == [("user", ""), ("user", "")] and not got[2].valid
    assert [tuple(x) for x in got[3].t] == [("a<b>", "x")] and [tuple(x) for x in got[None].t] == [("", "")]
    assert got[4].loss == "x" * 100000 and sum(s["length"] for s in got[4].segments) == len(got[4].formatted)
    assert chat.format_chats(d.limit(0)).count() == 0


def test_chat_of_many_turns(spark):
    said = [f"é{k}<b>&\U0001f600" for k in range(3001)]
    d = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", x) for k, x in enumerate(said)], "conv_id long, turn long, role string, text string")
    row = chat.format_chats(d).select("*", chat.read_loss(F.col("formatted"), F.col("segments")).alias("loss")).first()
    whole, raw = row.formatted, row.formatted.encode()
    assert row.loss == "".join(said[1::2]) and not row.valid
    at = at_byte = 0
    for x in row.segments:
        assert (x.start, x.first_byte) == (at, at_byte)
        at, at_byte = at + x.length, at_byte + x.bytes
        assert raw[x.first_byte : at_byte].decode() == whole[x.start : at]
    assert (at, at_byte) == (len(whole), len(raw))


def test_pii(spark):
    texts = ["mail a.b-9@Ex.example.com, or 4111 1111 1111 1111; 4111111111111112", "on 2024-02-29 and 31/12/1999 not 2024-13-01", "+1 (017) 555-7713", "97.51.17.173 300.1.1.1", 'token = "04dbebab91ab85687d33"', "", None, "clean, 12.5 and 1,000", "4111111111111111 a.b-9@ex.example.com"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii", F.lit(1))
    got = [r for r in pii.pseudonymise(d).orderBy("doc_id").collect()]
    kinds = [[x["kind"] for x in r.pii] for r in got]
    assert kinds == [["email", "card"], ["date", "date"], ["phone"], ["ip"], ["secret"], [], [], [], ["card", "email"]]
    for r, t in zip(got, texts, strict=True):
        for x in r.pii:
            assert t[x["start"] :].startswith(x["original"]) and len(x["original"]) - len(x["pseudonym"]) in range(-6, 7) and x["original"] not in r.text
    card = got[8].pii[0]["pseudonym"]
    assert got[0].pii[1]["pseudonym"].replace(" ", "") == card and got[0].pii[0]["pseudonym"].lower() == got[8].pii[1]["pseudonym"]
    digits = [int(c) for c in card]
    assert sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(digits))) % 10 == 0
    assert [got[i].text for i in (5, 6, 7)] == ["", None, texts[7]]


def test_pii_of_neighbours(spark):
    phone, card, ip = "+1 (826) 555-4081", "4111 1111 1111 1111", "190.137.223.204"
    cases = [
        ([phone, ip], ["phone", "ip"]),
        ([phone, "2024-02-29"], ["phone", "date"]),
        ([phone, "123-45-6789"], ["phone", "ssn"]),
        ([phone, card], ["phone", "card"]),
        ([phone, phone], ["phone", "phone"]),
        ([card, "123"], ["card", None]),
        (["12", card], [None, "card"]),
        ([card, "5500 0000 0000 0004"], ["card", "card"]),
        ([card, "2024-02-29"], ["card", "date"]),
        (["1234", "2024-02-29", "12345"], [None, "date", None]),
        (["1234 56", "123-45-6789", "1"], [None, "ssn", None]),
        (["+12345678901234567", ip], [None, "ip"]),
        (["2023-02-29", "300.1.1.1", "900-45-6789"], [None, None, None]),
    ]
    d = spark.createDataFrame([(i, " ".join(v)) for i, (v, _) in enumerate(cases)], "doc_id long, text string")
    for r, (v, k) in zip(pii.pseudonymise(d).orderBy("doc_id").collect(), cases, strict=True):
        assert [(x["original"], x["kind"]) for x in r.pii] == [(a, b) for a, b in zip(v, k, strict=True) if b], v
        assert all(x["original"] not in r.text for x in r.pii) and all(a in r.text for a, b in zip(v, k, strict=True) if not b)


def test_feistel_is_a_permutation(spark):
    d = spark.range(1000).select(F.array(*[(F.floor(F.col("id") / 10**k) % 10).cast("int") for k in range(3)]).alias("v"))
    made = d.select(pii.feistel(F.col("v"), F.transform("v", lambda _: F.lit(10)), F.lit("k")).alias("p"))
    assert made.distinct().count() == 1000


def test_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=3)], 0) for i in range(230)]
    rows += [(300, None, 0), (400, [1.0, float("nan"), 0.0], 0), (500, [1.0, None, 0.0], 0), (600, [1e30, 1e30, 1e30], 0), (12, rows[11][1], 0), (None, [1.0, 1.0, 1.0], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    fine = [(i, [int(np.floor(1024 * x)) for x in e]) for i, e, _ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for q, e in fine:
        if q % 100 == 0:
            s = sorted(((max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(e, f)))), c) for c, f in fine if c != q), key=lambda x: (-x[0], x[1]))[:10]
            want += [(q, k + 1, c, v) for k, (v, c) in enumerate(s)]
    got = topk.top_k(spark, d, d.filter("vec_id % 100 = 0")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(spark, d.limit(0), d.limit(0)).count() == 0


def test_mixing(spark, docs):
    got = mixing.mixture(spark, docs).collect()
    assert len(got) == docs.count() and all(r.taken <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [0, r.target, 0])
        by[r.source][0] += r.taken
        by[r.source][2] = max(by[r.source][2], r["size"])
    assert all(abs(taken - target) <= most for taken, target, most in by.values())
    assert abs(sum(t for _, t, _ in by.values()) - sum(r["size"] for r in got)) < 1e-6
    mixed = mixing.mixed(spark, docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mixture(spark, docs.limit(0)).count() == 0 and mixing.mixed(spark, docs.limit(0)).count() == 0


def test_toxicity(spark):
    random.seed(5)
    clean = [f"w{i}" for i in range(200)]
    bad = ["vile", "foul", "rotten", "nasty"]
    rows, labels = [], []
    for i in range(400):
        w = [random.choice(clean) for _ in range(40)]
        if toxic := i % 5 == 0:
            for k in range(random.randint(1, 4)):
                w[random.randrange(40)] = bad[(i + k) % 4] + "!"
        rows.append((i, " ".join(w), 1))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    rows += [(900, None, 1), (901, "", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxicity int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxicity for r in toxicity.graded(spark, d, lab).collect()}
    held = [(i % 5 == 0, got[i]["toxic"]) for i in range(300, 400)]
    assert sum(a == b for a, b in held) >= 98 and not got[900]["toxic"] and not got[901]["toxic"]
    assert got[300]["severity"] > got[301]["severity"] and 0 <= got[300]["severity"] <= 2
    kept = toxicity.clean(spark, d, lab)
    assert kept.columns == d.columns and kept.count() == sum(not x["toxic"] for x in got.values())
    assert toxicity.clean(spark, d, lab.limit(0)).count() == d.count() and toxicity.graded(spark, d.limit(0), lab).count() == 0


def test_decontamination(spark, docs):
    random.seed(6)
    item = [f"b{i}" for i in range(40)]
    other = [f"c{i}" for i in range(25)]
    changed = [w if i % 9 else "changed" for i, w in enumerate(item)]
    rows = [(1000, "before " * 30 + " ".join(item) + " after" * 30, 0), (1001, " ".join(changed), 0), (1002, " ".join(other).upper(), 0), (1003, " ".join(item[:12]) + " z" * 50, 0), (1004, None, 0), (None, "x " * 40, 0)]
    d = docs.select("doc_id", "text", F.lit(0).alias("words")).unionByName(spark.createDataFrame(rows, "doc_id long, text string, words int"))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, None), (4, " ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark, d, bench).collect()}
    assert got == {(1000, 1), (1001, 1), (1002, 2)}
    assert decontam.decontaminated(spark, d, bench).count() == d.count() - 3
    assert decontam.contaminated(spark, d, bench.limit(0)).count() == 0 and decontam.contaminated(spark, d.limit(0), bench).count() == 0


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    random.seed(7)
    idf = np.ones(decontam.BUCKETS, np.float32)
    for _ in range(50):
        a, b = ([random.randrange(5) for _ in range(random.randrange(1, 12))] for _ in range(2))
        assert decontam.Item(np.array(a, np.uint32), idf).common(b) == brute_lcs(a, b)


def test_lm(spark, docs):
    import math
    from collections import Counter

    rows = docs.collect()
    tok = [[*WORDS.findall((r.text or "").translate(LOWER)), "\n"] for r in rows]
    out = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2 for r in rows]
    c = Counter(w for t, o in zip(tok, out, strict=True) if not o for w in t)
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
    want = sorted((len(t), sum(c[w] > 0 for w in t), round(base(t), 6)) for t in tok)
    got, p = lm.scored(spark, docs)
    got = got.collect()
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert lm.score(spark, docs.limit(0)).count() == 0

    # The same from its definition, a token at a time.
    own = [w for _, w in sorted((-k, w) for w, k in c.items() if w != "\n")]
    unit = {"\n": 0} | {w: i + 1 for i, w in enumerate(own)}
    group = lambda w: len(own) + 1 + int(lm.suffix_group(pa.array([w]))[0])

    def plain(tokens):
        ids, total = [unit.get(w, None) if w in unit else group(w) for w in tokens], 0.0
        for t, u in enumerate(ids):
            before = [ids[t - k] if t >= k else 0 for k in (1, 2)]
            far = ids[max(t - 2 - lm.FAR, 0) : max(t - 2, 0)]
            q = p["c"][0] * p["r"][before[0]] + p["c"][1] * p["r"][before[1]]
            if far:
                q = q + p["c"][2] * sum(p["r"][f].astype(float) for f in far) / len(far)
            s = [float(q @ e + b) for e, b in zip(p["e"].astype(float), p["b"], strict=True)]
            total += (s[u] - max(s) - math.log(sum(math.exp(x - max(s)) for x in s))) / math.log(10)
        return total  # every known word is a unit, and an unknown one has all of its group

    by = {(len(t), round(base(t), 6)): plain(t) for t in tok if len(t) < 100}
    for r in got:
        if r.n_tokens < 100:
            assert math.isclose(r.score, by[r.n_tokens, round(r.base_score, 6)], abs_tol=1e-3)


def test_lm_groups(spark):
    """Words beyond the units: shares of a group add up to 1, and rare words are joined with their counts."""
    n, once = np.array([10, 0, 4]), np.array([2, 0, 4])
    unknown, known = lm.group_shares(n, once)
    assert np.allclose(10.0**unknown + np.where(n > 0, 10.0**known * n, 0), 1)
    rng = random.Random(3)
    rows = [(i, " ".join(f"{int(rng.paretovariate(0.5))}{'xy'[i % 2]}" for _ in range(200))) for i in range(60)]  # two languages
    d = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r for r in lm.score(spark, d).collect()}
    lm.HELD, had = 500, lm.HELD
    try:
        less = {r.doc_id: r for r in lm.score(spark, d).collect()}
    finally:
        lm.HELD = had
    for k, r in whole.items():
        assert abs(r.score - less[k].score) < 0.05 * abs(r.score) and abs(r.base_score - less[k].base_score) < 1e-6 and r.n_known == less[k].n_known
    held = [r for r in whole.values() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_nce_gradient():
    rng = np.random.default_rng(8)
    units, n = 7, 5
    noise = rng.random(units) + 0.1
    p = {k: v.astype(np.float64) for k, v in lm.initial(noise / noise.sum()).items()}
    ids = rng.integers(0, units, 40)
    first = np.repeat([0, 25], [25, 15])
    one, two, far = lm.context_of(ids, first, np.array([0, 1, 24, 26, 39]), units)
    assert one.tolist() == [0, ids[0], ids[23], ids[25], ids[38]] and two.tolist() == [0, 0, ids[22], 0, ids[37]]
    assert np.allclose(far.sum(1), [0, 0, 1, 0, 1])
    shares = (one, two, far.astype(np.float64))
    target, drawn = rng.integers(0, units, n), rng.integers(0, units, 6)
    log_noise = np.log(noise)
    _, g = lm.nce_step(p, shares, target, drawn, log_noise)
    for k, x in p.items():
        for at in [tuple(rng.integers(0, s) for s in x.shape) for _ in range(6)]:
            had, losses = x[at], []
            for d in (1e-4, -1e-4):
                x[at] = had + d
                losses.append(lm.nce_step(p, shares, target, drawn, log_noise)[0])
            x[at] = had
            assert abs((losses[0] - losses[1]) / 2e-4 - g[k][at]) < 1e-3


def altered(item, rng, kind):
    """A copy that the acceptance rule accepts, with words that the benchmark doesn't have put in or in place of others."""
    new = lambda: f"o{rng.randrange(10**6)}"
    if kind == "replaced":
        return [new() if i % 5 == 2 else w for i, w in enumerate(item)]
    if kind == "inserted":
        return [x for w in item for x in (w, new())]
    return [new() if i % 3 == 1 and i < len(item) - decontam.ANSWER else w for i, w in enumerate(item)]


def windows(n, stride):
    """Where passages of a text of n words begin."""
    return sorted({*range(0, n - decontam.WINDOW + 1, stride), n - decontam.WINDOW}) if n > decontam.WINDOW else [0][:n]


def test_decontamination_of_altered_copies(spark):
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(12)]
    items = [[rng.choice(shared) if rng.random() < 0.4 else f"w{rng.randrange(400)}" for _ in range(n)] for n in (6, 15, 25, 40, 55)]
    rows = []
    for k in range(30):
        around = [[rng.choice([*shared, f"w{rng.randrange(400)}", f"o{rng.randrange(10**6)}"]) for _ in range(rng.randrange(40))] for _ in range(2)]
        rows.append((k, " ".join([*around[0], *altered(items[k % 5], rng, ("replaced", "inserted", "answered")[k // 5 % 3]), *around[1]])))
    words = [decontam.word_ids(pa.array([" ".join(x)]))[0].tolist() for x in items]
    close, loose = set(), set()
    for d, text in rows:
        ids = decontam.word_ids(pa.array([text]))[0].tolist()
        for j, x in enumerate(words):
            near = ((at - len(x), at + decontam.WINDOW + len(x)) for at in windows(len(ids), decontam.STRIDE))
            for a, b in near:
                part = ids[max(a, 0) : b]
                common = brute_lcs(x, part) / len(x)
                answered = any(part[i : i + decontam.ANSWER] == x[-decontam.ANSWER :] for i in range(len(part)))
                if common >= decontam.COMMON or common >= decontam.WITH_ANSWER and answered:
                    close.add((d, j))
                if common >= decontam.IN_ORDER:
                    loose.add((d, j))
    assert {(k, k % 5) for k in range(30) if k // 5 % 3 != 1} <= close
    bench = spark.createDataFrame([(f"i{j}", " ".join(x)) for j, x in enumerate(items)], "item_id string, text string")
    got = decontam.contaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    found = {(r.doc_id, int(r.item_id[1:])) for r in got}
    assert close <= found <= close | loose and len(got) == len(found) and all(0 < r.cosine <= 1 for r in got)
