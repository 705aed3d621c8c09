"""Cross-tokenizer alignment against plain Python over whole texts, odd ones and long ones."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest

from lexiforge.llm import crosstok

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def both():
    return crosstok.Tokenizers(A, B)


def brute(both, rows):
    """Each text encoded whole, every pair of tokens compared by its byte range."""
    made, counts = [], Counter()
    for doc_id, text in rows:
        groups, links = [], []
        if text:
            said = " " + text
            a, b = both.a.encode(said, add_special_tokens=False).ids, both.b.encode(text)
            x, y = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
            if b"".join(x) == said.encode() == b"".join(y):
                ends = sorted(set(accumulate(map(len, x))) & set(accumulate(map(len, y))))
                spans = [[(e - len(t), e, i) for e, t, i in zip(accumulate(map(len, z)), z, ids)] for z, ids in ((x, a), (y, b))]
                at = 0
                for end in ends:
                    of = [[s for s in side if at <= s[0] < end] for side in spans]
                    groups.append(tuple([s[2] for s in side] for side in of))
                    links += [(p[2], q[2]) for p in of[0] for q in of[1] if p[0] < q[1] and q[0] < p[1]]
                    at = end
        made.append((doc_id, groups, links))
        counts.update(links)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for doc_id, groups, links in made:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(counts[p] == top[p[1]] for p in links)
        out.append((doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), best, sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def odd_texts(seed):
    rng = random.Random(seed)
    parts = ["a", "Zebra", "  ", " ", "\n", "\t", "\r\n", "don't", "日本語", "é", "é", "ﬁ", "İß", "👩‍👩‍👧", " ", "　", "▁", "\x00", "\x1c", " ", "<|endoftext|>", "<s>", "<0x0A>", "1234", "!!", "...", "Ġ", "\x85"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(250)]


@pytest.mark.parametrize("kept", [0, 40, 1 << 16])
def test_aligned(spark, both, kept, monkeypatch):
    monkeypatch.setattr(crosstok, "PART", 16)
    rows = [(i, t) for i, t in enumerate(odd_texts(kept))]
    rows += rows[:9] + [(None, "the cat"), (900, None), (901, ""), (902, " "), (903, " \n "), (904, "the the the"), (905, "end \n")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, keys string, row int, n_a int").repartition(5)
    got = crosstok.aligned(spark, df, A, B, kept)
    assert got.columns == NAMES
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(both, rows)


def test_aligned_documents(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute(both, [(r.doc_id, r.text if len(r.text or "") < 20_000 else "") for r in docs.select("doc_id", "text").collect()])
    some = docs.selectExpr("doc_id", "if(length(text) < 20000, text, '') as text")
    assert sorted((tuple(r) for r in crosstok.aligned(spark, some, A, B).collect()), key=str) == want


def test_aligned_nothing(spark):
    assert crosstok.aligned(spark, spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_long_text_in_parts(both):
    """Over 4 MB, cut into parts: the same groups as in one piece."""
    text = " ".join(random.Random(5).choices(["one", "two,", "Über", "日本", "x\ny", "naïve"], k=900_000)) + " \n"
    numbers, hashes, _, counts = crosstok.encoded(crosstok.Interned(both), [text, "one"])
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    assert numbers[0, :2].tolist() == [len(a), len(b)] and sum(counts[0].as_py()) == numbers[0, 2]
    assert hashes[0] == hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups_by_scan(both, a, b)).encode()).hexdigest()


def groups_by_scan(both, a, b):
    i = j = 0
    while i < len(a):
        x, y, n, m = [a[i]], [b[j]], len(both.a_bytes[a[i]]), len(both.b_bytes[b[j]])
        while n != m:
            if n < m:
                i += 1
                x.append(a[i])
                n += len(both.a_bytes[a[i]])
            else:
                j += 1
                y.append(b[j])
                m += len(both.b_bytes[b[j]])
        yield x, y
        i, j = i + 1, j + 1
