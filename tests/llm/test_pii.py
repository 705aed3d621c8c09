"""op5 against plain Python: the Feistel rounds by hashlib, cards by loops over groups of digits, texts of digits alone."""

import datetime
import hashlib
import random
import re
import time

import regex
from pyspark.sql import functions as F

from lexiforge.llm import pii

KEY = "a key of the test"


def shifted(values, radices, key):
    v = list(values)
    half = len(v) // 2
    for r in range(pii.ROUNDS):
        mine, other = (range(half), v[half:]) if r % 2 == 0 else (range(half, len(v)), v[:half])
        h = hashlib.sha512("|".join([key, str(r), ",".join(map(str, other))]).encode()).hexdigest()
        for n, i in enumerate(mine):
            part = h if n < 32 else hashlib.sha512(f"{h}|{n // 32}".encode()).hexdigest()
            v[i] = (v[i] + int(part[4 * (n % 32) : 4 * (n % 32) + 4], 16)) % radices[i]
    return v


def refill(text, digits):
    it = iter(digits)
    return re.sub("[0-9]", lambda _: str(next(it)), text)


def luhn(digits):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(digits)))


def permuted(text, key, upto):
    kinds = [(48, 10), (97, 26), (65, 26)]
    at = [(i, b, r) for i, c in enumerate(text[:upto]) for b, r in kinds if b <= ord(c) < b + r]
    new = shifted([ord(text[i]) - b for i, b, _ in at], [r for _, _, r in at], key)
    out = list(text)
    for (i, b, _), n in zip(at, new, strict=True):
        out[i] = chr(b + n)
    return "".join(out)


def renamed(kind, v, key):
    key = f"{key}|{kind}"
    digits = [int(c) for c in v if "0" <= c <= "9"]
    if kind == "card":
        new = shifted(digits[:-1], [10] * (len(digits) - 1), key)
        return refill(v, [*new, next(c for c in range(10) if luhn([*new, c]) % 10 == 0)])
    if kind == "ip":
        return ".".join(map(str, shifted([int(x) for x in v.split(".")], [256] * 4, key)))
    if kind == "date":
        iso = v[4] == "-"
        day = datetime.date(*(int(x) for x in (v.split("-") if iso else re.split("[./]", v)[::-1])))
        at = day.toordinal() - 1
        size = pii.WINDOW[0] * pii.WINDOW[1]
        w = min(at // size, pii.WINDOWS)
        radix = pii.WINDOW if w < pii.WINDOWS else pii.LAST_WINDOW
        a, b = shifted(divmod(at - w * size, radix[1]), radix, f"{key}|{w}")
        new = datetime.date.fromordinal(w * size + a * radix[1] + b + 1)
        return new.isoformat() if iso else v[2].join(new.isoformat().split("-")[::-1])
    if kind == "ssn":
        a, g, n = (int(x) for x in v.split("-"))
        a, g, n = shifted([a - 1 - (a > 666), g - 1, n - 1], [898, 99, 9999], key)
        return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{n + 1:04d}"
    if kind == "phone":
        text = "".join(map(str, digits))
        code = 1 if re.match(pii.CODES_OF_ONE, text) else 2 if re.match(pii.CODES_OF_TWO, text) else 3
        rest = digits[code:]
        return refill(v, digits[:code] + shifted(rest, [10] * len(rest), f"{key}|{text[:code]}"))
    if kind == "email":
        return permuted(v, key, v.rindex(".") + 1)
    head = re.match("[^\"']*[\"']", v).group()
    return head + permuted(v[len(head) : -1], key, len(v)) + v[-1]


def cards_of(text):
    """(start, end) of all cards, the longest at the first place first."""
    g = [m.span() for m in re.finditer("[0-9]+", text)]
    out, i = [], 0
    while i < len(g):
        best = None
        for k in range(i, len(g)):
            if k > i and text[g[k - 1][1] : g[k][0]] not in (" ", "-"):
                break
            digits = [int(c) for c in text[g[i][0] : g[k][1]] if c not in " -"]
            if len(digits) > 19:
                break
            if len(digits) >= 13 and luhn(digits) % 10 == 0:
                best = k
        if best is not None:
            out.append((g[i][0], g[best][1]))
            i = best
        i += 1
    return out


def brute(text, key):
    """(text with pseudonyms, [(kind, start, original, pseudonym)])."""
    kinds = {k: regex.compile(p) for k, p in pii.PATTERNS.items()}
    spans, last = [], 0
    for m in [*regex.finditer(pii.PATTERN, text), None]:
        stop = m.start() if m else len(text)
        spans += [(last + a, last + b, "card") for a, b in cards_of(text[last:stop])]
        if m:
            spans.append((*m.span(), next(k for k, p in kinds.items() if p.fullmatch(m.group()))))
            last = m.end()
    found = [(k, a, text[a:b], renamed(k, text[a:b], key)) for a, b, k in spans]
    out, last = [], 0
    for _, a, v, new in found:
        out += [text[last:a], new]
        last = a + len(v)
    return "".join([*out, text[last:]]), found


def values(rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = [int(c) for c in d(rng.randrange(12, 19))]
    card += [next(c for c in range(10) if luhn([*card, c]) % 10 == 0)]
    day = datetime.date.fromordinal(rng.randrange(1, 3652060)).isoformat()
    card = "".join(map(str, card))
    made = [card, f"{card[:4]} {card[4:8]}-{card[8:]}", d(4), d(16), f"{d(3)} {d(5)} {d(6)}", day, "/".join(day.split("-")[::-1]), f"{rng.randrange(1, 666):03d}-12-{d(3)}1", f"+49 {d(3)} {d(4)} {d(3)}", f"+1{d(9)}", f"x{d(2)}.Y@ab{d(1)}.example.com", f'Password: "s{d(40)}Z!"', "10.2.255.8", "300.1.1.1", "2023-02-29", "word", "π,"]
    return rng.choice(made)


def agree(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.text, [tuple(x) for x in r.pii]) for r in pii.pseudonymise(d, KEY).collect()}
    want = {i: (t, []) if t is None else brute(t, KEY) for i, t in rows}
    assert got == want
    return sum(len(v) for _, v in want.values())


def test_mixed_values(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([" ", "  ", ", ", "-"]).join(values(rng) for _ in range(rng.randrange(0, 14)))) for i in range(400)]
    assert agree(spark, [*rows, (900, None), (901, ""), (902, rows[3][1])]) > 1000


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert agree(spark, [tuple(r) for r in docs.collect()]) > 0


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string, _found int, PII string")
    assert pii.pseudonymise(d, KEY).columns == ["doc_id", "text", "_found", "pii"] and pii.pseudonymise(d, KEY).count() == 0


def test_long_texts_of_digits(spark):
    """Single digits, cards behind cards, and a text over 2 MB, in linear time."""
    rng = random.Random(6)
    single = " ".join(rng.choice("0123456789") for _ in range(20_000))
    rows = [(0, single), (1, "4111 1111 1111 1111, " * 3000), (2, "7" * 100_000), (3, "12-" * 20_000)]
    assert agree(spark, rows) > 3000
    start = time.time()
    d = spark.createDataFrame([(0, " ".join([single] * 5) + " word" * 400_000)], "doc_id long, text string")  # 2 MB, 100,000 digits
    got = pii.pseudonymise(d, KEY).select(F.size("pii").alias("n"), F.length("text").alias("m")).head()
    assert got.n > 1000 and got.m == 2_199_999
    assert time.time() - start < 120
