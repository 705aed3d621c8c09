"""BLEU and chrF++ of single pairs in plain Python, which the tests hold the engine's against."""

from __future__ import annotations

import math
import re
from collections import Counter

BLEU_N, CHAR_N, WORD_N, BETA = 4, 6, 2, 2
# The 13a rules' punctuation.
_PUNCT = re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])")
WIDTH = 2 * BLEU_N + 2 + 3 * (CHAR_N + WORD_N)


def tokens_13a(text: str) -> list[str]:
    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(a, b)
    text = _PUNCT.sub(r" \1 ", f" {text} ")
    text = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", text)
    text = re.sub(r"([\.,])([^0-9])", r" \1 \2", text)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()


def _grams(items, n: int) -> Counter:
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def _chrf_words(text: str) -> list[str]:
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in ".,!?;:\"'()":
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in ".,!?;:\"'()":
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


class Grams:
    """A text's counts of each order, which every comparison with another text uses."""

    def __init__(self, text: str | None) -> None:
        tokens = tokens_13a(text or "")
        self.n = len(tokens)
        self.bleu = [_grams(tokens, n) for n in range(1, BLEU_N + 1)]
        chars, words = "".join((text or "").split()), _chrf_words(text or "")
        self.chrf = [*(_grams(chars, n) for n in range(1, CHAR_N + 1)), *(_grams(words, n) for n in range(1, WORD_N + 1))]
        self.sizes = [[x.total() for x in counts] for counts in (self.bleu, self.chrf)]

    def stats(self, ref: Grams) -> list[int]:
        """Matches and totals of each BLEU order, both lengths, then hypothesis, reference and matching grams of each chrF order."""
        out = [*(_common(a, b) for a, b in zip(self.bleu, ref.bleu, strict=True)), *self.sizes[0], self.n, ref.n]
        for a, b, x, y in zip(self.chrf, ref.chrf, self.sizes[1], ref.sizes[1], strict=True):
            out += [x, y, _common(a, b)]
        return out

    def score(self, ref: Grams) -> float:
        """M4."""
        s = self.stats(ref)
        return geo(bleu(s, effective=True), chrf(s))


def _common(a: Counter, b: Counter) -> int:
    """Grams that both have, as often as the one with fewer."""
    if len(a) > len(b):
        a, b = b, a
    get = b.get
    return sum(min(n, get(g, 0)) for g, n in a.items())


def row_stats(hyp: str | None, ref: str | None) -> list[int]:
    return Grams(hyp).stats(Grams(ref))


def bleu(stats, effective: bool = False) -> float:
    match, total, h, r = stats[:BLEU_N], stats[BLEU_N : 2 * BLEU_N], stats[2 * BLEU_N], stats[2 * BLEU_N + 1]
    if not h or not any(match):
        return 0.0
    smooth, logs = 1.0, []
    for m, t in zip(match, total, strict=True):
        if not t:
            if effective:
                break
            return 0.0
        if not m:
            smooth *= 2
        logs.append(math.log(m / t if m else 1 / (smooth * t)))
    brevity = 1.0 if h >= r else math.exp(1 - r / h)
    return 100 * brevity * math.exp(sum(logs) / (len(logs) if effective else BLEU_N))


def chrf(stats) -> float:
    rows = [stats[i : i + 3] for i in range(2 * BLEU_N + 2, WIDTH, 3)]
    rows = [(a, b, m) for a, b, m in rows if a and b]
    if not rows:
        return 0.0
    p = sum(m / a for a, _, m in rows) / len(rows)
    r = sum(m / b for _, b, m in rows) / len(rows)
    return 100 * (1 + BETA**2) * p * r / (BETA**2 * p + r) if p + r else 0.0


def geo(a: float, b: float) -> float:
    return math.sqrt(a * b) if a > 0 and b > 0 else 0.0


def sentence_geo(hyp: str, ref: str) -> float:
    """M4."""
    return Grams(hyp).score(Grams(ref))


def select_candidate(cands, keep_blank=False):
    """The candidate with the best mean score against the others, the earliest on ties."""
    cands = list(dict.fromkeys((c or "").strip() if keep_blank else (c or "") for c in cands))
    if not keep_blank:
        cands = [c for c in cands if c.strip()]
    if len(cands) < 2:
        return cands[0] if cands else ""
    grams = [Grams(c) for c in cands]
    scores = [sum(round(a.score(b) * 1e9) for j, b in enumerate(grams) if j != i) for i, a in enumerate(grams)]
    return cands[scores.index(max(scores))]
