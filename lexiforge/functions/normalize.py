"""Normalising of source and target texts: ordered rules as expressions, with NFKC from Arrow for texts that aren't ASCII.

Rules run in order and may undo each other (``{é}`` becomes ``{e2}`` and then ``{é}`` again); the order is part
of the result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.functions.segment import let

# Characters and spellings of the transliteration conventions.
SUBSCRIPTS = ("₀₁₂₃₄₅₆₇₈₉ₓ", "0123456789x")
GLOTTALS = "ʾʿʼʻ'‘’"
HALF_BRACKETS = "˹⸢˺⸣"
DETERMINATIVES = {
    "d": ("d",),
    "ki": ("ki",),
    "m": ("m",),
    "f": ("f", "mi", "munus"),
    "mesh": ("mesh", "meš"),
    "gish": ("gish", "giš", "ĝeš", "geš"),
    "gi": ("gi",),
    "na4": ("na4", "na₄"),
    "urudu": ("urudu",),
    "tug2": ("tug2", "tug₂", "túg"),
    "uru": ("uru",),
    "kur": ("kur",),
    "mul": ("mul",),
    "e2": ("e₂", "é"),
    "dub": ("dub",),
    "id2": ("id₂", "íd"),
    "mushen": ("mušen",),
    "kush": ("kuš",),
    "u2": ("u₂", "ú"),
    "lu2": ("lu₂", "lú"),
}
ACCENTS = {"a": "áà", "e": "éè", "i": "íì", "u": "úù", "A": "ÁÀ", "E": "ÉÈ", "I": "ÍÌ", "U": "ÚÙ"}
MONTHS = {"XIII": "13", "XII": "12", "XI": "11", "X": "10", "IX": "9", "VIII": "8", "VII": "7", "VI": "6", "V": "5", "IV": "4", "III": "3", "II": "2", "I": "1"}
FRACTIONS = {"1/2": "½", "1/3": "⅓", "2/3": "⅔", "1/4": "¼", "3/4": "¾", "1/5": "⅕", "1/6": "⅙", "1/8": "⅛"}
REMARKS = ("fem", "masc", "plur", "sing", "sic", "lit", "var", "obscure", "broken", "damaged", "illegible", "erased", "cf.", "i.e.", "viz.", "sc.")

Rule = Callable[[Column], Column]


def _sub(pattern: str, to: str) -> Rule:
    """Patterns are in Java's spelling: (?U) gives classes and word ends their meaning for all letters."""
    return lambda c: F.regexp_replace(c, pattern, to)


def _delete(chars: str) -> Rule:
    return lambda c: F.translate(c, chars, "")


def _swap(pairs: dict[str, str]) -> Rule:
    def rule(c: Column) -> Column:
        for a, b in pairs.items():
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    return rule


def _all(*rules: Rule) -> Rule:
    def rule(c: Column) -> Column:
        for r in rules:
            c = r(c)
        return c

    return rule


def _where(has: str, rule: Rule) -> Rule:
    """The rule for texts that hold what it needs; others are spared it."""
    return lambda c: let(c, lambda x: F.when(F.contains(x, F.lit(has)), rule(x)).otherwise(x))


def _matching(pattern: str, rule: Rule) -> Rule:
    """The rule, of many patterns, for texts in which one that covers them all is found."""
    return lambda c: let(c, lambda x: F.when(x.rlike(pattern), rule(x)).otherwise(x))


def _quoted(spellings) -> str:
    return "|".join(r"\Q" + s + r"\E" for s in spellings)


_BARE = _sub(r"(?U)^\s+|\s+$", "")
_SPACES = _sub(r"(?U)\s{2,}|[\s&&[^ ]]", " ")  # a blank alone stays as it is
_SIGNS = _all(*[_sub(r"(?iu)\{(?:%s)\}" % _quoted(spellings), "{%s}" % name) for name, spellings in DETERMINATIVES.items()])
_VOWELS = _all(*[_where(v + k, _sub(rf"(?U){v}{k}\b", accented)) for v, two in ACCENTS.items() for k, accented in zip("23", two, strict=True)])
_MONTHS = _all(*[_where(roman, _sub(rf"(?U)([Mm]onth\s+){roman}\b", "$1" + n)) for roman, n in MONTHS.items()])

#: (id of the rule in the inventory, rule) in the order in which they run, behind NFKC.
SOURCE_RULES: list[tuple[str, Rule]] = [
    ("N3", lambda c: F.translate(c, "Ḫḫ", "Hh")),
    ("N4", _delete(GLOTTALS)),
    ("N5", lambda c: F.translate(c, *SUBSCRIPTS)),
    ("N6", _where("{", _matching(r"(?iu)\{(?:%s)\}" % _quoted(s for spellings in DETERMINATIVES.values() for s in spellings), _SIGNS))),
    ("N6", _sub(r"(?U)\bDINGIR\b", "{d}")),
    ("N7", _where("{", _sub(r"(?i)\{(?:large break|big gap)\}", "<big_gap>"))),
    ("N8", _where("…", _sub(r"(?U)\[…\s*…\]|…", "<big_gap>"))),
    ("N9", _where("[", _all(_sub(r"(?U)\[(?:x\s*)+\]", "<gap>"), _sub(r"\[\.{2,}\]", "<gap>")))),
    ("N9", _where("...", _sub(r"\.{3,}", "<gap>"))),
    ("N9", _where("[", _sub(r"(?i)\[(?:broken|damaged|missing)\]", "<gap>"))),
    ("N10", _delete(HALF_BRACKETS)),
    ("N11", _where("<<", _sub(r"<<[^>]*>>", ""))),
    ("N12", _where("[", _sub(r"\[([^\]]*)\]", "$1"))),
    ("N13", _where("<", _sub(r"<(?!gap>|big_gap>)([^>]*)>", "$1"))),
    ("N14", _delete("!?*#")),
    ("N15", _swap({"sz": "š", "SZ": "Š", "s,": "ṣ", "S,": "Ṣ", "t,": "ṭ", "T,": "Ṭ"})),
    ("N16", lambda c: let(c, lambda x: F.when(x.rlike("[aeiuAEIU][23]"), _VOWELS(x)).otherwise(x))),
    ("N17", _where("gap>", _all(_sub(r"(?U)(?:<big_gap>\s*){2,}", "<big_gap> "), _sub(r"(?U)(?:<gap>\s*){2,}", "<gap> "), _sub(r"(?U)(?:<(?:big_)?gap>\s*){2,}", "<big_gap> ")))),
    ("N18", _SPACES),
]
TARGET_RULES: list[tuple[str, Rule]] = [
    ("N20", _where("(", _sub(r"(?iu)\((?:%s)[^)]*\)" % _quoted(REMARKS), ""))),
    ("N21", _where("[", _sub(r"\[([^\]]*)\]", "$1"))),
    ("N21", _where("<", _sub(r"<(?!gap>)([^>]*)>", "$1"))),
    ("N21", _delete(HALF_BRACKETS)),
    ("N22", _where("…", _sub(r"…", "<big_gap>"))),
    ("N22", _where("...", _sub(r"\.{3,}", "<gap>"))),
    ("N23", _sub(r"(?iuU)\b(?:broken|damaged)\b", "<gap>")),
    ("N24", _where("/", _swap(FRACTIONS))),
    ("N25", _where("onth", _matching(r"(?U)[Mm]onth\s+[XVI]", _MONTHS))),
    ("N26", _where("gap>", _sub(r"(?U)(?:<gap>\s*){2,}", "<gap> "))),
    ("N26", _SPACES),
]


@F.arrow_udf(T.StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return pa.array([t if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """ASCII texts aren't sent to Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def apply_rules(text: Column, rules: list[tuple[str, Rule]]) -> Column:
    """Null and blank texts give an empty one."""
    out = nfkc(text)
    for _, rule in rules:
        out = rule(out)
    return F.when(text.rlike(r"(?U)\S"), _BARE(out)).otherwise("")


def clean_source(text: Column) -> Column:
    return apply_rules(text, SOURCE_RULES)


def clean_target(text: Column) -> Column:
    return apply_rules(text, TARGET_RULES)
