"""Pair and text filters as Column predicates. The thresholds of the presets are fixed values and differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words whose presence marks English.
ENGLISH = (
    "the ", " of ", " and ", " to ", " in ", " is ", " he ", " she ",
    " his ", " her ", " they ", " with ", " for ", " this ", " that ",
    " from ", " have ", " has ", " not ", " but ", " which ", " who ",
)


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def length_ok(src: Column, tgt: Column) -> Column:
    """Q1."""
    s, t = F.length(src), F.length(tgt)
    return s.between(5, 2000) & t.between(5, 1000) & ratio(s, t).between(0.1, 6.0)


def gap_ratio(text: Column) -> Column:
    """Q2: five characters count for each gap mark; a null or empty text is all gap."""
    n = F.regexp_count(text, F.lit("<gap>|<big_gap>"))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 1.0).otherwise(5 * n / F.greatest(F.length(text), F.lit(1)))


def looks_english(text: Column) -> Column:
    """Q3."""
    n = F.length(text)
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    low, marked = F.lower(text), F.lit(False)
    for m in ENGLISH:
        marked = marked | F.contains(low, F.lit(m))
    return F.coalesce((n >= 5) & (letters / n >= 0.3) & ((n < 30) | marked), F.lit(False))


def repetitive(text: Column) -> Column:
    """Q4: true for texts to drop, words being the same in any case. Null texts aren't."""
    w = words(F.lower(text))
    return F.coalesce((F.length(text) >= 20) & (F.size(w) >= 4) & (F.try_divide(F.size(F.array_distinct(w)), F.size(w)) < 0.2), F.lit(False))


def pair_by_chars(src: Column, tgt: Column) -> Column:
    """Q5: false for null and empty sides."""
    s, t = F.length(src), F.length(tgt)
    return F.coalesce((s >= 5) & (t >= 5) & F.try_divide(s, t).between(0.1, 8.0), F.lit(False))


def pair_by_words(src: Column, tgt: Column) -> Column:
    """Q6: only ``<gap>`` counts, in any case. False for null and blank sides."""
    s, t = F.size(words(src)), F.size(words(tgt))
    gaps = F.regexp_count(src, F.lit("(?i)<gap>"))
    ok = (F.length(src) >= 5) & (F.length(tgt) >= 5) & F.try_divide(s, t).between(0.1, 8.0) & (gaps / F.greatest(s, F.lit(1)) <= 0.7)
    return F.coalesce(ok, F.lit(False))


def reply_pair(src: Column, tgt: Column) -> Column:
    """Q7."""
    return (F.length(F.trim(src)) > 3) & (F.length(F.trim(tgt)) > 3)


def hyphenated(text: Column, least: int = 3) -> Column:
    """Q8: words of three hyphenated parts or more."""
    return F.regexp_count(text, F.lit(r"(?:[a-zA-ZšŠṣṢṭṬḫḪ][a-zA-ZšŠṣṢṭṬḫḪ0-9]*-){2,}[a-zA-ZšŠṣṢṭṬḫḪ0-9]+")) >= least
