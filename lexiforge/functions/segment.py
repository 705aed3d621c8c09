"""Splitting texts and sharing words out between segments, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiforge.functions.quality import words

# Letters that open an English sentence, and words that open a source clause.
CAPITALS = "A-ZÁÉÍÓÚÀÈÌÒÙÄËÏÖÜÑĀ-ɏ"
OPENERS = ("KIŠIB", "IGI", "li-mu", "um-ma")


def let(value: Column, f) -> Column:
    """f(value), with value worked out once; inside a lambda Spark would work it out at each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _parts(pieces: Column) -> Column:
    stripped = F.transform(pieces, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(stripped, lambda p: p != "")


def sentences(text: Column) -> Column:
    """A3: behind a full stop before a capital, then at line ends."""
    return _parts(F.flatten(F.transform(F.split(text, r"(?<=\.)(?U)\s+(?=[A-Z])"), lambda p: F.split(p, "\n"))))


def english_clauses(text: Column) -> Column:
    """Behind ``.!?:`` before a capital."""
    flat = F.regexp_replace(F.regexp_replace(text, r'(?U)^[\s"]+|[\s"]+$', ""), r"(?U)\s+", " ")
    return _parts(F.split(flat, rf"(?<=[.!?:])\s+(?=[{CAPITALS}])"))


def source_clauses(text: Column) -> Column:
    """Before the words that open a clause, white space being single blanks."""
    flat = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return _parts(F.split(flat, rf"(?iuU)(?=\b(?:{'|'.join(OPENERS)})\b)"))


def proportional_counts(n: Column, weights: Column) -> Column:
    """A4: n words by weight, one each at least, rounded half to even.

    Too many words are taken back from the first largest count while one is over 1; missing ones go to the first least.
    So with fewer words than weights all counts are 1, and the last ones have no words left.
    """
    total = lambda w: F.greatest(F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))
    share = lambda w, t: F.transform(w, lambda x: F.greatest(F.lit(1), F.bround(n * x / t, 0).cast("int")))

    def repair(counts: Column) -> Column:
        return let(F.aggregate(counts, F.lit(0), lambda a, x: a + x) - n, lambda diff: move(counts, diff))

    def move(counts: Column, diff: Column) -> Column:
        steps = F.when(diff == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.abs(diff).cast("int")))
        edge = lambda c: F.when((diff > 0) & (F.array_max(c) <= 1), F.lit(0).cast("long")).otherwise(F.array_position(c, F.when(diff > 0, F.array_max(c)).otherwise(F.array_min(c))))
        by = F.when(diff > 0, -1).otherwise(1)
        one = lambda c, _: let(edge(c), lambda at: F.transform(c, lambda x, i: F.when(i + 1 == at, x + by).otherwise(x)))
        return F.aggregate(steps, counts, one)

    return let(weights, lambda w: let(total(w), lambda t: let(share(w, t), repair)))


def slices(tokens: Column, counts: Column) -> Column:
    """Consecutive runs of counts[i] tokens, joined by a space."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,n:int>>").alias("out"))
    add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + 1).alias("a"), x.alias("n")))).alias("out"))
    spans = F.aggregate(counts, zero, add, lambda s: s["out"])
    return let(tokens, lambda t: F.transform(spans, lambda x: F.array_join(F.slice(t, x["a"], F.greatest(x["n"], F.lit(0))), " ")))


def proportional_segments(src: Column, tgt: Column) -> Column:
    """A4: array<struct<src, tgt>> of a document's words shared out over its sentences by their characters.

    Segments without words are left out. A blank side gives none.
    """
    def many(tokens: Column, parts: Column) -> Column:
        counts = proportional_counts(F.size(tokens), F.transform(parts, lambda p: F.greatest(F.length(p), F.lit(1)).cast("long")))
        return F.filter(F.arrays_zip(slices(tokens, counts).alias("src"), parts.alias("tgt")), lambda x: x["src"] != "")

    none = F.array().cast("array<struct<src:string,tgt:string>>")
    one = lambda t, p: F.array(F.struct(F.array_join(t, " ").alias("src"), p[0].alias("tgt")))
    choose = lambda t, p: F.when((F.size(t) == 0) | (F.size(p) == 0), none).when(F.size(p) > 1, many(t, p)).otherwise(one(t, p))
    made = let(words(src), lambda t: let(sentences(tgt), lambda p: choose(t, p)))
    return F.when(src.isNull() | tgt.isNull(), none).otherwise(made)


def word_share_segments(src: Column, parts: Column) -> Column:
    """Words by the parts' word counts, rounded half to even, the last part taking the rest; empty runs are dropped."""
    def share(tokens: Column, sizes: Column) -> Column:
        n = F.size(tokens)
        total = F.greatest(F.aggregate(sizes, F.lit(0), lambda a, x: a + x), F.lit(1))
        counts = let(total, lambda t: F.transform(sizes, lambda x: F.greatest(F.lit(1), F.bround(x / t * n, 0).cast("int"))))
        # The last part takes the rest: whatever is left behind the others.
        return let(counts, lambda c: F.concat(F.slice(c, F.lit(1), F.size(c) - 1), F.array(F.greatest(n, F.lit(0)))))

    sizes = F.transform(parts, lambda p: F.size(words(p)))
    runs = let(words(src), lambda t: let(sizes, lambda s: slices(t, share(t, s))))
    made = F.arrays_zip(runs.alias("src"), parts.alias("tgt"))
    return F.filter(made, lambda x: x["src"] != "")
