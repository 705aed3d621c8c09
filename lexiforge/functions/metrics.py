"""Corpus and sentence BLEU and chrF++ from n-grams that Spark counts.

BLEU: order 4, 13a tokens, exponential smoothing; sentence BLEU uses the orders that a sentence has.
chrF++: character order 6 without white space, word order 2, beta 2. The grams that two texts share are counted within their row, as a set and then those that both
repeat; no gram is shuffled. Texts are dealt out evenly first, as the work on them is much more than reading them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiforge.functions.arrays import let, places
from lexiforge.operators.select import free_name

BLEU_N, CHAR_N, WORD_N, BETA = 4, 6, 2, 2
#: The families of grams: tokens for BLEU, characters and words for chrF++, each with its orders.
KINDS = [("t", n) for n in range(1, BLEU_N + 1)] + [("c", n) for n in range(1, CHAR_N + 1)] + [("w", n) for n in range(1, WORD_N + 1)]
# The 13a rules, what they unescape and what they set apart, and the marks that chrF++ takes off a word's end or start.
UNESCAPED = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
APART = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
MARKS = ".,!?;:\"'()"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def tokens_13a(text: Column) -> Column:
    for a, b in UNESCAPED:
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for a, b in APART:
        text = F.regexp_replace(text, a, b)
    return _words(text)


def chrf_words(text: Column) -> Column:
    """Words, with one mark at the end, or else at the start, set apart."""
    mark = "[" + "".join("\\" + m for m in MARKS) + "]"
    spaced = F.regexp_replace(F.array_join(_words(text), " "), rf"(?<=[^ ])({mark})(?= |$)", "\u0001$1")
    spaced = F.regexp_replace(spaced, rf"(?<=^| )({mark})(?=[^ \u0001]+(?: |$))", "$1\u0001")
    return F.split(F.replace(spaced, F.lit("\u0001"), F.lit(" ")), " ")


def _chars(text: Column) -> Column:
    return F.filter(F.split(F.array_join(_words(text), ""), ""), lambda c: c != "")


def units(text: Column) -> Column:
    """What the grams of each family are made of: struct<t, c, w>."""
    t = F.coalesce(text, F.lit(""))
    of_words = F.filter(chrf_words(t), lambda w: w != "")
    return F.struct(tokens_13a(t).alias("t"), _chars(t).alias("c"), of_words.alias("w"))


def size(x: Column, kind: str, n: int) -> Column:
    """How many grams of a kind and order."""
    return F.greatest(F.size(x[kind]) - (n - 1), F.lit(0)).cast("long")


def _longer(g: Column, first: Column, kind: str, n: int) -> Column:
    """The grams of order n from those of the order below, with a unit more each."""
    kept = F.greatest(F.size(first) - (n - 1), F.lit(0))
    between = "" if kind == "c" else "\u0001"
    return F.zip_with(F.slice(g, F.lit(1), kept), F.slice(first, F.lit(n), kept), lambda a, b: F.concat(a, F.lit(between), b))


def _repeated(ordered: Column) -> Column:
    """array<struct<g, n>> of sorted grams: those that stand there more than once, and how many more times."""
    more = F.filter(ordered, lambda g, i: g == F.get(ordered, i - 1))
    starts = lambda m: places(F.transform(m, lambda g, i: ~g.eqNullSafe(F.get(m, i - 1))))
    runs = lambda m: let(starts(m), lambda s: F.transform(s, lambda at, k: F.struct(F.get(m, at).alias("g"), (F.coalesce(F.get(s, k + 1), F.size(m)) - at).alias("n"))))
    return let(more, runs)


def profile(x: Column) -> Column:
    """array<struct<all, more>> over KINDS of a text's units: its grams, and those it has more than once with how many times more."""
    out = []
    for kind, most in (("t", BLEU_N), ("c", CHAR_N), ("w", WORD_N)):

        def of(g: Column, n: int, kind: str = kind, most: int = most) -> Column:
            own = F.array(F.struct(g.alias("all"), let(F.sort_array(g), _repeated).alias("more")))
            further = lambda h: of(h, n + 1, kind, most)
            return own if n == most else F.concat(own, let(_longer(g, x[kind], kind, n + 1), further))

        out.append(of(x[kind], 1))
    return F.concat(*out)


def common(a: Column, b: Column) -> Column:
    """How many grams two texts share in one order, each as often as the one with fewer has it.

    Each shared gram counts once, and those that both have more than once as often again as the one with fewer repeats it.
    """
    least = lambda both: F.transform(both, lambda x, i: F.when(x["g"] == F.get(both, i - 1)["g"], F.least(x["n"], F.get(both, i - 1)["n"])).otherwise(0))
    repeats = F.aggregate(let(F.sort_array(F.concat(a["more"], b["more"])), least), F.lit(0), lambda n, x: n + x)
    none = (F.size(a["more"]) == 0) | (F.size(b["more"]) == 0)
    return (F.size(F.array_intersect(a["all"], b["all"])) + F.when(none, F.lit(0)).otherwise(repeats)).cast("long")


def matches(a: Column, b: Column) -> Column:
    """array<long>: what two texts' profiles share of each of KINDS."""
    return F.zip_with(a, b, common)


def bleu(match: Column, total: Column, h: Column, r: Column, effective: bool = False) -> Column:
    """0 to 100 of arrays by order and both lengths. An order without matches counts 1 / 2, then 1 / 4 and so on; effective: up to the order that the hypothesis has."""
    zero = F.struct(F.lit(0.0).alias("zeros"), F.lit(0.0).alias("logs"), F.lit(0.0).alias("used"))

    def add(a: Column, x: Column) -> Column:
        zeros = a["zeros"] + F.when((x["t"] > 0) & (x["m"] == 0), 1.0).otherwise(0.0)
        log = F.when(x["t"] == 0, 0.0).when(x["m"] > 0, F.ln(x["m"] / x["t"])).otherwise(-F.ln(F.pow(F.lit(2.0), zeros) * x["t"]))
        return F.struct(zeros.alias("zeros"), (a["logs"] + log).alias("logs"), (a["used"] + F.when(x["t"] > 0, 1.0).otherwise(0.0)).alias("used"))

    mean = F.aggregate(F.arrays_zip(match.alias("m"), total.alias("t")), zero, add, lambda a: F.exp(a["logs"] / (a["used"] if effective else F.lit(BLEU_N))))
    brevity = F.when(h >= r, F.lit(1.0)).otherwise(F.exp(1 - r / h))
    none = (h == 0) | (F.array_max(match) == 0)
    return F.when(none if effective else none | (F.array_min(total) == 0), F.lit(0.0)).otherwise(100 * brevity * mean)


def chrf(match: Column, of_h: Column, of_r: Column) -> Column:
    """0 to 100 of arrays by order, over the orders that both sides have."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "p", "r")])
    both = F.filter(F.arrays_zip(match.alias("m"), of_h.alias("h"), of_r.alias("r")), lambda x: (x["h"] > 0) & (x["r"] > 0))
    add = lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["p"] + x["m"] / x["h"]).alias("p"), (a["r"] + x["m"] / x["r"]).alias("r"))
    mean = lambda a: F.when(a["p"] + a["r"] > 0, 100 * (1 + BETA**2) * (a["p"] / a["n"]) * (a["r"] / a["n"]) / ((BETA**2 * a["p"] + a["r"]) / a["n"])).otherwise(0.0)
    return F.aggregate(both, zero, add, mean)


def geo(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.sqrt(a * b)).otherwise(0.0)


def scores(match: Column, of_h: Column, of_r: Column, effective: bool = False) -> tuple[Column, Column]:
    """BLEU and chrF++ of matches and sizes, arrays in KINDS' order. A text's tokens are as many as its unigrams."""
    tokens = lambda x: F.slice(x, 1, BLEU_N)
    others = lambda x: F.slice(x, BLEU_N + 1, len(KINDS))
    return bleu(tokens(match), tokens(of_h), of_h[0], of_r[0], effective), chrf(others(match), others(of_h), others(of_r))


def comparison(metrics: DataFrame) -> DataFrame:
    """M6: metrics(model, and any of bleu, eval_bleu, chrf, eval_chrf, geo_mean, eval_geo_mean, total_params) -> a row per model.

    Names with eval_ come first, but for geo_mean; a missing geometric mean is worked out; parameters are written in
    billions, millions or thousands. ``best`` marks the model with the largest mean, the first by name among equals.
    """
    has = lambda c: F.col(c).cast("double") if c in metrics.columns else F.lit(None).cast("double")
    b, c = (F.coalesce(has(f"eval_{k}"), has(k), F.lit(0.0)) for k in ("bleu", "chrf"))
    given = F.coalesce(has("geo_mean"), has("eval_geo_mean"), F.lit(0.0))
    n = has("total_params")
    rows = metrics.select("model", b.alias("bleu"), c.alias("chrf"), given.alias("_g"), n.alias("_n"))
    mean = F.when((F.col("_g") == 0) & (F.col("bleu") > 0) & (F.col("chrf") > 0), F.sqrt(F.col("bleu") * F.col("chrf"))).otherwise(F.col("_g"))
    size = lambda by, mark, digits: F.format_string(f"%.{digits}f{mark}", F.col("_n") / by)
    params = F.when(F.col("_n") >= 1e9, size(1e9, "B", 1)).when(F.col("_n") >= 1e6, size(1e6, "M", 1)).when(F.col("_n").isNotNull(), size(1e3, "K", 0)).otherwise("—")
    rows = rows.select("model", "bleu", "chrf", mean.alias("geo_mean"), params.alias("params"))
    by_name = F.row_number().over(Window.orderBy(F.col("geo_mean").desc(), "model"))  # a row per model
    return rows.withColumn("best", by_name == 1)


def _sizes(x: Column) -> Column:
    return F.array(*[size(x, *o) for o in KINDS])


def _compared(rows: DataFrame, hyp: str | Column, ref: str | Column, by: list[str]) -> tuple[DataFrame, str]:
    """by's columns and a struct, named as told, of arrays over KINDS for each row: matches m, and sizes h and r."""
    hyp, ref = (F.col(c) if isinstance(c, str) else c for c in (hyp, ref))
    name = free_name(by, "counts")
    of = lambda x: F.struct(matches(profile(x["a"]), profile(x["b"])).alias("m"), _sizes(x["a"]).alias("h"), _sizes(x["b"]).alias("r"))
    a, b = free_name(by, "hyp"), free_name(by, "ref")
    dealt = rows.select(*by, hyp.alias(a), ref.alias(b)).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    # Exploded, so that what reads it many times has it worked out once.
    return dealt.select(*by, F.explode(F.array(let(F.struct(units(F.col(a)).alias("a"), units(F.col(b)).alias("b")), of))).alias(name)), name


def corpus_scores(rows: DataFrame, hyp: str | Column, ref: str | Column, by: list[str] | None = None) -> DataFrame:
    """M1-M3: bleu, chrf, geo and n over all rows, or per group. Sums are partial before the only shuffle.

    Null texts are empty ones. Columns of by mustn't be called as the result's. Without rows the scores over all are 0.
    """
    by = by or []
    counted, name = _compared(rows, hyp, ref, by)
    sums = lambda c: F.array(*[F.coalesce(F.sum(F.col(name)[c][k]), F.lit(0)) for k in range(len(KINDS))])
    summed = counted.groupBy(*by).agg(F.count("*").alias("n"), F.struct(*[sums(c).alias(c) for c in "mhr"]).alias(name))
    b, c = scores(*[F.col(name)[x] for x in "mhr"])
    return summed.select(*by, "n", b.alias("bleu"), c.alias("chrf")).withColumn("geo", geo(F.col("bleu"), F.col("chrf")))


def sentence_scores(rows: DataFrame, hyp: str | Column, ref: str | Column, key: list[str]) -> DataFrame:
    """M4: key's columns, bleu, chrf and geo of each row, BLEU by the orders that the hypothesis has. Repeated rows stay rows."""
    counted, name = _compared(rows, hyp, ref, key)
    b, c = scores(*[F.col(name)[x] for x in "mhr"], effective=True)
    return counted.select(*key, b.alias("bleu"), c.alias("chrf")).withColumn("geo", geo(F.col("bleu"), F.col("chrf")))
